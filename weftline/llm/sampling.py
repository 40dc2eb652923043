"""Samples that match target proportions of categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import canonical_language
from weftline.operators.numbering import numbered
from weftline.session import cut, small
from weftline.sources.tables import table

#: Rows of a category that one task orders.
BUCKET = 200_000
#: Inclusion probabilities are counted in this part of 1, so that sums do not depend on their order.
UNIT = 1 << 40
#: Most categories with targets.
MAX_CATEGORIES = 100_000


def _draw(seed: int, unit: Column) -> Column:
    """60 bits of a hash of seed and unit, the same in every engine that has md5; 0 for a null unit."""
    return F.coalesce(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), unit.cast("string"))), 1, 15), 16, 10).cast("bigint"), F.lit(0))


def systematic(units: DataFrame, unit: str, category: str, probability: str, seed: int = 42) -> DataFrame:
    """`units` with `chosen` (boolean) and `draw` (the random number that orders a category).

    Categories stand one after the other in order, their rows ordered by a hash of seed and unit. The
    probabilities are summed along this order; a row is chosen where the sum, plus one random start,
    passes an integer. So each row is chosen with its own probability (at most 1), and a category
    gets the sum of its probabilities, rounded up or down.

    The order is cut into buckets by the hash, as many per category as its size asks for. Sums run
    inside the buckets, and the buckets' totals are summed per category, so no task orders a whole
    category. Null probabilities count as 0, null categories are a category of their own; units
    should be distinct (equal rows get neighbouring places). Columns `draw` and `chosen` of the
    units are replaced.
    """
    own = [F.col(c) for c in units.columns if c not in ("draw", "chosen")]
    part = F.floor(F.least(F.greatest(F.coalesce(probability, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * UNIT).cast("decimal(38,0)")
    # the row travels as one column, so that its names cannot clash with those used here
    drawn = units.select(F.struct(*own).alias("row"), F.col(category).alias("c"), F.col(unit).alias("id"), part.alias("part"), _draw(seed, F.col(unit)).alias("draw"))
    sizes = drawn.groupBy("c").agg(F.count("*").alias("size"), F.sum("part").alias("total"))
    ordered = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    # one row per category
    sizes = cut(sizes.select(F.col("c").alias("c1"), F.greatest(F.lit(1), F.ceil(F.col("size") / BUCKET)).alias("buckets"), F.coalesce(F.sum("total").over(ordered), F.lit(0)).alias("base")))
    placed = drawn.join(small(sizes, MAX_CATEGORIES), F.col("c").eqNullSafe(F.col("c1"))).withColumn("spot", F.shiftrightunsigned("draw", 29))  # 31 bits
    placed = placed.withColumn("bucket", F.expr("(spot * buckets) div 2147483648L"))
    inside = Window.partitionBy("c", "bucket").orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("c", "bucket").agg(F.sum("part").alias("t"))
    totals = totals.select(F.col("c").alias("c2"), F.col("bucket").alias("bucket2"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("ahead"))
    summed = placed.withColumn("upto", F.sum("part").over(inside)).join(totals, F.col("c").eqNullSafe(F.col("c2")) & (F.col("bucket") == F.col("bucket2")))
    start = F.pmod(_draw(seed, F.lit("start")), F.lit(UNIT)).cast("decimal(38,0)")
    until = F.col("base") + F.col("ahead") + F.col("upto") + start
    # whole division: that of decimals would round
    crossed = F.expr(f"until div {UNIT} > (until - part) div {UNIT}")
    return summed.withColumn("until", until).select("row.*", "draw", crossed.alias("chosen"))


def _repairs(plan: list[tuple], got: dict, size: int) -> tuple[dict, set]:
    """(category: units to add, categories that give one unit back) for plan rows (category, available, wanted).

    A category below what it is wanted with, and can give, is filled up. What the sample then holds
    beyond `size` is given back by categories above their wanted number, the one farthest above its
    exact share first; systematic sampling leaves each of them at most one unit above it.
    """
    lacks = {c: due - got.get(c, 0) for c, n, wanted, _ in plan if (due := min(n, wanted)) > got.get(c, 0)}
    excess = sum(got.values()) + sum(lacks.values()) - size
    above = sorted(((got.get(c, 0) - exact, c) for c, n, wanted, exact in plan if got.get(c, 0) > wanted), key=lambda x: (-x[0], x[1]))
    return lacks, {c for _, c in above[: max(0, excess)]}


def proportional_sample(units: DataFrame, unit: str, category: str, targets: DataFrame, share: tuple[int, int] = (1, 10), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for targets (category, target_bp, min_rows).

    units: distinct units with a category; units of a null category or one without target are not
    usable. The sample size S is share[0] of share[1] of the usable units, rounded down. A category is
    wanted with max(min_rows, floor(target_bp * S / 10000)) units. Every unit is drawn by systematic()
    with probability target / units; categories that this leaves below what is wanted are filled up in
    their random order as far as they have units, and in return categories above their wanted number
    give units back until the sample has S units again, or none is above.

    sample: unit, category. report: category, target_bp, min_rows, available, wanted, selected,
    share_bp (of the sample), deviation_bp (from the target), filled (whether selected reaches wanted).
    Null targets count as 0; of repeated targets the largest holds.
    """
    spark = units.sparkSession
    wishes = targets.groupBy(F.col(category).alias("category")).agg(F.coalesce(F.max("target_bp"), F.lit(0)).cast("bigint").alias("target_bp"), F.coalesce(F.max("min_rows"), F.lit(0)).cast("bigint").alias("min_rows"))
    wishes = cut(wishes.where("category is not null"))
    if wishes.limit(MAX_CATEGORIES + 1).count() > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    usable = cut(units.select(F.col(unit).alias("unit"), F.col(category).alias("category")).join(F.broadcast(wishes.select("category")), "category", "left_semi"))
    held = usable.groupBy("category").agg(F.count("*").alias("available"))
    # bounded by the number of categories
    counts = {r["category"]: r["available"] for r in held.collect()}
    size = sum(counts.values()) * share[0] // share[1]
    plan = []
    for r in wishes.collect():
        n, exact = counts.get(r["category"], 0), r["target_bp"] * size / 10_000
        wanted = max(r["min_rows"], r["target_bp"] * size // 10_000)
        plan.append((r["category"], r["target_bp"], r["min_rows"], n, wanted, min(1.0, exact / n) if n else 0.0, exact))
    rates = spark.createDataFrame([(p[0], p[5]) for p in plan], "category string, probability double")
    rated = usable.join(F.broadcast(rates), "category")  # a row per category
    drawn = cut(systematic(rated, "unit", "category", "probability", seed).select("unit", "category", "draw", "chosen"))
    got = {r["category"]: r["n"] for r in drawn.where("chosen").groupBy("category").agg(F.count("*").alias("n")).collect()}
    lacks, gives = _repairs([(c, n, wanted, exact) for c, _, _, n, wanted, _, exact in plan], got, size)
    chosen = drawn.where("chosen").select("unit", "category", "draw")
    if gives:
        giving = spark.createDataFrame([(c,) for c in sorted(gives)], "category string")
        last = chosen.join(F.broadcast(giving), "category", "left_semi").groupBy("category").agg(F.max(F.struct("draw", "unit")).alias("last"))  # a row per category
        chosen = chosen.join(F.broadcast(last.select("category", "last.*")), ["category", "draw", "unit"], "left_anti")
    chosen = chosen.select("unit", "category")
    if lacks:
        lacking = spark.createDataFrame(sorted(lacks.items()), "category string, lack bigint")
        spare = numbered(drawn.where("not chosen").join(F.broadcast(lacking), "category"), ["category"], [F.col("draw"), F.col("unit")])
        chosen = chosen.unionByName(spare.where("k <= lack").select("unit", "category"))
    chosen = cut(chosen)
    selected = {r["category"]: r["n"] for r in chosen.groupBy("category").agg(F.count("*").alias("n")).collect()}
    total = sum(selected.values())
    rows = []
    for c, bp, least, n, wanted, _, _ in plan:
        s = selected.get(c, 0)
        of_all = 10_000 * s / total if total else 0.0
        rows.append((c, bp, least, n, wanted, s, round(of_all, 2), round(of_all - bp, 2), s >= wanted))
    report = spark.createDataFrame(rows, "category string, target_bp bigint, min_rows bigint, available bigint, wanted bigint, selected bigint, share_bp double, deviation_bp double, filled boolean")
    return chosen.withColumnsRenamed({"unit": unit, "category": category}), report.withColumnRenamed("category", category)


def _stratum_key(col):
    """The letters of a stratum, however it is cased and separated."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "cpp|c\\+\\+", "cplusplus"), "[^a-z]", "")


def _drawn(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = table(spark, folder, "sample_targets").select("stratum", "language", "target_bp", "min_rows")
    # of targets that differ in spelling only the first holds
    names = cut(targets.groupBy(_stratum_key(F.col("stratum")).alias("key")).agg(F.min("stratum").alias("stratum")))
    frame = table(spark, folder, "sample_metadata").select("workflow_id", _stratum_key(F.col("stratum")).alias("key"))
    units = frame.where("workflow_id is not null").join(small(names, MAX_CATEGORIES), "key").groupBy("workflow_id").agg(F.min("stratum").alias("stratum"))
    sample, report = proportional_sample(units, "workflow_id", "stratum", targets)
    return sample, report, targets


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, stratum, language of the sample."""
    sample, _, targets = _drawn(spark, folder)
    return sample.join(F.broadcast(targets.select("stratum", "language")), "stratum").select("workflow_id", "stratum", "language")


def p3_strata(spark: SparkSession, folder: str) -> DataFrame:
    """The report: stratum, target_bp, min_rows, available, wanted, selected, share_bp, deviation_bp, filled."""
    return _drawn(spark, folder)[1]


def p3_languages(spark: SparkSession, folder: str) -> DataFrame:
    """language, target_bp (of sample_summary), selected, share_bp (of the sample)."""
    _, report, targets = _drawn(spark, folder)
    got = report.join(F.broadcast(targets.select("stratum", "language")), "stratum").groupBy("language").agg(F.sum("selected").alias("selected"), F.round(F.sum("share_bp"), 1).alias("share_bp"))
    wanted = table(spark, folder, "sample_summary").select(canonical_language(F.col("language")).alias("language"), "target_bp")
    return wanted.join(got, "language", "left").select("language", "target_bp", F.coalesce("selected", F.lit(0)).alias("selected"), "share_bp")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """stratum of those that cannot be filled."""
    return p3_strata(spark, folder).where("not filled").select("stratum")


#: t: targets; u: usable units; s: the sample size; plan: what is wanted of each stratum.
_PLAN = r"""
    t AS (SELECT stratum, language, target_bp, min_rows, regexp_replace(regexp_replace(lower(stratum), 'cpp|c\+\+', 'cplusplus', 'g'), '[^a-z]', '', 'g') AS k FROM sample_targets),
    u AS (SELECT DISTINCT m.workflow_id, t.stratum FROM sample_metadata m JOIN t ON t.k = regexp_replace(regexp_replace(lower(m.stratum), 'cpp|c\+\+', 'cplusplus', 'g'), '[^a-z]', '', 'g')),
    s AS (SELECT count(DISTINCT workflow_id) // 10 AS s FROM u),
    n AS (SELECT stratum, count(DISTINCT workflow_id) AS n FROM u GROUP BY 1),
    plan AS (SELECT t.stratum, t.language, t.target_bp::BIGINT AS target_bp, t.min_rows::BIGINT AS min_rows, coalesce(n.n, 0) AS available, greatest(t.min_rows, t.target_bp * s.s // 10000)::BIGINT AS wanted, t.target_bp::BIGINT * s.s / 10000 AS exact, s.s FROM t CROSS JOIN s LEFT JOIN n USING (stratum))"""
#: One pass of systematic sampling in the order of strata and of a hash, then repaired.
_SAMPLE = _PLAN + r""",
    d AS (SELECT u.workflow_id, u.stratum, ('0x' || substr(md5('42:' || u.workflow_id::VARCHAR), 1, 15))::BIGINT AS draw, floor(least(1, exact / available) * 1099511627776)::HUGEINT AS part FROM u JOIN plan USING (stratum)),
    z AS (SELECT *, sum(part) OVER (ORDER BY stratum, draw, workflow_id ROWS UNBOUNDED PRECEDING) + (('0x' || substr(md5('42:start'), 1, 15))::BIGINT % 1099511627776) AS upto FROM d),
    c AS (SELECT *, upto::HUGEINT // 1099511627776 > (upto - part)::HUGEINT // 1099511627776 AS chosen FROM z),
    got AS (SELECT stratum, count(*) FILTER (chosen) AS got FROM c GROUP BY 1),
    due AS (SELECT plan.*, coalesce(got, 0) AS got, greatest(least(available, wanted) - coalesce(got, 0), 0) AS lack FROM plan LEFT JOIN got USING (stratum)),
    gives AS (SELECT stratum FROM (SELECT stratum, row_number() OVER (ORDER BY got - exact DESC, stratum) AS i FROM due WHERE got > wanted) WHERE i <= (SELECT sum(got) + sum(lack) - any_value(s) FROM due)),
    r AS (SELECT c.*, due.lack, due.language, row_number() OVER (PARTITION BY c.stratum, chosen ORDER BY draw, workflow_id) AS k, row_number() OVER (PARTITION BY c.stratum, chosen ORDER BY draw DESC, workflow_id DESC) AS back FROM c JOIN due USING (stratum)),
    sample AS (SELECT workflow_id, stratum, language FROM r WHERE chosen AND NOT (back = 1 AND stratum IN (SELECT stratum FROM gives)) OR NOT chosen AND k <= lack),
    report AS (SELECT plan.stratum, plan.language, target_bp, min_rows, available, wanted, count(sample.workflow_id) AS selected FROM plan LEFT JOIN sample USING (stratum) GROUP BY ALL),
    shares AS (SELECT *, 10000 * selected / (SELECT count(*) FROM sample) AS share FROM report)"""
ORACLES = {
    "p3_found": f"WITH {_PLAN} SELECT stratum FROM plan WHERE available < wanted",
    "p3_sample": f"WITH {_SAMPLE} SELECT workflow_id, stratum, language FROM sample",
    "p3_strata": f"WITH {_SAMPLE} SELECT * EXCLUDE (language, share), round(share, 2) AS share_bp, round(share - target_bp, 2) AS deviation_bp, selected >= wanted AS filled FROM shares",
    "p3_languages": f"""
        WITH {_SAMPLE}, l AS (SELECT language, sum(selected)::BIGINT AS selected, round(sum(round(share, 2)), 1) AS share_bp FROM shares GROUP BY 1)
        SELECT w.language, target_bp, coalesce(l.selected, 0) AS selected, share_bp FROM (SELECT CASE lower(trim(language, E' \\t\\n\\r')) WHEN 'python' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'c++' THEN 'C++' WHEN 'cpp' THEN 'C++' END AS language, target_bp FROM sample_summary) w LEFT JOIN l USING (language)""",
}
