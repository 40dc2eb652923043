"""Queries on metrics of workflows: bands, descriptive statistics, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.numbers import ratio
from weftline.functions.text import canonical_language
from weftline.operators import bands, describe, stats
from weftline.operators.histogram import quantiles, value_histogram
from weftline.session import cut
from weftline.sources.tables import table

#: The metrics of a workflow: counts, ratios and yes-or-no features. Fixed values.
NUMERIC = (
    "lines_of_yaml", "num_jobs", "num_steps", "max_nesting_depth", "job_parallelism", "max_sequential_steps", "vertical_depth", "matrix_size", "num_conditionals",
    "num_job_dependencies", "num_reusable_workflows", "num_unique_external_actions", "num_local_actions", "num_marketplace_actions", "avg_steps_per_job",
    "dependency_ratio", "external_action_diversity", "conditional_density",
)
BINARY = ("has_matrix", "has_conditionals", "has_job_dependencies", "uses_reusable_workflows", "uses_external_actions", "uses_local_actions")


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "workflow_metrics").withColumn("language", canonical_language(F.col("language")))


def metrics_per_order(spark: SparkSession, folder: str) -> DataFrame:
    """Steps (line items), jobs (suppliers) and ratios of every order with line items."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("k"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    per = lines.groupBy("l_orderkey").agg(F.sum("k").alias("num_steps"), F.count("*").alias("num_jobs"), F.max("k").alias("max_sequential_steps"), F.sum("r").alias("num_conditionals"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    out = per.join(orders, per.l_orderkey == orders.o_orderkey)
    return out.select(
        "o_orderkey", "o_orderstatus", "num_steps", "num_jobs", "max_sequential_steps", "num_conditionals", (F.col("num_conditionals") > 0).alias("has_conditionals"),
        ratio(F.col("num_steps"), F.col("num_jobs"), 2).alias("avg_steps_per_job"), ratio(F.col("num_conditionals"), F.col("num_steps"), 3).alias("conditional_density"),
    )


def band_distribution_scoped(spark: SparkSession, folder: str) -> DataFrame:
    return bands.band_distribution(_metrics(spark, folder), "language", list(NUMERIC))


def percentile_cuts(spark: SparkSession, folder: str) -> DataFrame:
    found = bands.thresholds(_metrics(spark, folder), list(NUMERIC))
    return found.select("metric", *(F.round(f"p{q}", 4).alias(f"p{q}") for q in (70, 80, 90)), "n_unique_values")


def value_bands(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, snapshot_day, band of the number of steps."""
    rows = _metrics(spark, folder).select("workflow_id", "snapshot_day", "ingested_at", "num_steps")
    cuts = bands.thresholds(rows, ["num_steps"]).drop("metric")
    banded = rows.crossJoin(F.broadcast(cuts))  # one row
    return banded.select("workflow_id", "snapshot_day", "num_steps", bands.value_band(F.col("num_steps"), F.col("p70"), F.col("p80"), F.col("p90")).alias("band"))


def fixed_bands_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """language, metric, label, workflows: the fixed bands of all metrics."""
    limits = spark.createDataFrame(bands.guide(), "metric string, label string, lo double, hi double")
    return bands.fixed_bands(_metrics(spark, folder), "language", limits).withColumnRenamed("count", "workflows")


def descriptives_scoped(spark: SparkSession, folder: str) -> DataFrame:
    return describe.descriptives(_metrics(spark, folder), "language", list(NUMERIC))


def binary_stats_scoped(spark: SparkSession, folder: str) -> DataFrame:
    return describe.binary_stats(_metrics(spark, folder), "language", list(BINARY))


def band_crosstab_pct(spark: SparkSession, folder: str) -> DataFrame:
    return bands.band_crosstab(_metrics(spark, folder).where("language is not null"), "language", F.col("num_steps_interpretation"))


def value_histogram_steps(spark: SparkSession, folder: str) -> DataFrame:
    return value_histogram(_metrics(spark, folder), "language", ["num_steps", "dependency_ratio"]).select(F.col("group").alias("language"), "metric", "value", "cnt")


def _hist(spark: SparkSession, folder: str) -> DataFrame:
    return value_histogram(_metrics(spark, folder).where("language is not null"), "language", list(NUMERIC))


def kruskal_wallis(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.kruskal_wallis(_hist(spark, folder))
    return found.withColumn("p_value", F.round("p_value", 8))


def mann_whitney_cliffs(spark: SparkSession, folder: str) -> DataFrame:
    return stats.mann_whitney(_hist(spark, folder)).drop("p_value", "p_formatted")


def mann_whitney_p(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.mann_whitney(_hist(spark, folder)).select("metric", "group_1", "group_2", "z", "p_value", "p_formatted")
    return found.withColumn("p_value", F.round("p_value", 10))


def chi_square_omnibus(spark: SparkSession, folder: str) -> DataFrame:
    return stats.chi_square(stats.contingency(_metrics(spark, folder), "language", list(BINARY)))


def fisher_exact_cohens_h(spark: SparkSession, folder: str) -> DataFrame:
    """The binary features of all workflows and days, per pair of languages."""
    rows = _metrics(spark, folder)
    return stats.fisher(stats.contingency(rows, "language", list(BINARY)))


def kde_log1p(spark: SparkSession, folder: str) -> DataFrame:
    hist = value_histogram(_metrics(spark, folder).where("language is not null"), "language", ["num_steps"])
    found = stats.kde_log1p(hist.drop("metric"), points=100)
    return found.withColumnRenamed("group", "language")


def group_medians(spark: SparkSession, folder: str) -> DataFrame:
    """language, metric, median, mean: what the plots of groups show."""
    found = quantiles(cut(_hist(spark, folder)), ["group", "metric"], [0.5], others=[(F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("mean")])
    return found.select(F.col("group").alias("language"), "metric", F.round(F.col("p")[0], 4).alias("median"), F.round("mean", 4).alias("mean"))


def quantile_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sample_metadata").select("workflow_id", "file_size_kb", "num_steps")
    return bands.quantile_labels(rows, "file_size_kb", ["small", "medium", "large"]).select("workflow_id", "file_size_kb", "label")


def complexity_tertiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sample_metadata").groupBy("workflow_id").agg(F.max("num_steps").alias("num_steps"), F.max("num_jobs").alias("num_jobs"))
    found = bands.tertiles(rows, "num_steps", ["workflow_id"])
    return found.select("workflow_id", "num_steps", "tertile", bands.job_category(F.col("num_jobs")).alias("job_category"))


#: What is tested of the profiles of workflows. Fixed values.
PROFILE_NUMERIC = ("sequence_length", "num_steps_total", "completeness_score", "num_jobs", "avg_steps_per_job", "dependency_depth", "external_actions_count", "sha_percentage")
PROFILE_BINARY = ("has_checkout", "has_setup", "has_test", "has_build", "uses_cache", "uses_reusable_workflows", "uses_composite_actions", "has_push", "has_pull_request", "has_schedule", "has_workflow_dispatch", "any_sha_pinned")


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "processed_workflows").withColumn("language", canonical_language(F.col("language")))
    return rows.where("language is not null").withColumn("any_sha_pinned", (F.coalesce("pinned_to_sha", F.lit(0)) > 0).cast("int"))


def profile_kruskal(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.kruskal_wallis(value_histogram(_profiles(spark, folder), "language", list(PROFILE_NUMERIC)))
    return found.withColumn("p_value", F.round("p_value", 8))


def profile_rank_tests(spark: SparkSession, folder: str) -> DataFrame:
    return stats.mann_whitney(value_histogram(_profiles(spark, folder), "language", list(PROFILE_NUMERIC))).drop("p_value", "p_formatted")


def profile_chi_square(spark: SparkSession, folder: str) -> DataFrame:
    return stats.chi_square(stats.contingency(_profiles(spark, folder), "language", list(PROFILE_BINARY)))


def profile_proportion_tests(spark: SparkSession, folder: str) -> DataFrame:
    return stats.fisher(stats.contingency(_profiles(spark, folder), "language", list(PROFILE_BINARY)))


def notable_tests(spark: SparkSession, folder: str) -> DataFrame:
    """kind, tests, notable: how many pairs of languages were compared, and with more than a negligible effect."""
    effect = F.col("effect").isin("small", "medium", "large")
    kinds = (("rank", profile_rank_tests(spark, folder)), ("proportion", profile_proportion_tests(spark, folder)))
    parts = [found.agg(F.lit(k).alias("kind"), F.count("*").alias("tests"), F.count_if(effect).alias("notable")) for k, found in kinds]
    return parts[0].unionByName(parts[1])


QUERIES = {
    f.__name__: f
    for f in (
        profile_kruskal, profile_rank_tests, profile_chi_square, profile_proportion_tests, notable_tests, metrics_per_order, band_distribution_scoped, percentile_cuts, value_bands, fixed_bands_range_join, descriptives_scoped, binary_stats_scoped, band_crosstab_pct, value_histogram_steps,
        kruskal_wallis, mann_whitney_cliffs, mann_whitney_p, chi_square_omnibus, fisher_exact_cohens_h, kde_log1p, group_medians, quantile_labels, complexity_tertiles,
    )
}

_LANG = "CASE lower(trim(language, E' \\t\\n\\r')) WHEN 'python' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'c++' THEN 'C++' WHEN 'cpp' THEN 'C++' END"


def _long(rows: str, numeric: tuple[str, ...]) -> str:
    return f"""
    l AS (SELECT {_LANG} AS language, {", ".join(f"{m}::DOUBLE AS {m}" for m in numeric)} FROM {rows}),
    u AS (UNPIVOT l ON {", ".join(numeric)} INTO NAME metric VALUE value),
    o AS (SELECT language, metric, value FROM u WHERE value IS NOT NULL AND NOT isnan(value)),
    s AS (SELECT * FROM o WHERE language IS NOT NULL UNION ALL SELECT 'Overall', metric, value FROM o)"""


def _yes_no(rows: str, binary: tuple[str, ...]) -> str:
    return f"""
    b AS (SELECT {_LANG} AS language, {", ".join(f"coalesce({m}::BOOLEAN, false) AS {m}" for m in binary)} FROM {rows}),
    f AS (UNPIVOT b ON {", ".join(binary)} INTO NAME feature VALUE yes)"""


def _ranked(rows: str, numeric: tuple[str, ...]) -> str:
    return f"""
    WITH {_long(rows, numeric)},
    g AS (SELECT * FROM o WHERE language IS NOT NULL)"""


_LONG, _BINARY, _RANKS = _long("workflow_metrics", NUMERIC), _yes_no("workflow_metrics", BINARY), _ranked("workflow_metrics", NUMERIC)
_SHA = "(SELECT *, pinned_to_sha > 0 AS any_sha_pinned FROM processed_workflows)"
_PAIRS = """
    n AS (SELECT metric, language, count(*) AS n, median(value) AS median FROM g GROUP BY ALL),
    p AS (SELECT a.metric, a.language AS group_1, b.language AS group_2, a.n AS n1, b.n AS n2, a.median AS median1, b.median AS median2 FROM n a JOIN n b ON a.metric = b.metric AND a.language < b.language),
    r AS (SELECT p.metric, group_1, group_2, g.language = group_1 AS first, value FROM p JOIN g ON g.metric = p.metric AND g.language IN (group_1, group_2)),
    h AS (SELECT metric, group_1, group_2, value, count(*) AS t, count(*) FILTER (first) AS c1 FROM r GROUP BY ALL),
    k AS (SELECT *, sum(t) OVER (PARTITION BY metric, group_1, group_2 ORDER BY value) - t + (t + 1) / 2.0 AS rank FROM h),
    q AS (SELECT metric, group_1, group_2, sum(c1 * rank)::DOUBLE AS r1, sum(t::DOUBLE ** 3 - t) AS ties FROM k GROUP BY ALL),
    w AS (SELECT p.*, r1 - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1::DOUBLE * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS sd FROM p JOIN q USING (metric, group_1, group_2))"""
def kruskal_sql(ranks: str) -> str:
    return f"""
        {ranks},
        h AS (SELECT metric, value, count(*) AS t FROM g GROUP BY ALL),
        k AS (SELECT *, sum(t) OVER (PARTITION BY metric ORDER BY value) - t + (t + 1) / 2.0 AS rank FROM h),
        c AS (SELECT metric, sum(t::DOUBLE ** 3 - t) AS ties FROM h GROUP BY 1),
        r AS (SELECT metric, language, count(*) AS n, sum(rank)::DOUBLE AS r FROM g JOIN k USING (metric, value) GROUP BY 1, 2),
        p AS (SELECT metric, count(*) AS groups, sum(n)::BIGINT AS n, sum(r * r / n) AS s FROM r GROUP BY 1),
        x AS (SELECT metric, groups, n, (12.0 / (n::DOUBLE * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n::DOUBLE ** 3 - n)) AS h FROM p JOIN c USING (metric) WHERE groups > 2)
        SELECT metric, groups, n, round(h, 3) AS h, round(exp(-h / 2), 8) AS p_value, exp(-h / 2) < 0.05 AS significant FROM x"""


def rank_sql(ranks: str) -> str:
    return f"""
        {ranks}, {_PAIRS},
        d AS (SELECT *, 2 * u / (n1::DOUBLE * n2) - 1 AS d FROM w)
        SELECT metric, group_1, group_2, n1, n2, median1, median2, median1 - median2 AS median_diff, u, round((greatest(u, n1::DOUBLE * n2 - u) - n1::DOUBLE * n2 / 2 - 0.5) / sd, 6) AS z, round(d, 6) AS delta,
               CASE WHEN abs(d) < 0.147 THEN 'negligible' WHEN abs(d) < 0.33 THEN 'small' WHEN abs(d) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM d"""


def chi_sql(yes_no: str) -> str:
    return f"""
        WITH {yes_no},
        c AS (SELECT feature, language, count(*) FILTER (yes) AS y, count(*) FILTER (NOT yes) AS z FROM f WHERE language IS NOT NULL GROUP BY ALL),
        a AS (SELECT feature, sum(y)::DOUBLE AS ay, sum(z)::DOUBLE AS az FROM c GROUP BY 1),
        e AS (SELECT c.*, ay, az, (y + z) * ay / (ay + az) AS e1, (y + z) * az / (ay + az) AS e0 FROM c JOIN a USING (feature)),
        x AS (SELECT feature, count(*) AS groups, sum((y - e1) ** 2 / nullif(e1, 0) + (z - e0) ** 2 / nullif(e0, 0)) AS x, min(least(e1, e0)) AS l, any_value(ay) AS ay, any_value(az) AS az FROM e GROUP BY 1)
        SELECT feature, groups, CASE WHEN ay = 0 OR az = 0 OR l < 5 THEN 0 ELSE round(x, 4) END AS statistic, CASE WHEN ay = 0 OR az = 0 THEN 1 WHEN l < 5 THEN NULL ELSE round(exp(-x / 2), 8) END AS p_value,
               CASE WHEN ay = 0 OR az = 0 THEN 'no variation' WHEN l < 5 THEN 'expected count below 5' END AS note FROM x"""


def fisher_sql(yes_no: str) -> str:
    return f"""
        WITH {yes_no},
        c AS (SELECT feature, language, count(*) FILTER (yes) AS y, count(*) FILTER (NOT yes) AS z FROM f WHERE language IS NOT NULL GROUP BY ALL),
        p AS (SELECT a.feature, a.language AS group_1, b.language AS group_2, a.y AS y1, a.z AS z1, b.y AS y2, b.z AS z2 FROM c a JOIN c b ON a.feature = b.feature AND a.language < b.language WHERE a.y + b.y > 0 AND a.z + b.z > 0),
        k AS (SELECT *, unnest(range(greatest(0, (y1 + y2) - (y2 + z2)), least(y1 + z1, y1 + y2) + 1)) AS k FROM p),
        m AS (SELECT *, lgamma(y1 + z1 + 1) + lgamma(y2 + z2 + 1) + lgamma(y1 + y2 + 1) + lgamma(z1 + z2 + 1) - lgamma(y1 + z1 + y2 + z2 + 1)
                     - lgamma(k + 1) - lgamma(y1 + z1 - k + 1) - lgamma(y1 + y2 - k + 1) - lgamma(z2 - y1 + k + 1) AS l FROM k),
        o AS (SELECT feature, group_1, group_2, l AS seen FROM m WHERE k = y1),
        s AS (SELECT feature, group_1, group_2, any_value(y1 / (y1 + z1)) AS p1, any_value(y2 / (y2 + z2)) AS p2, sum(exp(l)) FILTER (l <= seen + 1e-7) AS p FROM m JOIN o USING (feature, group_1, group_2) GROUP BY ALL),
        h AS (SELECT *, 2 * (asin(sqrt(p1)) - asin(sqrt(p2))) AS h FROM s)
        SELECT feature, group_1, group_2, round(least(p, 1), 8) AS p_value, round(100 * p1, 2) AS prop1_pct, round(100 * p2, 2) AS prop2_pct, round(h, 6) AS h,
               CASE WHEN abs(h) < 0.2 THEN 'negligible' WHEN abs(h) < 0.5 THEN 'small' WHEN abs(h) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM h"""


ORACLES = {
    "metrics_per_order": """
        WITH s AS (SELECT l_orderkey, l_suppkey, count(*) AS k, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL),
        p AS (SELECT l_orderkey, sum(k)::BIGINT AS a, count(*) AS b, max(k) AS m, sum(r)::BIGINT AS c FROM s GROUP BY 1)
        SELECT o_orderkey, o_orderstatus, a AS num_steps, b AS num_jobs, m AS max_sequential_steps, c AS num_conditionals, c > 0 AS has_conditionals,
               round(a / b, 2) AS avg_steps_per_job, round(c / a, 3) AS conditional_density FROM p JOIN orders ON o_orderkey = l_orderkey""",
    "band_distribution_scoped": f"""
        WITH {_LONG},
        t AS (SELECT metric, quantile_cont(value, 0.7) AS p70, quantile_cont(value, 0.8) AS p80, quantile_cont(value, 0.9) AS p90 FROM o GROUP BY 1),
        b AS (SELECT language, metric, CASE WHEN value <= p70 THEN 'low' WHEN value <= p80 THEN 'moderate' WHEN value <= p90 THEN 'high' ELSE 'very high' END AS band FROM s JOIN t USING (metric)),
        c AS (SELECT language, metric, band, count(*) AS n FROM b GROUP BY ALL),
        g AS (SELECT DISTINCT language, metric, unnest(['low', 'moderate', 'high', 'very high']) AS band FROM b)
        SELECT language, metric, band, coalesce(n, 0) AS count, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY language, metric), 2) AS percentage FROM g LEFT JOIN c USING (language, metric, band)""",
    "percentile_cuts": f"""
        WITH {_LONG} SELECT metric, {", ".join(f"round(quantile_cont(value, 0.{q // 10}), 4) AS p{q}" for q in (70, 80, 90))}, count(DISTINCT value) AS n_unique_values FROM o GROUP BY 1""",
    "value_bands": """
        WITH t AS (SELECT quantile_cont(num_steps, 0.7) AS p70, quantile_cont(num_steps, 0.8) AS p80, quantile_cont(num_steps, 0.9) AS p90 FROM workflow_metrics)
        SELECT workflow_id, snapshot_day, num_steps, CASE WHEN num_steps IS NULL THEN '' WHEN num_steps <= p70 THEN 'low' WHEN num_steps <= p80 THEN 'moderate' WHEN num_steps <= p90 THEN 'high' ELSE 'very high' END AS band
        FROM workflow_metrics, t""",
    "fixed_bands_range_join": f"""
        WITH {_LONG}, b AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{x}', {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE)" for m, x, lo, hi in bands.guide())}) v(metric, label, lo, hi))
        SELECT language, o.metric, label, count(*) AS workflows FROM o LEFT JOIN b ON b.metric = o.metric AND (lo IS NULL OR value > lo) AND (hi IS NULL OR value <= hi) GROUP BY ALL""",
    "descriptives_scoped": f"""
        WITH {_LONG}
        SELECT language, metric, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min,
               round(quantile_cont(value, 0.7), 4) AS p70, round(quantile_cont(value, 0.8), 4) AS p80, round(quantile_cont(value, 0.9), 4) AS p90, round(max(value), 4) AS max,
               round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, round(CASE WHEN avg(value) = 0 THEN 0 ELSE stddev_samp(value) / avg(value) END, 4) AS cv
        FROM s GROUP BY 1, 2""",
    "binary_stats_scoped": f"""
        WITH {_BINARY}, s AS (SELECT * FROM f WHERE language IS NOT NULL UNION ALL SELECT 'Overall', feature, yes FROM f)
        SELECT language, feature, count(*) FILTER (yes) AS count, count(*) AS total, round(count(*) FILTER (yes) / count(*), 3) AS proportion, round(100.0 * count(*) FILTER (yes) / count(*), 1) AS percentage FROM s GROUP BY 1, 2""",
    "band_crosstab_pct": f"""
        WITH b AS (SELECT {_LANG} AS language, num_steps_interpretation AS band FROM workflow_metrics),
        c AS (SELECT language, {", ".join(f"count(*) FILTER (band = '{x}') AS {x.replace(' ', '_')}" for x in bands.BANDS)} FROM b WHERE language IS NOT NULL GROUP BY 1)
        SELECT language, {", ".join(f"round(100.0 * {x} / (low + moderate + high + very_high), 2) AS {x}" for x in ("low", "moderate", "high", "very_high"))} FROM c""",
    "value_histogram_steps": f"""
        WITH {_LONG} SELECT language, metric, value, count(*) AS cnt FROM o WHERE metric IN ('num_steps', 'dependency_ratio') GROUP BY ALL""",
    "profile_kruskal": kruskal_sql(_ranked("processed_workflows", PROFILE_NUMERIC)),
    "profile_rank_tests": rank_sql(_ranked("processed_workflows", PROFILE_NUMERIC)),
    "profile_chi_square": chi_sql(_yes_no(_SHA, PROFILE_BINARY)),
    "profile_proportion_tests": fisher_sql(_yes_no(_SHA, PROFILE_BINARY)),
    "notable_tests": f"""
        SELECT 'rank' AS kind, count(*) AS tests, count(*) FILTER (effect <> 'negligible') AS notable FROM ({rank_sql(_ranked("processed_workflows", PROFILE_NUMERIC))})
        UNION ALL SELECT 'proportion', count(*), count(*) FILTER (effect <> 'negligible') FROM ({fisher_sql(_yes_no(_SHA, PROFILE_BINARY))})""",
    "kruskal_wallis": kruskal_sql(_RANKS),
    "mann_whitney_cliffs": rank_sql(_RANKS),
    # 2 (1 - Phi(z)): exp(-z^2 / 2) sqrt(2 / pi) times the integral of exp(-z t - t^2 / 2), by Simpson's rule
    "mann_whitney_p": f"""
        {_RANKS}, {_PAIRS},
        z AS (SELECT metric, group_1, group_2, (greatest(u, n1::DOUBLE * n2 - u) - n1::DOUBLE * n2 / 2 - 0.5) / sd AS z FROM w),
        m AS (SELECT *, greatest(z, 0) AS y, greatest(z, 1) AS m FROM z),
        i AS (SELECT *, list_sum(list_transform(range(0, 4001), lambda k: (CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-y * k * 0.01 / m - (k * 0.01 / m) ** 2 / 2))) * 0.01 / 3 / m AS s FROM m),
        v AS (SELECT *, least(1, exp(-y * y / 2) * sqrt(2 / pi()) * s) AS p FROM i)
        SELECT metric, group_1, group_2, round(z, 6) AS z, round(p, 10) AS p_value, CASE WHEN p < 1e-4 THEN printf('%.4e', p) ELSE printf('%.4f', p) END AS p_formatted FROM v""",
    "chi_square_omnibus": chi_sql(_BINARY),
    "fisher_exact_cohens_h": fisher_sql(_BINARY),
    "kde_log1p": f"""
        WITH {_LONG},
        v AS (SELECT language, ln(1 + value) AS v, count(*) AS c FROM o WHERE language IS NOT NULL AND metric = 'num_steps' AND value >= 0 GROUP BY ALL),
        w AS (SELECT language, sum(c) AS n, sqrt((sum(v * v * c) - sum(v * c) * sum(v * c) / sum(c)) / (sum(c) - 1)) * sum(c)::DOUBLE ** -0.2 AS width FROM v GROUP BY 1 HAVING sum(c) >= 10),
        g AS (SELECT i * (SELECT max(v) FROM v) / 99 AS x FROM range(100) r(i))
        SELECT language, round(x, 6) AS x, round(sum(c * exp(-0.5 * ((x - v) / width) ** 2) / (n * width * 2.5066282746310002)), 6) AS density FROM v JOIN w USING (language), g WHERE width > 0 GROUP BY 1, x""",
    "group_medians": f"""
        WITH {_LONG} SELECT language, metric, round(median(value), 4) AS median, round(avg(value), 4) AS mean FROM o WHERE language IS NOT NULL GROUP BY 1, 2""",
    "quantile_labels": """
        WITH e AS (SELECT list_distinct([quantile_cont(file_size_kb, 0.0), quantile_cont(file_size_kb, 1 / 3), quantile_cont(file_size_kb, 2 / 3), quantile_cont(file_size_kb, 1.0)]).list_sort() AS e FROM sample_metadata)
        SELECT workflow_id, file_size_kb, CASE WHEN file_size_kb IS NULL THEN NULL WHEN len(e) = 1 THEN 'small' ELSE ['small', 'medium', 'large'][least(len(list_filter(e[2:], lambda x: x < file_size_kb)) + 1, len(e) - 1)] END AS label FROM sample_metadata, e""",
    "complexity_tertiles": """
        WITH w AS (SELECT workflow_id, max(num_steps) AS num_steps, max(num_jobs) AS num_jobs FROM sample_metadata GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY num_steps, workflow_id) AS r, count(*) OVER () AS n FROM w WHERE num_steps IS NOT NULL)
        SELECT workflow_id, num_steps, CASE WHEN r <= 1 + (n - 1) / 3 THEN 'simple' WHEN r <= 1 + 2 * ((n - 1) / 3) THEN 'moderate' ELSE 'complex' END AS tertile,
               CASE WHEN num_jobs = 1 THEN 'single_job' WHEN num_jobs <= 3 THEN 'few_jobs' WHEN num_jobs IS NOT NULL THEN 'many_jobs' END AS job_category FROM r""",
}
