"""Percentiles of very large numeric columns: mergeable dyadic-tree digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import canonical_language
from weftline.session import cut, small
from weftline.sources.tables import table

#: The universe: every double has a place of its own, a signed number of 64 bits in the order of the
#: doubles; a node of this level covers half of it.
LEVELS = 63
#: Rank error that a digest may have, as a part of its values.
ERROR = 1 / 2000
#: Most numbers whose ranks a digest keeps exact; they travel to every task.
MAX_MARKS = 10_000
#: Nodes that a task gathers before it compresses them.
GATHERED = 2_000_000

#: The metrics of workflow_metrics. Fixed values.
METRICS = (
    "lines_of_yaml", "num_jobs", "num_steps", "max_nesting_depth", "job_parallelism", "max_sequential_steps", "vertical_depth", "matrix_size", "num_conditionals",
    "num_job_dependencies", "num_reusable_workflows", "num_unique_external_actions", "num_local_actions", "num_marketplace_actions", "avg_steps_per_job",
    "dependency_ratio", "external_action_diversity", "conditional_density",
)


def keys(values: np.ndarray) -> np.ndarray:
    """The places of numbers in the universe; the order is kept, and -0 is 0."""
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def numbers(places: np.ndarray) -> np.ndarray:
    """The numbers at places; infinite beyond the last of them."""
    lowest, highest = keys(np.array([-np.inf, np.inf]))
    bits = np.clip(places.astype(np.int64), lowest, highest)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64)


def last_places(lo: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The last place that each node covers."""
    return lo | ~(np.int64(-1) << level.astype(np.int64))


def compress(group: np.ndarray, lo: np.ndarray, level: np.ndarray, n: np.ndarray, most: np.ndarray, marks: tuple[np.ndarray, np.ndarray] | None = None, top: int = LEVELS) -> tuple[np.ndarray, ...]:
    """Merges the nodes of many digests, as far as their error allows.

    A node covers 2**level places from lo on. From the leaves up to level `top`, two siblings and their
    parent become one node if together they hold no more than most[group] values. Equal nodes are
    added. marks: groups and places; no node above the leaves comes to cover one of them.
    """
    order = np.lexsort((lo, group, level))
    group, lo, level, n = group[order], lo[order], level[order], n[order]
    done = []
    carry = (np.empty(0, np.int64),) * 3
    starts = np.searchsorted(level, np.arange(LEVELS + 2))
    for at in range(LEVELS + 1):
        own = slice(starts[at], starts[at + 1])
        g, p, c = (np.concatenate([a, b]) for a, b in zip(carry, (group[own], lo[own], n[own])))
        if not len(g):
            carry = (g, p, c)
            if starts[at + 1] == len(level):
                break
            continue
        g, p, c = _added(g, p, c)
        if at >= top:
            done.append((g, p, np.full(len(g), at), c))
            carry = (np.empty(0, np.int64),) * 3
            continue
        up = p >> (at + 1) << (at + 1)
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (up[1:] != up[:-1])])
        pair = np.add.reduceat(c, first)
        # what the parent holds already, given or carried, counts too
        above = slice(starts[at + 1], starts[min(at + 2, LEVELS + 1)])
        parent = _held(group[above], lo[above], n[above], g[first], up[first])
        joins = pair + parent <= most[g[first]]
        if marks is not None and len(marks[0]):
            joins &= _held(marks[0], marks[1] >> (at + 1) << (at + 1), np.ones(len(marks[0]), np.int64), g[first], up[first]) == 0
        rise = joins[np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(g)]))]
        done.append((g[~rise], p[~rise], np.full((~rise).sum(), at), c[~rise]))
        carry = (g[rise], up[rise], c[rise])
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (group, lo, level, n)


def _added(g: np.ndarray, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((p, g))
    g, p, c = g[order], p[order], c[order]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])])
    return g[first], p[first], np.add.reduceat(c, first)


def _held(group: np.ndarray, lo: np.ndarray, n: np.ndarray, g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """n of the nodes (group, lo) at (g, p); 0 where there is none."""
    out = np.zeros(len(g), np.int64)
    if len(group):
        both = pd.MultiIndex.from_arrays([g, p])
        sums = pd.Series(n).groupby([group, lo]).sum()
        out = sums.reindex(both).fillna(0).to_numpy(np.int64)
    return out


def _places_of(marks: dict[str, list[float]] | None, metrics: list[str]) -> list[np.ndarray]:
    """The places of the marks of each metric."""
    if sum(map(len, (marks or {}).values())) > MAX_MARKS:
        raise ValueError(f"more than {MAX_MARKS} marks")
    return [np.unique(keys(np.array((marks or {}).get(m, []), np.float64))) for m in metrics]


def _marked(groups: np.ndarray, metric_of: np.ndarray, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The marks of groups, each of which is of one metric (its number, or -1)."""
    found = [(np.full(len(places[m]), g, np.int64), places[m]) for g, m in zip(groups, metric_of) if m >= 0 and len(places[m])]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def _digested(scope: list[str], metrics: list[str], error: float, places: list[np.ndarray], gathered: int):
    """For mapInArrow: one digest per scope and metric from the rows of a task, compressed while they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}  # scope -> its number; a group is scope and metric
        nodes = (np.empty(0, np.int64),) * 4
        fresh: list[tuple[np.ndarray, ...]] = []
        waiting, schema = 0, None

        def folded() -> tuple[np.ndarray, ...]:
            g, lo, level, n = (np.concatenate(x) for x in zip(nodes, *fresh))
            total = np.bincount(g, n, len(known) * len(metrics)).astype(np.int64)
            groups = np.unique(g)
            return compress(g, lo, level, n, np.floor(total * error / LEVELS).astype(np.int64), _marked(groups, groups % len(metrics), places))

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            labels = batch.select(scope).to_pandas()
            codes = labels.groupby(scope, dropna=False, sort=False).ngroup().to_numpy(np.int64)
            first = np.unique(codes, return_index=True)[1]
            rows = batch.select(scope).take(pa.array(first)).to_pylist()
            number = np.array([known.setdefault(tuple(r[c] for c in scope), len(known)) for r in rows], np.int64)[codes]
            for m, metric in enumerate(metrics):
                values = batch.column(metric).to_numpy(zero_copy_only=False).astype(np.float64)
                good = ~np.isnan(values)
                if good.any():
                    g, p, c = _added(number[good] * len(metrics) + m, keys(values[good]), np.ones(int(good.sum()), np.int64))
                    fresh.append((g, p, np.zeros(len(g), np.int64), c))
                    waiting += len(g)
            if waiting > max(gathered, len(nodes[0])):
                nodes, waiting = folded(), 0
                fresh.clear()
        if schema is None:
            return
        g, lo, level, n = folded()
        if not len(g):
            return
        scopes = list(known)
        columns = [pa.array([s[i] for s in scopes], schema.field(c).type).take(pa.array(g // len(metrics))) for i, c in enumerate(scope)]
        names = pa.array(metrics, pa.string()).take(pa.array(g % len(metrics)))
        yield pa.RecordBatch.from_arrays([*columns, names, pa.array(lo), pa.array(level.astype(np.int32)), pa.array(n)], [*scope, "metric", "lo", "level", "n"])

    return run


def digests(rows: DataFrame, scope: list[str], metrics: list[str], error: float = ERROR, marks: dict[str, list[float]] | None = None) -> DataFrame:
    """scope..., metric, lo, level, n: the nodes of one digest per scope and metric.

    A node counts n values in the 2**level places from `lo` on. Nulls and NaN do not count; negative
    and infinite values do. A scope without any value has no digest. Null scope columns are a scope.
    Each task digests its rows, compressing while it reads, and the nodes of the tasks are added.

    Digests merge by adding equal nodes, in any order and number: merged(). No node above the leaves
    holds more than error / LEVELS of the values of its digest, and this survives merging, so the
    rank of any number is known to within `error` of the number of values, always. marks: numbers per
    metric (at most MAX_MARKS) whose ranks are to be exact: no node above the leaves covers them.
    """
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in scope]
    digested = _digested(scope, list(metrics), error, _places_of(marks, metrics), GATHERED)
    parts = rows.select(*scope, *metrics).mapInArrow(digested, ", ".join([*kinds, "metric string, lo bigint, level int, n bigint"]))
    return parts.groupBy(*scope, "metric", "lo", "level").agg(F.sum("n").alias("n"))


def _squeezed(top: int, places: list[np.ndarray], gathered: int):
    """For mapInArrow, over rows ordered by digest and subtree of level `top`: compresses the subtrees, some at a time."""
    names = ["code", "lo", "level", "n", "most", "marked"]

    def squeeze(rows: np.ndarray) -> pa.RecordBatch:
        code, lo, level, n, most, marked = rows
        digest, first, group = np.unique(code, return_index=True, return_inverse=True)
        marks = _marked(np.arange(len(digest)), marked[first], places)
        g, lo, level, n = compress(group.astype(np.int64), lo, level, n, most[first], marks, top)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (digest[g], lo, level.astype(np.int32), n, most[first][g], marked[first][g])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]))
                waiting += batch.num_rows
            if waiting > gathered:
                rows = np.concatenate(held, axis=1)
                subtree = rows[1] >> top if top < LEVELS else np.zeros(rows.shape[1], np.int64)
                new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (subtree[1:] != subtree[:-1]))
                if len(new):  # the last subtree may go on
                    yield squeeze(rows[:, : new[-1] + 1])
                    rows = rows[:, new[-1] + 1 :]
                held, waiting = [rows], 0
        if held:
            yield squeeze(np.concatenate(held, axis=1))

    return run


def merged(nodes: DataFrame, scope: list[str], error: float = ERROR, marks: dict[str, list[float]] | None = None) -> DataFrame:
    """The digests of fewer scope columns, by adding and compressing nodes: scope..., metric, lo, level, n.

    Nodes meet in rounds: first those of subtrees of few places, then of larger ones, at last of whole
    digests. Each round leaves of a subtree what its error asks for, so a digest fed by any number of
    tasks and days is spread over many tasks until only about 3 * LEVELS / error of its nodes are left.
    """
    added = cut(nodes.groupBy(*scope, "metric", "lo", "level").agg(F.sum("n").alias("n")))
    totals = cut(added.groupBy(*scope, "metric").agg(F.floor(F.sum("n") * error / LEVELS).alias("most")).withColumn("code", F.monotonically_increasing_id()))
    marked = sorted(marks or {})
    places = _places_of(marks, marked)
    own = totals.select(*(F.col(c).alias(f"_{c}") for c in [*scope, "metric"]), "most", "code")
    number = (F.array_position(F.array(*map(F.lit, marked)), F.col("metric")) - 1).cast("int") if marked else F.lit(-1)
    rows = added.join(small(own), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*scope, "metric"]])
    rows = rows.select("code", "lo", "level", "n", "most", number.alias("marked"))
    for top in (20, 42, LEVELS):
        subtree = [F.col("code"), F.shiftright("lo", top)] if top < LEVELS else [F.col("code")]
        rows = rows.repartition(F.xxhash64(*subtree)).sortWithinPartitions(*subtree)
        rows = rows.mapInArrow(_squeezed(top, places, GATHERED), "code bigint, lo bigint, level int, n bigint, most bigint, marked bigint")
    return rows.select("code", "lo", "level", "n").join(small(totals.drop("most")), "code").select(*scope, "metric", "lo", "level", "n")


def percentiles(nodes: DataFrame, scope: list[str], shares: list[float]) -> DataFrame:
    """scope..., metric, n, values (one per share): the least value at or below which at least a share of the values lies."""

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        lo, level, n = frame["lo"].to_numpy(np.int64), frame["level"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        hi = last_places(lo, level)
        order = np.lexsort((level, hi))
        upto = np.cumsum(n[order])
        at = np.minimum(np.searchsorted(upto, np.ceil(np.array(shares) * upto[-1] - 1e-9), "left"), len(upto) - 1)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] for c in [*scope, "metric"]}, "n": [upto[-1]], "values": [numbers(hi[order][at]).tolist()]})

    kinds = [f"{c} {nodes.schema[c].dataType.simpleString()}" for c in scope]
    # a merged digest has a bounded number of nodes
    return nodes.groupBy(*scope, "metric").applyInPandas(look, ", ".join([*kinds, "metric string, n bigint, values array<double>"]))


def once(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per workflow_id and snapshot_day: snapshot_day, language, metrics as double, null where they do not count.

    Repeated rows are the same; should they differ, the largest number of each metric counts. A row
    without workflow_id or snapshot_day cannot repeat another and counts on its own.
    """
    language = canonical_language(F.col("language"))
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ("Python", "Java", "C++"))), language), F.lit(0)).cast("tinyint")
    lone = F.when(F.col("workflow_id").isNull() | F.col("snapshot_day").isNull(), F.monotonically_increasing_id())
    clean = [F.when((F.col(m) >= 0) & ~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(m) for m in metrics]
    kept = rows.select("workflow_id", "snapshot_day", lone.alias("lone"), code.alias("code"), *clean)
    merged_rows = kept.groupBy("workflow_id", "snapshot_day", "lone").agg(F.max("code").alias("code"), *(F.max(m).alias(m) for m in metrics))
    named = F.when(F.col("code") == 1, "Python").when(F.col("code") == 2, "Java").when(F.col("code") == 3, "C++").alias("language")
    return merged_rows.select("snapshot_day", named, *metrics)


def p5_digests(spark: SparkSession, folder: str) -> DataFrame:
    """snapshot_day, language (null where unknown), metric, lo, level, n: the digests of each day, to be combined by merged().

    Places: the doubles in their order, as signed numbers of 64 bits.
    """
    return digests(once(table(spark, folder, "workflow_metrics"), list(METRICS)), ["snapshot_day", "language"], list(METRICS))


def _scoped(spark: SparkSession, folder: str, marks: dict[str, list[float]] | None = None) -> DataFrame:
    days = digests(once(table(spark, folder, "workflow_metrics"), list(METRICS)), ["snapshot_day", "language"], list(METRICS), marks=marks)
    # read once: every node counts for Overall and for its language
    scopes = days.withColumn("language", F.explode(F.array(F.lit("Overall"), F.col("language")))).where("language is not null")
    return merged(scopes, ["language"], marks=marks)


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """language, metric, n, p10, p25, p50, p70, p80, p90, p99, over all days."""
    shares = [0.1, 0.25, 0.5, 0.7, 0.8, 0.9, 0.99]
    found = percentiles(_scoped(spark, folder), ["language"], shares)
    return found.select("language", "metric", "n", *(F.round(F.col("values")[i], 6).alias(f"p{round(100 * s)}") for i, s in enumerate(shares)))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """field_name, language, metric of the published figures that the values contradict.

    The published figures (of two small tables) are marks of the digests, so their ranks are exact.
    """
    p90 = table(spark, folder, "comprehensive_descriptive_statistics").select(
        F.lit("p90").alias("field_name"), "language", "metric", F.col("p90").cast("double").alias("figure"), F.lit(93).alias("above"), F.lit(87).alias("below")
    )
    p70 = table(spark, folder, "percentile_thresholds").select(
        F.lit("p70_cutpoint").alias("field_name"), F.lit("Overall").alias("language"), "metric", F.col("p70_cutpoint").cast("double").alias("figure"), F.lit(73).alias("above"), F.lit(67).alias("below")
    )
    claims = p90.unionByName(p70).where("figure is not null and not isnan(figure) and metric is not null").distinct()
    rows = claims.limit(MAX_MARKS + 1).collect()
    if len(rows) > MAX_MARKS:
        raise ValueError(f"more than {MAX_MARKS} published figures")
    marks: dict[str, list[float]] = {}
    for r in rows:
        marks.setdefault(r["metric"], []).append(r["figure"])
    shape = "field_name string, language string, metric string, figure double, above int, below int, place bigint"
    places = keys(np.array([r["figure"] for r in rows], np.float64)).tolist()
    named = spark.createDataFrame([(*r, p) for r, p in zip(rows, places)], shape)
    scope = F.when(F.lower(F.trim("language")) == "overall", F.lit("Overall")).otherwise(canonical_language(F.col("language")))
    nodes = _scoped(spark, folder, {m: f for m, f in marks.items() if m in METRICS}).withColumnRenamed("language", "scope")
    counts = (
        nodes.join(F.broadcast(named.withColumn("scope", scope)), ["scope", "metric"])  # bounded above
        .groupBy("field_name", "language", "metric", "figure", "above", "below")
        .agg(F.sum("n").alias("n"), F.sum(F.expr("if(lo | ~shiftleft(-1L, level) < place, n, 0)")).alias("under"), F.sum(F.expr("if(lo <= place, n, 0)")).alias("upto"))
    )
    return counts.where("100 * under > above * n or 100 * upto < below * n").select("field_name", "language", "metric").distinct()


_VALUES = f"""
    d AS (SELECT DISTINCT ON (workflow_id, snapshot_day) * FROM workflow_metrics),
    l AS (SELECT CASE lower(trim(language, E' \\t\\n\\r')) WHEN 'python' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'c++' THEN 'C++' WHEN 'cpp' THEN 'C++' END AS language, {", ".join(f"{m}::DOUBLE AS {m}" for m in METRICS)} FROM d),
    u AS (UNPIVOT l ON {", ".join(METRICS)} INTO NAME metric VALUE v),
    o AS (SELECT language, metric, v FROM u WHERE v >= 0 AND NOT isnan(v)),
    v AS (SELECT 'Overall' AS language, metric, v FROM o UNION ALL SELECT language, metric, v FROM o WHERE language IS NOT NULL)"""
ORACLES = {
    "p5_found": f"""
        WITH {_VALUES},
        c AS (SELECT 'p90' AS field_name, language, metric, p90 AS x, 0.93 AS a, 0.87 AS b FROM comprehensive_descriptive_statistics
              UNION ALL SELECT 'p70_cutpoint', 'Overall', metric, p70_cutpoint, 0.73, 0.67 FROM percentile_thresholds)
        SELECT field_name, c.language, c.metric FROM c JOIN v USING (language, metric) GROUP BY ALL
        HAVING count(*) FILTER (v < x) > any_value(a) * count(*) OR count(*) FILTER (v <= x) < any_value(b) * count(*)""",
    "p5_percentiles": f"""
        WITH {_VALUES}
        SELECT language, metric, count(*) AS n, {", ".join(f"round(quantile_disc(v, {q}), 6) AS p{round(100 * q)}" for q in (0.1, 0.25, 0.5, 0.7, 0.8, 0.9, 0.99))}
        FROM v GROUP BY 1, 2""",
}
