"""Percentile bands, fixed bands and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.histogram import quantiles, value_histogram
from weftline.operators.numbering import numbered
from weftline.operators.scopes import with_overall
from weftline.session import cut, small

BANDS = ("low", "moderate", "high", "very high")
# Metric, then each band with its upper bound, the last without one.
GUIDE = """
lines_of_yaml compact 50 moderate 150 large 300 very_large
num_jobs simple 3 moderate 7 complex 15 highly_complex
num_steps simple 10 moderate 30 complex 60 highly_complex
max_nesting_depth flat 3 moderate 6 deep 9 very_deep
job_parallelism low 3 moderate 7 high 15 very_high
max_sequential_steps short 5 moderate 15 long 30 very_long
vertical_depth shallow 2 moderate 4 deep 6 very_deep
matrix_size none 0 small 5 moderate 20 large 50 very_large
num_conditionals none 0 minimal 3 moderate 10 complex 20 very_complex
num_job_dependencies none 0 minimal 3 moderate 10 heavy 20 very_heavy
num_unique_external_actions none 0 minimal 3 moderate 8 heavy 15 very_heavy
num_marketplace_actions none 0 minimal 2 moderate 5 heavy 10 very_heavy
num_local_actions none 0 minimal 2 moderate 5 heavy
num_reusable_workflows none 0 minimal 2 moderate
avg_steps_per_job minimal 3 moderate 7 extensive 15 very_extensive
dependency_ratio independent 0 loosely_coupled 0.5 coupled 1.5 highly_coupled
external_action_diversity none 0 sparse 0.1 moderate 0.3 dense
conditional_density none 0 sparse 0.1 moderate 0.3 dense
"""


def guide(text: str = GUIDE) -> list[tuple[str, str, float | None, float | None]]:
    """(metric, label, lo, hi) of bands written as in GUIDE: each above the one before it, up to and with its own bound."""
    rows = []
    for line in text.strip().splitlines():
        metric, *cells = line.split()
        lo = None
        for label, bound in zip(cells[::2], [*cells[1::2], None]):
            hi = None if bound is None else float(bound)
            rows.append((metric, label, lo, hi))
            lo = hi
    return rows


def thresholds(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, p70, p80, p90 (interpolated), n_unique_values over all rows, from the value histogram."""
    hist = cut(value_histogram(rows.withColumn("_all", F.lit(1)), "_all", metrics))
    cuts = quantiles(hist, ["metric"], [0.7, 0.8, 0.9], others=[F.count("*").alias("n_unique_values")])
    return cuts.select("metric", *(F.col("p")[i].alias(f"p{q}") for i, q in enumerate((70, 80, 90))), "n_unique_values")


def value_band(value: Column, p70: Column, p80: Column, p90: Column) -> Column:
    """low up to p70, moderate up to p80, high up to p90, else very high; '' for null and NaN."""
    blank = value.isNull() | F.isnan(value.cast("double"))
    return F.when(blank, "").when(value <= p70, "low").when(value <= p80, "moderate").when(value <= p90, "high").otherwise("very high")


def band_distribution(rows: DataFrame, scope: str, metrics: list[str]) -> DataFrame:
    """scope, metric, band, count, percentage of the scope's values, with a row of 0 for a band without any.

    Works on the value histogram: a band is a property of a value, so rows are read once and never joined.
    """
    hist = cut(value_histogram(rows, scope, metrics))
    cuts = quantiles(hist.groupBy("metric", "value").agg(F.sum("cnt").alias("cnt")), ["metric"], [0.7, 0.8, 0.9]).select("metric", "p")
    banded = hist.join(F.broadcast(cuts), "metric")  # a row per metric
    band = value_band(F.col("value"), *(F.col("p")[i] for i in range(3)))
    counts = banded.groupBy("group", "metric").agg(*(F.sum(F.when(band == b, F.col("cnt")).otherwise(0)).alias(b) for b in BANDS))
    both = with_overall(counts, "group", ["metric"], list(BANDS))
    total = sum((F.col(b) for b in BANDS), F.lit(0))
    long = both.select("group", "metric", total.alias("total"), F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("count")) for b in BANDS))))
    return long.select(F.col("group").alias(scope), "metric", "band", "count", F.round(100.0 * F.col("count") / F.col("total"), 2).alias("percentage"))


def fixed_bands(rows: DataFrame, scope: str, bands: DataFrame) -> DataFrame:
    """scope, metric, label, count: how many values of each metric fall in each fixed band (metric, label, lo, hi].

    bands is a small table; lo null: no lower bound, hi null: no upper one. Values outside all bands
    get a null label; nulls and NaN do not count. A range join of the value histogram, which is far
    smaller than the rows.
    """
    bands = cut(bands.select("metric", "label", "lo", "hi"))
    metrics = sorted(r[0] for r in bands.select("metric").distinct().limit(10_000).collect())
    hist = value_histogram(rows, scope, [m for m in metrics if m in rows.columns])
    inside = (F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
    found = hist.join(small(bands).withColumnRenamed("metric", "_m"), (F.col("metric") == F.col("_m")) & inside, "left")
    return found.groupBy(F.col("group").alias(scope), "metric", "label").agg(F.sum("cnt").alias("count"))


def quantile_labels(rows: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """Adds `label`: the quantile class of the value, one class per label.

    Equal edges collapse; then the first labels are used, as many as classes remain. Classes hold
    their upper edge, the first one also its lower; a single edge gives the first label. Null: null.
    """
    shares = [i / len(labels) for i in range(len(labels) + 1)]
    hist = cut(value_histogram(rows.select(F.lit(1).alias("_all"), F.col(value).alias("_value")), "_all", ["_value"]))
    edges = quantiles(hist, ["metric"], shares).select(F.array_distinct("p").alias("edges"))
    uppers = "slice(edges, 2, greatest(size(edges) - 1, 1))"
    at = F.expr(f"case when {value} is null then null when size(edges) = 1 then 1 else least(size(filter({uppers}, e -> e < {value})) + 1, size(edges) - 1) end")
    names = F.array(*map(F.lit, labels))
    return rows.join(F.broadcast(edges), F.lit(True), "left").withColumn("label", F.get(names, at - 1)).drop("edges")  # one row of edges


def job_category(jobs: Column) -> Column:
    """single_job for 1, few_jobs up to 3 (also 0), else many_jobs; null for null."""
    return F.when(jobs == 1, "single_job").when(jobs <= 3, "few_jobs").when(jobs.isNotNull(), "many_jobs")


def tertiles(rows: DataFrame, value: str, tie: list[str]) -> DataFrame:
    """Adds `tertile` by rank: simple up to 1 + (n - 1) / 3, moderate up to 1 + 2 (n - 1) / 3, else complex.

    Equal values are told apart by `tie`. Rows are numbered in ranges of the order, so no task orders
    all rows, or those of a value that many share.
    """
    valued = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranked = numbered(valued, [], [F.col(value), *map(F.col, tie)], "_rank")
    n = valued.agg(F.count("*").alias("_n"))
    third = (F.col("_n") - 1) / 3.0
    label = F.when(F.col("_rank") <= 1 + third, "simple").when(F.col("_rank") <= 1 + 2 * third, "moderate").otherwise("complex")
    return ranked.crossJoin(F.broadcast(n)).withColumn("tertile", label).drop("_rank", "_n")  # one row


def band_crosstab(rows: DataFrame, group: str, band: Column, labels: tuple[str, ...] = BANDS) -> DataFrame:
    """A row per group with the percentage of each band."""
    counts = rows.groupBy(group).agg(*(F.count_if(band == b).alias(b.replace(" ", "_")) for b in labels))
    names = [b.replace(" ", "_") for b in labels]
    total = sum((F.col(b) for b in names), F.lit(0))
    return counts.select(group, *(F.round(100.0 * F.col(b) / F.nullif(total, F.lit(0)), 2).alias(b) for b in names))
