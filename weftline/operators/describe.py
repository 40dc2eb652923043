"""Descriptive statistics per scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.histogram import quantiles, value_histogram
from weftline.operators.scopes import with_overall
from weftline.session import cut


def descriptives(rows: DataFrame, scope: str, metrics: list[str]) -> DataFrame:
    """scope, metric, n, mean, median, std, min, p70, p80, p90, max, iqr, cv (0 where the mean is 0).

    Every figure comes from the value histogram; the deviation from squares around the mean, so large
    values with little spread keep their digits. std is null for a single value.
    """
    hist = cut(with_overall(value_histogram(rows, scope, metrics), "group", ["metric", "value"], ["cnt"]))
    keys = ["group", "metric"]
    figures = quantiles(hist, keys, [0.25, 0.5, 0.7, 0.75, 0.8, 0.9], others=[F.sum(F.col("value") * F.col("cnt")).alias("s1"), F.min("value").alias("min"), F.max("value").alias("max")])
    figures = figures.withColumn("avg", F.col("s1") / F.col("n"))
    squares = hist.join(figures.select(*keys, "avg"), keys).groupBy(*keys).agg(F.sum(F.pow(F.col("value") - F.col("avg"), F.lit(2)) * F.col("cnt")).alias("s2"))
    figures = figures.join(squares, keys)
    mean = F.col("avg")
    std = F.when(F.col("n") > 1, F.sqrt(F.col("s2") / (F.col("n") - 1.0)))
    p = {q: F.col("p")[i] for i, q in enumerate((25, 50, 70, 75, 80, 90))}
    shown = {"mean": mean, "median": p[50], "std": std, "min": F.col("min"), "p70": p[70], "p80": p[80], "p90": p[90], "max": F.col("max"), "iqr": p[75] - p[25], "cv": F.when(mean == 0, 0.0).otherwise(std / F.nullif(mean, F.lit(0.0)))}
    return figures.select(F.col("group").alias(scope), "metric", "n", *(F.round(c, 4).alias(k) for k, c in shown.items()))


def binary_stats(rows: DataFrame, scope: str, features: list[str]) -> DataFrame:
    """scope, feature, count, total, proportion, percentage of boolean or 0/1 features; nulls count as no."""
    hits = [F.count_if(F.col(f).cast("boolean")).alias(f) for f in features]
    counts = with_overall(rows.groupBy(scope).agg(F.count("*").alias("total"), *hits), scope, [], ["total", *features])
    long = counts.select(scope, "total", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("count")) for f in features))))
    return long.select(scope, "feature", "count", "total", F.round(F.col("count") / F.col("total"), 3).alias("proportion"), F.round(100.0 * F.col("count") / F.col("total"), 1).alias("percentage"))
