"""Value histograms: the one shuffle of raw rows that quantiles, rank tests and densities share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numbers import magnitude


def value_histogram(rows: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """group, metric, value, cnt: how often each value of each metric occurs in each group.

    Nulls and NaN do not count. Counts are formed before the shuffle.
    """
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    long = rows.select(F.col(group).alias("group"), F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))
    return long.where("value is not null and not isnan(value)").groupBy("group", "metric", "value").agg(F.count("*").alias("cnt"))


def running(hist: DataFrame, keys: list[str], count: str = "cnt", out: str = "before") -> DataFrame:
    """Adds how many counts of the same keys lie at smaller values.

    Sums run inside buckets of values of like magnitude and over the buckets' totals, so that no
    task orders all distinct values of a key.
    """
    placed = hist.withColumn("bucket", magnitude(F.col("value")))
    inside = Window.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "bucket").agg(F.sum(count).alias("total"))
    totals = totals.select(*keys, "bucket", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    summed = placed.withColumn("inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return summed.join(totals, [*keys, "bucket"]).withColumn(out, F.col("inside") + F.col("ahead")).drop("inside", "ahead", "bucket")


def quantiles(hist: DataFrame, keys: list[str], shares: list[float], out: str = "p", others: list[Column] = []) -> DataFrame:  # noqa: B006
    """keys, n, `out` (array): the interpolated quantiles of each key's values, and `others`, aggregates over value and cnt.

    The quantile of share s lies at place s * (n - 1) of the ordered values, counted from 0, between
    its two neighbours. Places come from running(), so no task holds the values of a key; what is
    picked are two values per share and key.
    """
    total = hist.groupBy(*keys).agg(F.sum("cnt").alias("n"), *others)
    placed = running(hist, keys).join(total.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("n").alias("_n")), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    at = {i: F.lit(float(s)) * (F.col("_n") - 1) for i, s in enumerate(shares)}
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("cnt"))
    picked = placed.groupBy(*keys).agg(
        F.first("_n").alias("_n"),
        *(F.max(F.when(holds(F.floor(a)), F.col("value"))).alias(f"_lo{i}") for i, a in at.items()),
        *(F.max(F.when(holds(F.ceil(a)), F.col("value"))).alias(f"_hi{i}") for i, a in at.items()),
    )
    between = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (a - F.floor(a)) for i, a in at.items()]
    # equal neighbours, infinite ones among them, need no arithmetic
    shown = [F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(b) for i, b in enumerate(between)]
    found = picked.select(*(F.col(k).alias(f"_{k}") for k in keys), F.array(*shown).alias(out))
    return total.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))
