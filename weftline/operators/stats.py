"""Rank tests, tests of proportions, effect sizes and densities, from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numbers import chi_tail, exact_u, p_text, two_sided
from weftline.operators.histogram import quantiles, running
from weftline.session import cut, small


def delta_band(delta: Column) -> Column:
    """negligible below 0.147, small below 0.33, medium below 0.474, else large."""
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").when(d.isNotNull(), "large")


def h_band(h: Column) -> Column:
    """negligible below 0.2, small below 0.5, medium below 0.8, else large."""
    d = F.abs(h)
    return F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").when(d.isNotNull(), "large")


def kruskal_wallis(hist: DataFrame) -> DataFrame:
    """metric, groups, n, h (tie-corrected), p_value, significant.

    hist: group, metric, value, cnt. Metrics with fewer than three groups give no row; without any
    two different values h is null.
    """
    hist = cut(hist)
    pooled = hist.groupBy("metric", "value").agg(F.sum("cnt").alias("cnt"))
    ranks = running(pooled, ["metric"]).select("metric", "value", (F.col("before") + (F.col("cnt") + 1) / 2.0).alias("rank"), F.col("cnt").alias("t"))
    ties = ranks.groupBy("metric").agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = hist.join(ranks, ["metric", "value"]).groupBy("metric", "group").agg(F.sum("cnt").alias("n_i"), F.sum(F.col("cnt") * F.col("rank")).alias("r_i"))
    per = sums.groupBy("metric").agg(F.count("*").alias("groups"), F.sum("n_i").alias("n"), F.sum(F.col("r_i") * F.col("r_i") / F.col("n_i")).alias("s"))
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    correction = 1 - F.col("ties") / F.nullif(F.pow(n, F.lit(3)) - n, F.lit(0.0))
    tested = per.join(ties, "metric").where("groups > 2").withColumn("h", raw / F.nullif(correction, F.lit(0.0)))
    p = F.when(F.col("groups") == 3, F.exp(-F.col("h") / 2)).otherwise(chi_tail(F.col("h"), F.col("groups") - 1))
    return tested.select("metric", "groups", "n", F.round("h", 3).alias("h"), p.alias("p_value"), (p < 0.05).alias("significant"))


def mann_whitney(hist: DataFrame) -> DataFrame:
    """metric, group_1, group_2, n1, n2, median1, median2, median_diff, u, z, delta, effect, p_value, p_formatted, for each pair of groups.

    Two-sided, with tie and continuity correction; where a group has at most eight values and no two
    values are equal, p comes from the exact distribution (if n1 * n2 is at most a million). delta is
    Cliff's, exact from u. z and p are null where all values are equal.
    """
    hist = cut(hist)
    sized = cut(quantiles(hist, ["metric", "group"], [0.5]).select("metric", "group", "n", F.col("p")[0].alias("median")))
    a, b = (sized.select("metric", F.col("group").alias(f"group_{i}"), F.col("n").alias(f"n{i}"), F.col("median").alias(f"median{i}")) for i in (1, 2))
    pairs = a.join(b, "metric").where("group_1 < group_2")
    pair_keys = ["metric", "group_1", "group_2"]
    member = pairs.select(*pair_keys, F.explode(F.array("group_1", "group_2")).alias("group"))
    both = hist.join(small(member), ["metric", "group"])  # a row per metric and pair of groups
    first = F.when(F.col("group") == F.col("group_1"), F.col("cnt")).otherwise(0)
    pooled = both.groupBy(*pair_keys, "value").agg(F.sum("cnt").alias("cnt"), F.sum(first).alias("c1"))
    ranked = running(pooled, pair_keys)
    r1 = F.sum(F.col("c1") * (F.col("before") + (F.col("cnt") + 1) / 2.0)).alias("r1")
    sums = ranked.groupBy(*pair_keys).agg(r1, F.sum(F.pow("cnt", F.lit(3)) - F.col("cnt")).alias("ties"))
    out = pairs.join(sums, pair_keys)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = out.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    high = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    out = out.withColumn("z", (high - n1 * n2 / 2 - 0.5) / F.nullif(sigma, F.lit(0.0))).withColumn("delta", 2 * F.col("u") / (n1 * n2) - 1)
    few = (F.least("n1", "n2") <= 8) & (F.col("ties") == 0)
    exact = exact_u(F.when(few, F.col("u")), F.col("n1"), F.col("n2"))
    out = out.withColumn("p_value", F.coalesce(exact, two_sided(F.greatest(F.col("z"), F.lit(0.0)))))
    return out.select(
        *pair_keys, "n1", "n2", "median1", "median2", (F.col("median1") - F.col("median2")).alias("median_diff"), "u", F.round("z", 6).alias("z"), F.round("delta", 6).alias("delta"), delta_band(F.col("delta")).alias("effect"), "p_value", p_text(F.col("p_value")).alias("p_formatted")
    )


def contingency(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """feature, group, yes, no; nulls count as no, null groups are left out."""
    counts = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), *(F.count_if(F.col(f).cast("boolean")).alias(f) for f in features))
    long = counts.select("group", "n", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("yes")) for f in features))))
    return long.select("feature", "group", "yes", (F.col("n") - F.col("yes")).alias("no"))


def chi_square(table: DataFrame) -> DataFrame:
    """feature, groups, statistic, p_value, note, from feature, group, yes, no.

    Two groups get the continuity correction. Without variation the statistic is 0 and p 1; with an
    expected count below 5 the statistic is 0, p null, and the note says so.
    """
    of_feature = Window.partitionBy("feature")  # a row per group
    table = table.select("*", F.sum("yes").over(of_feature).alias("all_yes"), F.sum("no").over(of_feature).alias("all_no"), F.count("*").over(of_feature).alias("groups"))
    n = F.col("yes") + F.col("no")
    whole = (F.col("all_yes") + F.col("all_no")).cast("double")
    e1, e0 = n * F.col("all_yes") / whole, n * F.col("all_no") / whole

    def part(seen: Column, expected: Column) -> Column:
        off = F.abs(seen - expected)
        off = F.when(F.col("groups") == 2, off - F.least(off, F.lit(0.5))).otherwise(off)
        return F.pow(off, F.lit(2)) / F.nullif(expected, F.lit(0.0))

    both = part(F.col("yes"), e1) + part(F.col("no"), e0)
    out = table.groupBy("feature", "groups").agg(F.sum(both).alias("x"), F.min(F.least(e1, e0)).alias("least"), F.first("all_yes").alias("y"), F.first("all_no").alias("z"))
    flat, thin = (F.col("y") == 0) | (F.col("z") == 0), F.col("least") < 5
    statistic = F.when(flat | thin, 0.0).otherwise(F.round("x", 4))
    tail = F.when(F.col("groups") == 3, F.exp(-F.col("x") / 2)).otherwise(chi_tail(F.col("x"), F.col("groups") - 1))
    p = F.when(flat, 1.0).when(thin, None).otherwise(F.round(tail, 8))
    note = F.when(flat, "no variation").when(thin, "expected count below 5")
    return out.select("feature", "groups", statistic.alias("statistic"), p.alias("p_value"), note.alias("note"))


def fisher_p(y1: int, n1: int, y2: int, n2: int) -> float:
    """The two-sided exact p-value of a table of two groups with y1, y2 times yes and n1, n2 times no."""
    import math

    import numpy as np

    row, column, whole = y1 + n1, y1 + y2, y1 + n1 + y2 + n2
    low, high = max(0, column - (y2 + n2)), min(row, column)
    gamma = lambda x: math.lgamma(x + 1)
    fixed = gamma(row) + gamma(whole - row) + gamma(column) + gamma(whole - column) - gamma(whole)
    log = lambda k: fixed - gamma(k) - gamma(row - k) - gamma(column - k) - gamma(whole - row - column + k)
    seen = log(y1) + 1e-7
    mode = min(high, max(low, (row + 1) * (column + 1) // (whole + 2)))

    def edge(near: int, far: int) -> int | None:
        """The place between near and far (the end of a tail) that is nearest and no more likely than what was seen."""
        if log(far) > seen:
            return None
        while abs(far - near) > 1:
            middle = (near + far) // 2
            near, far = (middle, far) if log(middle) > seen else (near, middle)
        return near if log(near) <= seen else far

    def tail(first: int | None, last: int, step: int) -> float:
        total, base = 0.0, None if first is None else log(first)
        while base is not None:
            k = first + step * np.arange(min(10_000, abs(last - first)), dtype=np.float64)
            up, down = (row - k) * (column - k), (k + 1) * (whole - row - column + k + 1)
            ratio = up / down if step > 0 else (k * (whole - row - column + k)) / ((row - k + 1) * (column - k + 1))
            logs = base + np.r_[0.0, np.cumsum(np.log(ratio))]
            total += float(np.exp(logs[:-1]).sum())
            if len(k) == 0 or first + step * len(k) == last or math.exp(logs[-1]) < 1e-18 * total:
                return total + math.exp(logs[-1])
            first, base = first + step * len(k), float(logs[-1])
        return total

    below, above = edge(mode, low), edge(mode, high)
    if below is not None and below == above:  # nothing is more likely
        return 1.0
    return min(1.0, tail(below, low, -1) + tail(above, high, 1))


def fisher(table: DataFrame) -> DataFrame:
    """feature, group_1, group_2, p_value (two-sided, exact), prop1_pct, prop2_pct, h (Cohen's), effect, per pair of groups.

    Pairs without any yes or any no are left out. Of the tables with the same margins those no more
    likely than the observed one lie in two tails; each is summed outwards until its terms vanish, so
    the cost follows the root of the counts.
    """
    a, b = (table.select("feature", F.col("group").alias(f"group_{i}"), F.col("yes").alias(f"y{i}"), F.col("no").alias(f"n{i}")) for i in (1, 2))
    pairs = a.join(b, "feature").where("group_1 < group_2 and y1 + y2 > 0 and n1 + n2 > 0")

    @F.pandas_udf("double")
    def exact(y1, n1, y2, n2):
        import pandas as pd

        return pd.Series([fisher_p(*map(int, v)) for v in zip(y1, n1, y2, n2)])

    p1, p2 = F.col("y1") / (F.col("y1") + F.col("n1")), F.col("y2") / (F.col("y2") + F.col("n2"))
    h = 2 * (F.asin(F.sqrt(p1)) - F.asin(F.sqrt(p2)))
    return pairs.select("feature", "group_1", "group_2", F.round(exact("y1", "n1", "y2", "n2"), 8).alias("p_value"), F.round(100 * p1, 2).alias("prop1_pct"), F.round(100 * p2, 2).alias("prop2_pct"), F.round(h, 6).alias("h"), h_band(h).alias("effect"))


def kde_log1p(hist: DataFrame, points: int = 400, least: int = 10) -> DataFrame:
    """group, x, density: a Gaussian density (Scott's width) of log(1 + value) on a grid over all groups.

    hist: group, value, cnt of values from 0 on. Groups of fewer than `least` values or without
    spread give no rows. Each distinct value meets the grid inside its task and only grid sums are shuffled.
    """
    logged = cut(hist.where("value >= 0").withColumn("v", F.log1p("value")))
    means = logged.groupBy("group").agg(F.sum("cnt").alias("n"), (F.sum(F.col("v") * F.col("cnt")) / F.sum("cnt")).alias("mean"))
    squares = F.sum(F.pow(F.col("v") - F.col("mean"), F.lit(2)) * F.col("cnt"))
    spread = logged.join(means, "group").groupBy("group", "n").agg(squares.alias("s2")).withColumn("sd", F.sqrt(F.col("s2") / F.nullif(F.col("n") - 1, F.lit(0)))).where(f"n >= {least} and sd > 0")
    width = spread.withColumn("width", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    top = logged.agg(F.max("v").alias("top"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.col("top") / (points - 1))
    placed = logged.join(small(cut(width.select("group", "n", "width"))), "group").crossJoin(F.broadcast(top))  # a row per group; one row
    long = placed.select("group", "n", "width", "v", "cnt", F.posexplode(grid).alias("i", "x"))
    kernel = F.col("cnt") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("width"), F.lit(2))) / (F.col("n") * F.col("width") * 2.5066282746310002)
    return long.groupBy("group", "i").agg(F.first("x").alias("x"), F.sum(kernel).alias("density")).select("group", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))
