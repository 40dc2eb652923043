"""Counts per scope: each group by itself and all rows together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERALL = "Overall"


def with_overall(counts: DataFrame, scope: str, keys: list[str], sums: list[str]) -> DataFrame:
    """scope, keys, sums: the sums of `counts` per scope, and over all scopes as Overall.

    counts is aggregated by scope and keys already, so the second level costs little, and it is read
    once. Rows of a null scope count in Overall only.
    """
    both = counts.withColumn(scope, F.explode(F.array(F.lit(OVERALL), F.col(scope)))).where(F.col(scope).isNotNull())
    return both.groupBy(scope, *keys).agg(*(F.sum(s).alias(s) for s in sums))


def ranked(rows: DataFrame, scope: list[str], count: str, key: str, most: int) -> DataFrame:
    """The `most` rows of each scope with the highest count, with their rank; ties in the order of key."""
    from pyspark.sql import Window

    order = Window.partitionBy(*scope).orderBy(F.desc(count), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def pivot_first(rows: DataFrame, keys: list[str], column: str, names: list[str], value: str) -> DataFrame:
    """keys and a column for each of `names`: the least value of the rows that have this name in `column`; null without one."""
    return rows.groupBy(*keys).agg(*(F.min(F.when(F.col(column) == n, F.col(value))).alias(n) for n in names))
