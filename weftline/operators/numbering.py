"""Places of rows in an order, without any task ordering a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, small


def numbered(rows: DataFrame, keys: list[str], order: list[Column], out: str = "k") -> DataFrame:
    """`rows` with `out`: the place (from 1) of each row among those of equal `keys`, in `order`.

    Make the order total; only rows that are equal in all of `order` stay together. The rows are cut
    into ranges of keys and order and written; places are counted inside the ranges and over their
    sizes, so a key that holds a third of all rows is spread over many tasks. Null keys are a group.
    """
    spark = rows.sparkSession
    by = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)] + [o.alias(f"_at{i}") for i, o in enumerate(order)]
    names = [f"_key{i}" for i in range(len(keys))], [f"_at{i}" for i in range(len(order))]
    wide = rows.select(F.struct(*(F.col(c) for c in rows.columns)).alias("_row"), *by)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = cut(wide.repartitionByRange(parts, *names[0], *names[1]).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range", *names[0]).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(names[0] or [F.lit(1)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range, and per key and range where keys are many
    offsets = cut(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_range").alias("_r"), *(F.col(n).alias(f"{n}_") for n in names[0]), "_before"))
    within = Window.partitionBy("_range", *names[0]).orderBy(*names[1])
    placed = ranged.withColumn("_k", F.row_number().over(within))
    same = [F.col("_range") == F.col("_r"), *(F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names[0])]
    return placed.join(small(offsets), same).select("_row.*", (F.col("_k") + F.col("_before")).alias(out))
