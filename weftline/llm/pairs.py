"""Items that appear together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.labels import workflows
from weftline.session import cut, small

#: Items of one basket from which on it is cut into chunks of this many.
CHUNK = 256


def cooccurrence(baskets: DataFrame, items: str, chunk: int = CHUNK, min_rows: int = 1, min_share: tuple[int, int] = (0, 1)) -> DataFrame:
    """How often two different items share a basket, against chance.

    baskets: one row per basket with an array of items; repeated items of a basket count once, null
    items do not count, and a basket without items is none. Result: item_a < item_b, c baskets with
    both, a and b baskets with either, n baskets, lift = c * n / (a * b), and npmi, the pointwise
    mutual information divided by -log(c / n) (1 where both are in every basket). Every pair that at
    least `min_rows` baskets and min_share[0] of min_share[1] of them hold comes out; an item that
    fewer hold cannot be part of one and is left out before pairs are formed.

    Baskets of up to `chunk` items give their pairs in place. A larger one is cut into chunks, rows of
    their own; the keys of its pairs of chunks are dealt to all tasks and meet their two chunks there,
    so no task meets more than chunk * chunk pairs of a basket at a time. Equal baskets are merged
    with a count first, and pair counts shrink before the shuffle. No basket is cut short.
    """
    held = baskets.select(F.expr(f"array_sort(array_distinct(filter({items}, x -> x is not null)))").alias("items")).where("size(items) > 0")
    held = cut(held.groupBy("items").agg(F.count("*").alias("w")))
    total = held.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"))
    enough = f"{{0}} >= {min_rows} and {{0}} * {min_share[1]} >= {min_share[0]} * n"
    single = held.select("w", F.explode("items").alias("item")).groupBy("item").agg(F.sum("w").alias("n_item"))
    single = cut(single.crossJoin(F.broadcast(total)))  # one row
    if min_rows > 1 or min_share[0]:
        rare = small(single.where(f"not ({enough.format('n_item')})").select("item"))
        rest = held.withColumn("id", F.monotonically_increasing_id()).select("id", "w", F.explode("items").alias("item")).join(rare, "item", "left_anti") if not rare.isEmpty() else None
        if rest is not None:
            held = cut(rest.groupBy("id", "w").agg(F.array_sort(F.collect_list("item")).alias("items")).groupBy("items").agg(F.sum("w").alias("w")))
    inner = "flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> struct(x as item_a, y as item_b))))"
    pairs = held.where(F.size("items") <= chunk).select("w", F.explode(F.expr(inner)).alias("pair"))
    large = held.where(F.size("items") > chunk)
    if not large.isEmpty():
        numbered = large.withColumn("basket", F.monotonically_increasing_id()).withColumn("chunks", F.expr(f"transform(sequence(0, (size(items) - 1) div {chunk}), k -> slice(items, k * {chunk} + 1, {chunk}))"))
        chunks = cut(numbered.select("basket", "w", F.posexplode("chunks").alias("k", "own"), F.size("chunks").alias("of")))
        # ordered items: every item of an earlier chunk comes before those of a later one
        keys = chunks.select("basket", "w", "k", F.explode(F.expr("sequence(k, of - 1)")).alias("m"))
        keys = keys.repartition(F.xxhash64("basket", "k", "m"))
        two = keys.join(chunks.select("basket", "k", "own"), ["basket", "k"]).join(chunks.select("basket", F.col("k").alias("m"), F.col("own").alias("other")), ["basket", "m"])
        cross = "flatten(transform(own, x -> transform(filter(other, y -> m > k or x < y), y -> struct(x as item_a, y as item_b))))"
        pairs = pairs.unionByName(two.select("w", F.explode(F.expr(cross)).alias("pair")))
    counted = pairs.groupBy("pair").agg(F.sum("w").alias("c")).select("pair.*", "c")
    sizes = small(single)
    return (
        counted.join(sizes.select(F.col("item").alias("item_a"), F.col("n_item").alias("a"), "n"), "item_a")
        .join(sizes.select(F.col("item").alias("item_b"), F.col("n_item").alias("b")), "item_b")
        .where(enough.format("c"))
        .withColumn("lift", F.col("c") * F.col("n") / (F.col("a").cast("double") * F.col("b")))
        .withColumn("npmi", F.expr("case when c = n then 1.0d else ln(lift) / -ln(c / n) end"))
        .select("item_a", "item_b", "c", "a", "b", "n", "lift", "npmi")
    )


def _pairs(spark: SparkSession, folder: str, **least) -> DataFrame:
    found = cooccurrence(workflows(spark, folder).select("labels"), "labels", **least)
    return found.select(
        F.col("item_a").alias("step_a"), F.col("item_b").alias("step_b"), "c", "a", "b", "n", F.round("lift", 6).alias("lift"), F.round("npmi", 6).alias("npmi")
    )


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """step_a, step_b, c, a, b, n, lift, npmi of every pair of steps."""
    return _pairs(spark, folder)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """step_a, step_b of the pairs that occur together often and far more often than by chance."""
    return _pairs(spark, folder, min_rows=5, min_share=(4, 1000)).where("c * n >= 3 * a * b").select("step_a", "step_b")
