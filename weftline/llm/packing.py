"""Filling fixed-capacity containers with items."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.tokens import encode_corpus, vocabulary
from weftline.session import cut, spread
from weftline.sources.tables import table

#: Largest capacity, and so most different sizes, for which the driver plans.
MAX_CAPACITY = 1_000_000
#: Items of one size that one task numbers.
BUCKET = 200_000


def plan(capacity: int, histogram: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """How many items of which size share a bin: rows (size, first item, items, first bin, items a bin), and the number of bins.

    Works on the number of items of each size, so its cost follows the capacity, not the items. Sizes
    above a third of the capacity pair first, largest first, each with the largest that still fits:
    at most two of them fit any bin that also serves smaller ones. Then each smaller size, largest
    first, goes to the bins whose gap it leaves smallest. Bins that are filled alike form one group.
    """
    left = {s: n for s, n in sorted(histogram.items()) if n > 0}
    groups: dict[int, list] = {}  # id -> [bins, gap, {size: items a bin}]
    gaps: list[tuple[int, int]] = []  # (gap, id) in order

    def open_bins(bins: int, content: dict[int, int]) -> None:
        gap = capacity - sum(s * n for s, n in content.items())
        groups[len(groups)] = [bins, gap, content]
        insort(gaps, (gap, len(groups) - 1))

    large = [s for s in left if 3 * s > capacity]
    while large:
        s = large[-1]
        n = left[s]
        at = bisect_left(large, capacity - s + 1) - 1
        if at < 0:
            open_bins(n, {s: 1})
            large.pop()
            continue
        t = large[at]
        if t == s:
            if n > 1:
                open_bins(n // 2, {s: 2})
            left[s] = n % 2
            if not left[s]:
                large.pop()
            elif at == 0:
                open_bins(1, {s: 1})
                large.pop()
            else:
                t = large[at - 1]
        if t != s:
            both = min(left[s], left[t])
            open_bins(both, {s: 1, t: 1})
            for x in (s, t):
                left[x] -= both
                if not left[x]:
                    large.pop(bisect_left(large, x))
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(gaps, (s, -1))
            if at == len(gaps):
                fit = capacity // s
                if n >= fit:
                    open_bins(n // fit, {s: fit})
                if n % fit:
                    open_bins(1, {s: n % fit})
                break
            gap, g = gaps.pop(at)
            bins, _, content = groups[g]
            # a round gives each bin of the group one item; all rounds that fit are taken at once
            rounds = min(gap // s, n // bins)
            if not rounds:
                groups[g][0] = bins - n
                insort(gaps, (gap, g))
                open_bins(n, {**content, s: content.get(s, 0) + 1})
                break
            content[s] = content.get(s, 0) + rounds
            groups[g][1] = gap - rounds * s
            insort(gaps, (groups[g][1], g))
            n -= rounds * bins
    used: dict[int, int] = {}
    rows, first_bin = [], 0
    for bins, _, content in groups.values():
        for s, a_bin in sorted(content.items()):
            rows.append((s, used.get(s, 0), bins * a_bin, first_bin, a_bin))
            used[s] = used.get(s, 0) + bins * a_bin
        first_bin += bins
    return rows, first_bin


def pack(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """Items in bins of `capacity`: bin_id, item, piece, first, tokens.

    An item larger than the capacity is cut into full bins and a rest, pieces 0, 1, ... beginning at
    `first`; no other is cut. An item of size 0 takes no room and joins any bin (bin 0 if there is
    none). Null sizes count as 0. Repeated rows are items of their own. Every item comes out, and no
    bin is filled beyond the capacity. bin_id has no gaps.

    `items` is read three times, so it should be a written table. Only the number of items per size (at
    most `capacity` of them) reaches the driver, where plan() decides how many bins get which sizes.
    Each item then finds its bin from its number among the items of its size; these are numbered in
    buckets by a hash, so that no size, however common, is sorted in one task.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be between 1 and {MAX_CAPACITY}")
    sized = items.select(F.col(item).alias("item"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint").alias("whole"))
    cutting = f"transform(sequence(0L, greatest(whole - 1, 0L) div {capacity}), k -> struct(k as piece, k * {capacity} as first, least({capacity}, whole - k * {capacity}) as tokens))"
    parts = sized.select("item", F.explode(F.expr(cutting)).alias("p")).select("item", "p.*")
    histogram = {r["tokens"]: r["n"] for r in parts.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    rows, bins = plan(capacity, {s: n for s, n in histogram.items() if s > 0})
    buckets = max(1, -(-max(histogram.values(), default=0) // BUCKET))
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)))
    within = Window.partitionBy("tokens", "bucket").orderBy("item", "piece")
    before = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("tokens", "bucket").agg(F.count("*").alias("n")).select("tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, ["tokens", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))
    rows.sort()
    shift = 1 << 42
    starts = np.array([s * shift + first for s, first, *_ in rows], np.int64)
    firsts, bin0, a_bin = (np.array([r[i] for r in rows], np.int64) for i in (1, 3, 4))

    @F.pandas_udf("bigint")
    def placed(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        s, r = sizes.to_numpy(np.int64), ranks.to_numpy(np.int64)
        out = r % max(1, bins)
        full = s > 0
        if full.any():
            at = np.searchsorted(starts, s[full] * shift + r[full], "right") - 1
            out[full] = bin0[at] + (r[full] - firsts[at]) // a_bin[at]
        return pd.Series(out)

    return ranked.select(placed("tokens", "rank").alias("bin_id"), F.col("item").alias(item), F.col("piece").cast("int").alias("piece"), "first", "tokens")


def p9_bins(spark: SparkSession, folder: str) -> DataFrame:
    """max_tokens, bin_id, doc_id, piece, first_token, tokens, for each capacity of size_limits."""
    limits = table(spark, folder, "size_limits").where("purpose = 'pack' and max_tokens > 0").select("tokenizer", "max_tokens").distinct().limit(1001).collect()
    if len(limits) > 1000:
        raise ValueError("size_limits has more than 1000 capacities")
    done, sizes = None, {}
    for name, capacity in sorted(map(tuple, limits)):
        if name not in sizes:
            sizes[name] = cut(encode_corpus(spread(table(spark, folder, "documents").select("doc_id", "text")), path=vocabulary(name), counted=True))
        bins = pack(sizes[name], "doc_id", "ids", capacity).select(F.lit(capacity).alias("max_tokens"), "bin_id", "doc_id", "piece", F.col("first").alias("first_token"), "tokens")
        done = bins if done is None else done.unionByName(bins)
    return spark.createDataFrame([], "max_tokens int, bin_id bigint, doc_id bigint, piece int, first_token bigint, tokens bigint") if done is None else done
