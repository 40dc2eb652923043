"""Frequent subsequences across many sequences."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.labels import workflows
from weftline.llm.pattern_tree import PatternTree
from weftline.session import cut, small

#: Different sequences of a scope that one task merges into a tree.
TREE = 50_000


def _code(i: int) -> str:
    """The i-th character that stands for a label; surrogates are passed over."""
    return chr(0x100 + i if i < 0xD700 else 0x900 + i)


def _tree(frame: pd.DataFrame) -> tuple[PatternTree, dict[str, str], list[str]]:
    """The tree of sequences (labels) with counts (n), the character of each label, and the labels in that order."""
    names = sorted({x for labels in frame["labels"] for x in labels})
    code = {x: _code(i) for i, x in enumerate(names)}
    counts: dict[str, int] = {}
    for labels, n in zip(frame["labels"], frame["n"]):
        key = "".join([code[x] for x in labels])
        counts[key] = counts.get(key, 0) + int(n)
    return PatternTree(counts), code, names


def _found(patterns: list[tuple[list[str], int]], scope: str | None = None, **more) -> pd.DataFrame:
    n = len(patterns)
    columns = {"scope": pd.Series([scope] * n, dtype=object), **{k: [v] * n for k, v in more.items()}}
    return pd.DataFrame({**columns, "pattern": pd.Series([p for p, _ in patterns], dtype=object), "n": pd.Series([c for _, c in patterns], dtype="int64")})


def _mined(longest: int, shortest: int, different: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def mined(frame: pd.DataFrame) -> pd.DataFrame:
        tree, code, names = _tree(frame)
        name = {code[x]: x for x in names}
        least, total, held = int(frame["least"].iloc[0]), int(frame["total"].iloc[0]), int(tree.count[0])
        # what is frequent in the scope is so, in proportion, in one of its trees
        floor = max(1, -(-least * held // total))
        found = [(p, n) for p, n in tree.mine(lambda _, n: n >= floor, longest, different) if len(p) >= shortest]
        return _found([([name[c] for c in p], n) for p, n in found], scope=frame["scope"].iloc[0], part=frame["part"].iloc[0])

    return mined


def _counted(longest: int, different: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def counted(frame: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if frame.empty or asked.empty:
            return _found([])
        tree, code, names = _tree(frame)
        name = {code[x]: x for x in names}
        wanted = {"".join([code[x] for x in p]) for p in asked["pattern"] if all(x in code for x in p)}
        inside = {p[:i] for p in wanted for i in range(1, len(p) + 1)}
        found = [(p, n) for p, n in tree.mine(lambda p, _: p in inside, longest, different) if p in wanted]
        return _found([([name[c] for c in p], n) for p, n in found], scope=frame["scope"].iloc[0])

    return counted


def frequent_patterns(
    sequences: DataFrame,
    scope: str,
    labels: str,
    min_rows: int = 5,
    min_share: tuple[int, int] = (8, 100),
    lengths: tuple[int, int] = (3, 4),
    different: bool = True,
    tree: int = TREE,
) -> DataFrame:
    """Ordered patterns, gaps allowed, held by many sequences: scope, pattern (array), support, total.

    sequences: one row per sequence with a scope and an array of labels. A pattern comes out if at
    least `min_rows` sequences and at least min_share[0] of min_share[1] of the scope's sequences
    hold it; with `different`, no label comes twice in it. A sequence counts once per pattern.

    Equal sequences are merged into one row with a count before anything else, so a hot scope or a
    sequence that many entities share costs no more than another. Labels that are rare in a scope
    cannot be part of a pattern and go first. A scope of up to `tree` different sequences becomes one
    position-coded tree, whose supports are exact. A larger one is dealt by a hash into parts of about
    that many, each mined with its share of the scope's threshold: what is frequent in the scope is so
    in one of its parts at least, and as parts are large, little else is. These candidates are then
    counted exactly in the trees of all parts of their scope. Nothing but counts of rows reaches the driver.

    Null scopes, null and empty arrays, and null labels are left out; a sequence of null labels only
    still counts in its scope's total. An empty input gives no rows.
    """
    share_of, share_in = min_share
    rows = sequences.select(F.col(scope).alias("scope"), F.col(labels).alias("labels"))
    rows = rows.where("scope is not null and size(labels) > 0")
    merged = cut(rows.withColumn("labels", F.expr("filter(labels, x -> x is not null)")).groupBy("scope", "labels").agg(F.count("*").alias("n")))
    least = F.expr(f"greatest({min_rows}L, ({share_of} * sum(n) + {share_in - 1}) div {share_in})")
    totals = cut(merged.groupBy("scope").agg(F.sum("n").alias("total"), least.alias("least")))
    held = merged.select("scope", "n", F.explode(F.array_distinct("labels")).alias("label")).groupBy("scope", "label").agg(F.sum("n").alias("n"))
    held = held.join(small(totals), "scope").where("n >= least")
    # at most (labels of a sequence) / share labels are frequent in a scope
    frequent = cut(held.groupBy("scope", "total", "least").agg(F.sort_array(F.collect_list("label")).alias("frequent")))
    pruned = cut(
        merged.join(small(frequent), "scope")
        .select("scope", F.expr("filter(labels, x -> array_contains(frequent, x))").alias("labels"), "n", "total", "least")
        .where(F.size("labels") >= lengths[0])
        .groupBy("scope", "labels", "total", "least")
        .agg(F.sum("n").alias("n"))
    )
    sizes = cut(pruned.groupBy("scope").agg(F.ceil(F.count("*") / tree).cast("int").alias("parts")))
    dealt = pruned.join(small(sizes), "scope").withColumn("part", F.pmod(F.xxhash64("labels"), F.col("parts")).cast("int"))
    mined = dealt.groupBy("scope", "part").applyInPandas(_mined(lengths[1], lengths[0], different), "scope string, part int, pattern array<string>, n bigint")
    mined = cut(mined.join(small(sizes), "scope"))
    whole = mined.where("parts = 1").select("scope", "pattern", F.col("n").alias("support"))
    several = dealt.where("parts > 1")
    asked = mined.where("parts > 1").select("scope", "pattern", "parts").distinct().select("scope", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "pattern")
    counted = several.groupBy("scope", "part").cogroup(asked.groupBy("scope", "part")).applyInPandas(_counted(lengths[1], different), "scope string, pattern array<string>, n bigint")
    summed = counted.groupBy("scope", "pattern").agg(F.sum("n").alias("support"))
    return whole.unionByName(summed).join(small(totals), "scope").where("support >= least").select("scope", "pattern", "support", "total")


def p1_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """language, pattern, workflows, share: the frequent patterns of each language with their support."""
    found = frequent_patterns(workflows(spark, folder), "language", "labels")
    return found.select(
        F.col("scope").alias("language"),
        F.array_join("pattern", " → ").alias("pattern"),
        F.col("support").alias("workflows"),
        F.round(F.col("support") / F.col("total"), 6).alias("share"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """language, pattern."""
    return p1_patterns(spark, folder).select("language", "pattern")
