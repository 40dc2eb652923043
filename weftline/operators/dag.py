"""Longest chains in many small graphs at once."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, small

#: Edges up to which a graph is solved by one task.
ONE_TASK = 100_000


def longest_path(edges: Iterable[tuple]) -> int | None:
    """The number of nodes on the longest path of a graph, null if it has a cycle; nodes are done once all edges to them are."""
    after: dict = {}
    waits: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        waits[b] = waits.get(b, 0) + 1
        waits.setdefault(a, 0)
    depth = {n: 1 for n, w in waits.items() if not w}
    ready = list(depth)
    deepest = 0
    while ready:
        n = ready.pop()
        deepest = max(deepest, depth[n])
        for x in after.get(n, ()):
            depth[x] = max(depth.get(x, 0), depth[n] + 1)
            waits[x] -= 1
            if not waits[x]:
                ready.append(x)
    return None if any(waits.values()) else deepest


def _contracted(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, a, b, w): the edges of g, a, b with every stretch of nodes that have one edge in and one out as one edge of w steps; g of the graphs with a ring of such nodes.

    Each of these nodes points ahead, and all pointers double their reach until they end at another
    kind of node; one that reaches farther than its graph has such nodes runs in a ring.
    """
    once = lambda c: links.groupBy("g", F.col(c).alias("n")).count().where("count = 1").select("g", "n")
    inner = cut(once("a").join(once("b"), ["g", "n"]))
    inside = inner.withColumn("inside", F.lit(True))
    number = inner.groupBy("g").agg(F.count("*").alias("k"))
    ahead = links.withColumnRenamed("a", "n").join(inner, ["g", "n"]).join(inside.withColumnRenamed("n", "b"), ["g", "b"], "left").join(number, "g")
    ahead = cut(ahead.select("g", "n", F.col("b").alias("to"), F.lit(1).cast("bigint").alias("w"), F.col("inside").isNull().alias("over"), "k"))
    while not ahead.where("not over and w <= k").isEmpty():
        other = ahead.select("g", F.col("n").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"), F.col("over").alias("over2"))
        farther = ahead.where("not over").join(other, ["g", "to"]).selectExpr("g", "n", "to2 as to", "w + w2 as w", "over2 as over", "k")
        ahead = cut(ahead.where("over").unionByName(farther))
    starts = links.join(inner.withColumnRenamed("n", "a"), ["g", "a"], "left_anti")
    edges = starts.join(ahead.select("g", F.col("n").alias("b"), "to", "w"), ["g", "b"], "left")
    edges = edges.groupBy("g", "a", F.coalesce("to", "b").alias("b")).agg(F.max(F.coalesce("w", F.lit(0)) + 1).alias("w"))
    return cut(edges), ahead.where("not over").select("g")


def longest_chains(edges: DataFrame, graph: str, source: str, target: str, one_task: int = ONE_TASK) -> DataFrame:
    """graph, depth, cyclic: the number of nodes on the longest path of each graph that has an edge; depth is null where there is a cycle.

    A graph of up to `one_task` edges is gathered into one row and solved there, many to a task. Larger
    ones, of which there are few, are solved together by joins: stretches without branches become one
    edge each, then levels are taken off all of them: a node is done once all edges to it are, so what
    is left when no node is ready has a cycle. There are as many levels as branching nodes on a path.
    Null ends and repeated edges do not count.
    """
    links = cut(edges.select(F.col(graph).alias("g"), F.col(source).alias("a"), F.col(target).alias("b")).dropna().distinct())
    big = cut(links.groupBy("g").count().where(F.col("count") > one_task).select("g"))

    @F.pandas_udf("int")
    def solved(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([longest_path(zip(a, b)) for a, b in zip(starts, ends)], dtype="Int32")

    rows = links.join(small(big), "g", "left_anti").groupBy("g").agg(F.collect_list(F.struct("a", "b")).alias("e"))
    rows = rows.select("g", solved(F.col("e.a"), F.col("e.b")).alias("depth"))
    found = rows.select(F.col("g").alias(graph), "depth", F.col("depth").isNull().alias("cyclic"))
    if big.isEmpty():
        return found
    return found.unionByName(_by_levels(cut(links.join(small(big), "g", "left_semi"))).withColumnRenamed("g", graph))


def _by_levels(links: DataFrame) -> DataFrame:
    """g, depth, cyclic of graphs whose edges g, a, b are too many for a task."""
    left, rings = _contracted(links)
    sources = left.select("g", F.col("a").alias("n")).distinct().join(left.select("g", F.col("b").alias("n")).distinct(), ["g", "n"], "left_anti")
    # reached nodes with their depth so far; those that no edge leads to any more are ready
    nodes = cut(sources.select("g", "n", F.lit(1).cast("bigint").alias("depth"), F.lit(True).alias("ready")))
    reached, level = links.select("g").distinct().select("g", F.lit(0).cast("bigint").alias("depth")), 1
    while not nodes.where("ready").isEmpty():
        front, waiting = nodes.where("ready").select("g", "n", "depth"), nodes.where("not ready").select("g", "n", "depth")
        reached = reached.unionByName(front.select("g", "depth"))
        if level % 16 == 0:
            reached = cut(reached.groupBy("g").agg(F.max("depth").alias("depth")))
        level += 1
        ahead = left.join(front.withColumnRenamed("n", "a"), ["g", "a"]).select("g", F.col("b").alias("n"), (F.col("depth") + F.col("w")).alias("depth"))
        left = cut(left.join(front.select("g", F.col("n").alias("a")), ["g", "a"], "left_anti"))
        known = waiting.unionByName(ahead).groupBy("g", "n").agg(F.max("depth").alias("depth"))
        awaited = left.select("g", F.col("b").alias("n")).distinct().withColumn("awaited", F.lit(True))
        nodes = cut(known.join(awaited, ["g", "n"], "left").select("g", "n", "depth", F.col("awaited").isNull().alias("ready")))
    cycles = left.select("g").unionByName(rings).distinct().withColumn("cyclic", F.lit(True))
    depth = reached.groupBy("g").agg(F.max("depth").alias("depth")).join(cycles, "g", "left")
    cyclic = F.coalesce("cyclic", F.lit(False))
    return depth.select("g", F.when(~cyclic, F.col("depth")).cast("int").alias("depth"), cyclic.alias("cyclic"))
