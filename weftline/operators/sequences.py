"""Frequencies in sequences of labels: whole sequences, ends, transitions, pairs, presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.numbers import share
from weftline.operators.scopes import ranked, with_overall

ARROW = " → "
#: What is read as an arrow. Fixed values.
ARROWS = "â\u0086\u0092| -> |->| => |=>| > "


def steps(text: Column) -> Column:
    """The trimmed, non-blank labels of a sequence written with any kind of arrow; empty for null."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), ARROWS, "→"), "→")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def first_occurrences(labels: Column) -> Column:
    """Each label where it first occurs."""
    return F.array_distinct(labels)


def merged(rows: DataFrame, scope: str, labels: str) -> DataFrame:
    """scope, labels, w: equal non-empty sequences of a scope with their number. All counts below start here."""
    return rows.select(F.col(scope).alias("scope"), F.col(labels).alias("labels")).where("size(labels) > 0").groupBy("scope", "labels").agg(F.count("*").alias("w"))


def totals(merged_rows: DataFrame) -> DataFrame:
    """scope, total: the number of sequences, Overall included."""
    return with_overall(merged_rows.groupBy("scope").agg(F.sum("w").alias("total")), "scope", [], ["total"])


def counted(merged_rows: DataFrame, keys: list[Column], most: int | None, per: list[str] = [], text: str = "key", of_all: bool = True) -> DataFrame:  # noqa: B006
    """scope, per..., key, count, percentage (of the scope's sequences), rank."""
    counts = with_overall(merged_rows.groupBy("scope", *keys).agg(F.sum("w").alias("count")), "scope", [*per, text], ["count"])
    out = counts.join(totals(merged_rows), "scope").withColumn("percentage", share(F.col("count"), F.col("total")))
    return ranked(out, ["scope", *per], "count", text, most) if most else out


def top_sequences(merged_rows: DataFrame, most: int = 10, common: float = 5.0) -> DataFrame:
    """scope, rank, sequence, count, percentage, meets (at least `common` percent), length."""
    found = counted(merged_rows, [F.array_join("labels", ARROW).alias("key")], most)
    length = F.size(F.split("key", ARROW))
    return found.select("scope", "rank", F.col("key").alias("sequence"), "count", "percentage", (F.col("count") * 100 >= common * F.col("total")).alias("meets"), length.alias("length"))


def common_sequences(merged_rows: DataFrame, common: float = 5.0) -> DataFrame:
    """scope, sequence, count, percentage of every sequence that at least `common` percent of a scope have."""
    found = counted(merged_rows, [F.array_join("labels", ARROW).alias("key")], None)
    return found.where(F.col("count") * 100 >= common * F.col("total")).select("scope", F.col("key").alias("sequence"), "count", "percentage")


def end_ngrams(merged_rows: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), most: int = 10) -> DataFrame:
    """scope, position (prefix or suffix), n, ngram, count, percentage of all sequences of the scope."""
    grams = [
        f"struct('{where}' as position, {n} as n, case when size(labels) >= {n} then array_join(slice(labels, {start}, {n}), '{ARROW}') end as key)"
        for n in sizes
        for where, start in (("prefix", 1), ("suffix", -n))
    ]
    long = merged_rows.select("scope", "w", F.expr(f"inline(array({', '.join(grams)}))")).where("key is not null")
    counts = with_overall(long.groupBy("scope", "position", "n", "key").agg(F.sum("w").alias("count")), "scope", ["position", "n", "key"], ["count"])
    out = counts.join(totals(merged_rows), "scope")
    top = ranked(out, ["scope", "position", "n"], "count", "key", most)
    return top.select("scope", "position", "n", F.col("key").alias("ngram"), "count", share(F.col("count"), F.col("total")).alias("percentage"))


def transitions(merged_rows: DataFrame, most: int = 50) -> DataFrame:
    """scope, from_step, to_step, count, percentage of all transitions of the scope."""
    pair = "transform(slice(labels, 2, size(labels)), (b, i) -> struct(labels[i] as from_step, b as to_step))"
    long = merged_rows.select("scope", "w", F.expr(f"inline({pair})"))
    counts = with_overall(long.groupBy("scope", "from_step", "to_step").agg(F.sum("w").alias("count")), "scope", ["from_step", "to_step"], ["count"])
    whole = counts.groupBy("scope").agg(F.sum("count").alias("total"))
    top = ranked(counts.withColumn("key", F.struct("from_step", "to_step")), ["scope"], "count", "key", most)
    return top.join(whole, "scope").select("scope", "from_step", "to_step", "count", share(F.col("count"), F.col("total"), 3).alias("percentage"))


#: Labels of a set from which on its pairs are formed by chunks of this many.
CHUNK = 256


def pair_counts(merged_rows: DataFrame, most: int = 30, chunk: int = CHUNK) -> DataFrame:
    """scope, step_a < step_b, count, percentage of sequences holding both.

    A set of more than `chunk` labels is cut into chunks; each pair of chunks is a row of its own that
    goes to any task, so no task forms all pairs of a long sequence.
    """
    sets = merged_rows.select("scope", "w", F.array_sort(F.array_distinct("labels")).alias("s")).groupBy("scope", "s").agg(F.sum("w").alias("w"))
    pair = "flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a as step_a, b as step_b))))"
    long = sets.where(F.size("s") <= chunk).select("scope", "w", F.expr(f"inline({pair})"))
    part = f"slice(s, {{0}} * {chunk} + 1, {chunk})"
    chunks = sets.where(F.size("s") > chunk).select("scope", "w", "s", F.explode(F.expr(f"sequence(0, (size(s) - 1) div {chunk})")).alias("k"))
    chunks = chunks.select("scope", "w", "s", "k", F.explode(F.expr(f"sequence(k, (size(s) - 1) div {chunk})")).alias("m"))
    chunks = chunks.select("scope", "w", F.expr(part.format("k")).alias("own"), F.expr(part.format("m")).alias("other")).repartition(F.xxhash64("own", "other"))
    cross = "flatten(transform(own, a -> transform(filter(other, b -> a < b), b -> struct(a as step_a, b as step_b))))"
    long = long.unionByName(chunks.select("scope", "w", F.expr(f"inline({cross})")))
    counts = with_overall(long.groupBy("scope", "step_a", "step_b").agg(F.sum("w").alias("count")), "scope", ["step_a", "step_b"], ["count"])
    top = ranked(counts.withColumn("key", F.struct("step_a", "step_b")), ["scope"], "count", "key", most)
    return top.join(totals(merged_rows), "scope").select("scope", "step_a", "step_b", "count", share(F.col("count"), F.col("total")).alias("percentage"))


def construct_frequency(merged_rows: DataFrame, common: float = 5.0) -> DataFrame:
    """scope, label, count of sequences holding it, percentage, is_common."""
    long = merged_rows.select("scope", "w", F.explode(F.array_distinct("labels")).alias("label"))
    counts = with_overall(long.groupBy("scope", "label").agg(F.sum("w").alias("count")), "scope", ["label"], ["count"])
    out = counts.join(totals(merged_rows), "scope")
    return out.select("scope", "label", "count", share(F.col("count"), F.col("total")).alias("percentage"), (F.col("count") * 100 >= common * F.col("total")).alias("is_common"))


def absence(merged_rows: DataFrame, patterns: dict[str, Column]) -> DataFrame:
    """scope, pattern, count, percentage: how many sequences show each pattern (a condition on `labels`)."""
    names = list(patterns)
    counts = merged_rows.groupBy("scope").agg(F.sum("w").alias("total"), *(F.sum(F.when(c, F.col("w")).otherwise(0)).alias(n) for n, c in patterns.items()))
    both = with_overall(counts, "scope", [], ["total", *names])
    long = both.select("scope", "total", F.inline(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).alias("count")) for n in names))))
    return long.select("scope", "pattern", "count", share(F.col("count"), F.col("total")).alias("percentage"))


def first_steps(merged_rows: DataFrame, leave_out: Column, most: int = 20) -> DataFrame:
    """scope, first_step, count: the commonest first labels of sequences whose first label is not left out."""
    rows = merged_rows.withColumn("key", F.element_at("labels", 1)).where(~leave_out)
    counts = with_overall(rows.groupBy("scope", "key").agg(F.sum("w").alias("count")), "scope", ["key"], ["count"])
    return ranked(counts, ["scope"], "count", "key", most).select("scope", F.col("key").alias("first_step"), "count", "rank")
