"""Runs of equal consecutive events, each collapsed into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.labels import workflows
from weftline.sources.tables import table

#: Labels of one sequence that stay together in a block.
BLOCK = 4096


def collapse_events(events: DataFrame, key: str, order: list[str], at: str, label: str, value: str, block: Column) -> DataFrame:
    """One row per run of equal consecutive labels: key, label, first_at, last_at, events, total.

    events: one row per event of the sequence `key`, ordered by `order` (make it total; tied events
    have no defined order), with a timestamp or number `at`, a `label` and a numeric `value`. `block`
    cuts a sequence into stretches that never overlap in `order` and rise with it (say, the hour of
    `at`), so that a sequence holding a third of all events is spread over many tasks. Runs are
    found per block; only the first and last of each block can continue elsewhere, and only these
    meet again by key. Null labels equal each other; null values do not count, and a total of none is
    null; rows without a key are left out.
    """
    rows = events.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), block.alias("block"), F.struct(*order).alias("place"), F.col(at).alias("at"), F.col(label).alias("label"), F.col(value).alias("value")
    )
    stretch = Window.partitionBy("key", "block")
    by_place = stretch.orderBy("place")
    whole = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.select(
        "key", "block", "label", "at", "place",
        F.row_number().over(by_place).alias("pos"),
        F.lag(F.struct("label", "at")).over(by_place).alias("before"),
        (F.coalesce(F.sum("value").over(upto), F.lit(0)) - F.coalesce("value", F.lit(0))).alias("sum_before"),
        (F.count("value").over(upto) - F.col("value").isNotNull().cast("int")).alias("known_before"),
        F.count("*").over(whole).alias("n"),
        F.last("at").over(whole).alias("end_at"),
        F.sum("value").over(whole).alias("sum_all"),
        F.count("value").over(whole).alias("known_all"),
    )
    starts = marked.where("before is null or not (label <=> before.label)")
    following = F.lead(F.struct("pos", "before", "sum_before", "known_before")).over(by_place)
    known = F.coalesce("next.known_before", "known_all") - F.col("known_before")
    spans = starts.withColumn("next", following).select(
        "key", "block", "place", "label",
        F.col("at").alias("first_at"),
        F.coalesce("next.before.at", "end_at").alias("last_at"),
        (F.coalesce("next.pos", F.col("n") + 1) - F.col("pos")).alias("events"),
        F.when(known > 0, F.coalesce("next.sum_before", "sum_all") - F.col("sum_before")).alias("total"),
        (F.col("pos") == 1).alias("opens"),
        F.col("next").isNull().alias("closes"),
    )
    out = ["key", "label", "first_at", "last_at", "events", "total"]
    inner = spans.where("not opens and not closes").select(*out)
    along = Window.partitionBy("key").orderBy("block", "place")
    last = F.lag(F.struct("block", "label")).over(along)
    edges = spans.where("opens or closes").withColumn("last", last)
    fresh = F.expr("cast(last is null or last.block <=> block or not (last.label <=> label) as bigint)")
    joined = (
        edges.withColumn("run", F.sum(fresh).over(along))
        .groupBy("key", "run")
        .agg(
            F.min_by("label", F.struct("block", "place")).alias("label"),
            F.min_by("first_at", F.struct("block", "place")).alias("first_at"),
            F.max_by("last_at", F.struct("block", "place")).alias("last_at"),
            F.sum("events").alias("events"),
            F.sum("total").alias("total"),
        )
    )
    return inner.unionByName(joined.select(*out)).withColumnRenamed("key", key)


def p2_runs(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, label, first_pos, last_pos, events, seconds: every run, single steps included.

    seconds is null where no step of the run has any.
    """
    steps = workflows(spark, folder).select("workflow_id", "step_seconds", F.posexplode("labels").alias("at", "label"))
    steps = steps.select("workflow_id", (F.col("at") + 1).alias("pos"), "label", F.get("step_seconds", F.col("at")).alias("seconds"))
    found = collapse_events(steps, "workflow_id", ["pos"], "pos", "label", "seconds", F.expr(f"(pos - 1) div {BLOCK}"))
    return found.select("workflow_id", "label", F.col("first_at").alias("first_pos"), F.col("last_at").alias("last_pos"), F.col("events").cast("int").alias("events"), F.col("total").alias("seconds"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, first_pos, last_pos of the runs of two or more."""
    return p2_runs(spark, folder).where("events >= 2").select("workflow_id", "first_pos", "last_pos")


def p2_event_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The same over a table of events: each user's runs of equal event types with count, span and total."""
    events = table(spark, folder, "events")
    found = collapse_events(events, "user_id", ["ts", "event_id"], "ts", "event_type", "value", F.date_trunc("day", "ts"))
    return found.select("user_id", F.col("label").alias("event_type"), "first_at", "last_at", "events", F.round("total", 4).alias("total"))
