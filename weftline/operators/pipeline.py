"""From parsed workflow files to labelled sequences and one profile row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.numbers import ratio
from weftline.operators import classify
from weftline.operators.labels import BUILD, SETUP
from weftline.operators.sequences import ARROW
from weftline.operators.workflow import prepared, profile, step_name

#: Labels that tell nothing: their steps stand in a sequence under their own names.
NAMELESS = ("other", "external_action", "composite")


def labelled(docs: DataFrame, doc: str = "doc", language: str = "language") -> DataFrame:
    """Adds `merged` (array of labels) and `job_sequences` (text) to documents of status ok.

    Jobs are taken in their order of needs, in each the labels of its steps (a step without one under
    its own name); of a label only the first occurrence stays. job_sequences holds the names of each
    job's steps. Steps are labelled inside their row, so nothing is shuffled.
    """
    ordered = F.expr(f"filter(transform({doc}.job_order, o -> filter({doc}.jobs, j -> j.job_id = o)[0]), j -> j.is_mapping)")
    rows = docs.withColumn("_ordered", ordered)
    steps = F.expr(f"flatten(transform(_ordered, j -> transform(j.steps, s -> struct(s.name as name, s.uses as uses, s.run as run, {step_name('s')} as called))))")
    rows = rows.withColumn("_named", steps)

    def label(step: Column) -> Column:
        return classify.classify_step(step["name"], step["uses"], step["run"], F.col(language))

    # the label is formed before it is compared, so that the rules run once per step
    told = F.transform("_named", lambda s: F.struct(label(s).alias("label"), s["called"].alias("called")))
    rows = rows.withColumn("_told", told)
    merged = F.array_distinct(F.transform("_told", lambda t: F.when(t["label"].isin(*NAMELESS), t["called"]).otherwise(t["label"])))
    jobs = f"transform(_ordered, j -> concat('[', j.job_id, ']: ', case when size(j.steps) = 0 then '(empty)' else array_join(transform(j.steps, s -> {step_name('s')}), '{ARROW}') end))"
    return rows.withColumn("merged", merged).withColumn("job_sequences", F.array_join(F.expr(jobs), " || ")).drop("_ordered", "_named", "_told")


def processed(files: DataFrame, keys: list[str], doc: str = "doc", language: str = "language") -> DataFrame:
    """keys, language and the profile of each workflow that has steps: counts, sequence, presence, events, caches, modularity, pins.

    files: keys, a canonical language, and a parsed document. Files that do not parse, have no jobs or
    no steps, or are only called by other workflows give no row.
    """
    docs = prepared(files.where(f"{doc}.status = 'ok' and size({doc}.jobs) > 0 and not coalesce({doc}.events = array('workflow_call'), false)"))
    docs = labelled(docs.where("size(_steps) > 0"), doc, language)
    has = lambda *x: F.arrays_overlap("merged", F.array(*map(F.lit, x))).cast("int")
    flags = {"has_checkout": has("checkout_repository"), "has_setup": has(*SETUP), "has_test": has("execute_tests"), "has_build": has(*BUILD)}
    jobs, steps = F.expr(f"size({doc}.jobs)"), F.size("_steps")
    return docs.select(
        *keys,
        language,
        jobs.alias("num_jobs"),
        steps.alias("num_steps_total"),
        ratio(steps, jobs, 2).alias("avg_steps_per_job"),
        F.array_join(F.transform("merged", classify.shown), ARROW).alias("sequence_id"),
        F.size("merged").alias("sequence_length"),
        "job_sequences",
        *(c.alias(n) for n, c in flags.items()),
        F.round(sum(flags.values(), F.lit(0)) / 4.0, 2).alias("completeness_score"),
        *(c.alias(n) for n, c in profile(doc).items()),
    )
