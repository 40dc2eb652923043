"""Queries on step sequences and on the profile columns of workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.numbers import share
from weftline.functions.text import canonical_language
from weftline.operators import classify, labels, sequences
from weftline.operators.histogram import quantiles
from weftline.operators.scopes import pivot_first, with_overall
from weftline.session import cut
from weftline.sources.tables import table

#: Yes-or-no columns of a profile. Fixed values.
TRIGGERS = ("has_push", "has_pull_request", "has_schedule", "has_workflow_dispatch")
#: The label with which a workflow is expected to begin.
FIRST = "Fetch Sources"
CONSTRUCTS = ("has_checkout", "has_setup", "has_test", "has_build", "uses_cache", "uses_reusable_workflows", "uses_composite_actions")


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "processed_workflows").withColumn("language", canonical_language(F.col("language")))


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    rows = _profiles(spark, folder).select("language", sequences.steps(F.col("sequence_id")).alias("labels"))
    return sequences.merged(rows, "language", "labels")


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events of a day, in order."""
    events = table(spark, folder, "events")
    day = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return day.select((F.col("user_id") % 3).cast("string").alias("scope"), F.expr("transform(e, x -> x.event_type)").alias("labels"))


def arrow_normalise(spark: SparkSession, folder: str) -> DataFrame:
    rows = _profiles(spark, folder).select("workflow_id", "processed_at", "sequence_id", sequences.steps(F.col("sequence_id")).alias("labels"))
    return rows.select("workflow_id", "processed_at", F.array_join("labels", sequences.ARROW).alias("sequence"), F.size("labels").alias("length"))


def sequence_first_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    rows = _profiles(spark, folder).select("workflow_id", "processed_at", sequences.first_occurrences(sequences.steps(F.col("sequence_id"))).alias("labels"))
    return rows.select("workflow_id", "processed_at", F.array_join("labels", sequences.ARROW).alias("sequence"))


def top_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.top_sequences(_merged(spark, folder)).withColumnRenamed("scope", "language")


def common_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.common_sequences(sequences.merged(_sessions(spark, folder), "scope", "labels"))


def ngram_prefix_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.end_ngrams(_merged(spark, folder)).withColumnRenamed("scope", "language")


def step_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.transitions(_merged(spark, folder)).withColumnRenamed("scope", "language")


def step_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.pair_counts(_merged(spark, folder)).withColumnRenamed("scope", "language")


def construct_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.construct_frequency(sequences.merged(_sessions(spark, folder), "scope", "labels"))


def construct_absence(spark: SparkSession, folder: str) -> DataFrame:
    has = lambda *x: F.arrays_overlap("labels", F.array(*map(F.lit, x)))
    fetch, test, build = has(FIRST), has("Run Unit Suite", "Run Integration Suite", "Run Smoke Suite"), has("Compile Modules", "Assemble Bundle")
    patterns = {
        "no_checkout": ~fetch, "no_test": ~test, "no_build": ~build, "test_without_build": test & ~build, "build_without_test": build & ~test,
        "neither": ~test & ~build, "checkout_only": fetch & (F.size("labels") == 1), "not_first": fetch & (F.element_at("labels", 1) != FIRST),
    }
    return sequences.absence(_merged(spark, folder), patterns).withColumnRenamed("scope", "language")


def absence_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """A row per pattern with its percentage in each scope, as a report shows it."""
    names = {"Overall": "overall", "Python": "python", "Java": "java", "C++": "cpp"}
    return pivot_first(construct_absence(spark, folder), ["pattern"], "language", list(names), "percentage").withColumnsRenamed(names)


def non_first_filter(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.first_steps(_merged(spark, folder), F.col("key") == "Fetch Sources").withColumnRenamed("scope", "language")


def label_display(spark: SparkSession, folder: str) -> DataFrame:
    """label_key, shown: every key of step_labels, and every label of the study, as it is displayed."""
    known = spark.createDataFrame([(x,) for x in sorted({*labels.LABELS, *labels.DISPLAY})], "label_key string")
    keys = table(spark, folder, "step_labels").select("label_key").unionByName(known)
    return keys.select("label_key", classify.shown(F.col("label_key")).alias("shown"))


def trigger_x_construct(spark: SparkSession, folder: str) -> DataFrame:
    """trigger, construct, pct_with and pct_without the trigger, their numbers and the difference; one pass over the rows."""
    rows = _profiles(spark, folder)
    sums = []
    for t in TRIGGERS:
        sums += [F.count_if(F.col(t) == 1).alias(f"w_{t}"), F.count_if(F.col(t) == 0).alias(f"o_{t}")]
        for c in CONSTRUCTS:
            sums += [F.count_if((F.col(t) == 1) & (F.col(c) == 1)).alias(f"w_{t}_{c}"), F.count_if((F.col(t) == 0) & (F.col(c) == 1)).alias(f"o_{t}_{c}")]
    cells = [
        F.struct(F.lit(t).alias("trigger"), F.lit(c).alias("construct"), F.col(f"w_{t}_{c}").alias("a"), F.col(f"o_{t}_{c}").alias("b"), F.col(f"w_{t}").alias("n_with"), F.col(f"o_{t}").alias("n_without"))
        for t in TRIGGERS
        for c in CONSTRUCTS
    ]
    long = rows.agg(*sums).select(F.inline(F.array(*cells)))
    a, b = 100.0 * F.col("a") / F.nullif(F.col("n_with"), F.lit(0)), 100.0 * F.col("b") / F.nullif(F.col("n_without"), F.lit(0))
    return long.select("trigger", "construct", F.round(a, 2).alias("pct_with"), F.round(b, 2).alias("pct_without"), "n_with", "n_without", F.round(a - b, 2).alias("diff"))


def modularity_x_complexity(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ("uses_reusable_workflows", "uses_composite_actions")
    long = _profiles(spark, folder).select(
        F.inline(F.array(*(F.struct(F.lit(k).alias("modularity_type"), F.col(k).alias("used")) for k in kinds))), "sequence_length", "completeness_score", "sha_percentage", "uses_cache", "has_test", "has_build"
    )
    group = F.when(F.col("used") == 1, "uses").otherwise("no_use").alias("group")
    out = long.groupBy("modularity_type", group).agg(
        F.count("*").alias("n"), F.avg("sequence_length").alias("len"), F.avg("completeness_score").alias("done"), F.avg((F.coalesce("sha_percentage", F.lit(0.0)) > 0).cast("double")).alias("sha"),
        *(F.avg(F.coalesce(c, F.lit(0)).cast("double")).alias(c) for c in ("uses_cache", "has_test", "has_build")),
    )
    return out.select(
        "modularity_type", "group", "n", F.round("len", 4).alias("avg_sequence_length"), F.round("done", 4).alias("avg_completeness"), F.round(100 * F.col("sha"), 2).alias("pct_sha_pinned"),
        *(F.round(100 * F.col(c), 2).alias(f"pct_{c}") for c in ("uses_cache", "has_test", "has_build")),
    )


def pinning_by_scope(spark: SparkSession, folder: str) -> DataFrame:
    """language, n, and of each kind of pin the percentage of workflows with any and the average number."""
    kinds = {"sha": "pinned_to_sha", "tag": "pinned_to_tag", "branch": "pinned_to_branch", "unpinned": "unpinned"}
    sums = [f for k, c in kinds.items() for f in (F.count_if(F.col(c) > 0).alias(f"any_{k}"), F.sum(F.coalesce(c, F.lit(0))).alias(f"sum_{k}"))]
    counts = with_overall(_profiles(spark, folder).groupBy("language").agg(F.count("*").alias("n"), *sums), "language", [], ["n", *(f"{a}_{k}" for k in kinds for a in ("any", "sum"))])
    return counts.select("language", "n", *(share(F.col(f"any_{k}"), F.col("n")).alias(f"pct_any_{k}") for k in kinds), *(F.round(F.col(f"sum_{k}") / F.col("n"), 4).alias(f"avg_{k}") for k in kinds))


#: Columns of a profile whose mean a summary shows, with its digits, and numbers of which it shows how many workflows have any. Fixed values.
MEANS = {"completeness_score": ("avg_completeness_score", 3), "total_modularity_constructs": ("avg_modularity_constructs", 2)}
ANY = {"pinned_to_sha": "pct_any_sha_pinned", "pinned_to_tag": "pct_any_tag_pinned", "unpinned": "pct_any_unpinned"}


def _number(column: str) -> Column:
    """A column as a number; what is none is null."""
    return F.expr(f"try_cast(`{column}` as double)")


def language_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A row per language and Overall: sizes, presence of constructs and triggers, pins, the top sequence, the number of common ones.

    Texts that are no numbers do not count in means. pct_starts_with_checkout: of all workflows, those whose first label is FIRST.
    """
    flags = [*CONSTRUCTS, *TRIGGERS]
    rows = _profiles(spark, folder)
    first = F.coalesce(F.get(sequences.steps(F.col("sequence_id")), F.lit(0)) == FIRST, F.lit(False))
    sums = [F.count_if(F.col(f) == 1).alias(f) for f in flags] + [F.count_if(_number(c) > 0).alias(f"any_{c}") for c in ANY] + [F.count_if(first).alias("starts")]
    for c in (*MEANS, "sequence_length"):
        sums += [F.sum(_number(c)).alias(f"sum_{c}"), F.count(_number(c)).alias(f"n_{c}")]
    names = [*flags, *(f"any_{c}" for c in ANY), "starts", *(f"{k}_{c}" for c in (*MEANS, "sequence_length") for k in ("sum", "n"))]
    counts = with_overall(rows.groupBy("language").agg(F.count("*").alias("workflow_count"), *sums), "language", [], ["workflow_count", *names])
    lengths = rows.withColumn("value", _number("sequence_length")).where("value is not null").groupBy("language", "value").agg(F.count("*").alias("cnt"))
    spans = quantiles(cut(with_overall(lengths, "language", ["value"], ["cnt"])), ["language"], [0.5], others=[F.max("value").cast("bigint").alias("max_sequence_length")])
    found = sequences.counted(_merged(spark, folder), [F.array_join("labels", sequences.ARROW).alias("key")], None)
    tops = found.groupBy("scope").agg(F.min_by(F.struct("key", "percentage"), F.struct(-F.col("count"), F.col("key"))).alias("top"), F.count_if(F.col("count") * 100 >= 5 * F.col("total")).alias("common_seq_count_5pct"))
    out = counts.join(spans, "language", "left").join(tops, counts.language == tops.scope, "left")
    mean = lambda c, digits: F.round(F.col(f"sum_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0)), digits)
    return out.select(
        "language", "workflow_count", mean("sequence_length", 2).alias("avg_sequence_length"), F.col("p")[0].alias("median_sequence_length"), "max_sequence_length",
        *(share(F.col(f), F.col("workflow_count")).alias(f"pct_{f}") for f in flags), *(mean(c, digits).alias(n) for c, (n, digits) in MEANS.items()), share(F.col("starts"), F.col("workflow_count")).alias("pct_starts_with_checkout"),
        *(share(F.col(f"any_{c}"), F.col("workflow_count")).alias(n) for c, n in ANY.items()), (F.col("workflow_count") - F.col("starts")).alias("non_checkout_first_count"),
        F.col("top.key").alias("top1_sequence"), F.col("top.percentage").alias("top1_pct"), F.coalesce("common_seq_count_5pct", F.lit(0)).alias("common_seq_count_5pct"),
    )


def global_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row over all workflows: the Overall row without its top sequence, with the number of common constructs."""
    overall = language_summary(spark, folder).where("language = 'Overall'").drop("language", "max_sequence_length", "avg_modularity_constructs", "top1_sequence", "top1_pct")
    common = sequences.construct_frequency(_merged(spark, folder)).where("scope = 'Overall'").agg(F.count_if("is_common").alias("common_constructs_count"))
    return overall.withColumnsRenamed({"workflow_count": "total_workflows", "common_seq_count_5pct": "common_full_sequences_count"}).crossJoin(F.broadcast(common))  # one row


QUERIES = {
    f.__name__: f
    for f in (
        arrow_normalise, sequence_first_occurrence, top_sequences, common_sequences, ngram_prefix_suffix, step_transitions, step_cooccurrence, construct_frequency, construct_absence, absence_pivot, non_first_filter,
        label_display, trigger_x_construct, modularity_x_complexity, pinning_by_scope, language_summary, global_summary,
    )
}

_LANG = "CASE lower(trim(language, E' \\t\\n\\r')) WHEN 'python' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'c++' THEN 'C++' WHEN 'cpp' THEN 'C++' END"
_STEPS = "list_filter(list_transform(string_split(regexp_replace(coalesce(sequence_id, ''), chr(226) || chr(134) || chr(146) || '| -> |->| => |=>| > ', '→', 'g'), '→'), lambda x: trim(x)), lambda x: x <> '')"
_SEQ = f"""
    l AS (SELECT {_LANG} AS language, {_STEPS} AS labels FROM processed_workflows),
    q AS (SELECT * FROM l WHERE len(labels) > 0),
    s AS (SELECT * FROM q WHERE language IS NOT NULL UNION ALL SELECT 'Overall', labels FROM q),
    t AS (SELECT language, count(*) AS total FROM s GROUP BY 1)"""
_EVENTS = """
    d AS (SELECT (user_id % 3)::VARCHAR AS scope, list(event_type ORDER BY ts, event_id) AS labels FROM events GROUP BY user_id, ts::DATE),
    s AS (SELECT * FROM d UNION ALL SELECT 'Overall', labels FROM d),
    t AS (SELECT scope, count(*) AS total FROM s GROUP BY 1)"""
_PROFILE = f"p AS (SELECT {_LANG} AS language, * EXCLUDE (language) FROM processed_workflows), s AS (SELECT * FROM p WHERE language IS NOT NULL UNION ALL SELECT 'Overall', * EXCLUDE (language) FROM p)"
_SUMMARY = f"""
    WITH {_PROFILE},
    a AS (SELECT language, count(*) AS workflow_count, round(avg(sequence_length), 2) AS avg_sequence_length, median(sequence_length) AS median_sequence_length, max(sequence_length) AS max_sequence_length,
          {", ".join(f"round(100.0 * count(*) FILTER ({f} = 1) / count(*), 2) AS pct_{f}" for f in (*CONSTRUCTS, *TRIGGERS))}, {", ".join(f"round(avg({c}), {d}) AS {n}" for c, (n, d) in MEANS.items())},
          {", ".join(f"round(100.0 * count(*) FILTER ({c} > 0) / count(*), 2) AS {n}" for c, n in ANY.items())},
          round(100.0 * count(*) FILTER (coalesce(({_STEPS})[1] = '{FIRST}', false)) / count(*), 2) AS pct_starts_with_checkout, count(*) FILTER (NOT coalesce(({_STEPS})[1] = '{FIRST}', false)) AS non_checkout_first_count FROM s GROUP BY 1),
    q AS (SELECT language, array_to_string({_STEPS}, ' → ') AS key, len({_STEPS}) AS k FROM s),
    t AS (SELECT language, count(*) AS total FROM q WHERE k > 0 GROUP BY 1),
    c AS (SELECT language, key, count(*) AS n FROM q WHERE k > 0 GROUP BY ALL),
    r AS (SELECT c.*, round(100.0 * n / total, 2) AS pct, n * 100 >= 5 * total AS often, row_number() OVER (PARTITION BY language ORDER BY n DESC, key) AS i FROM c JOIN t USING (language)),
    o AS (SELECT language, max(key) FILTER (i = 1) AS top1_sequence, max(pct) FILTER (i = 1) AS top1_pct, count(*) FILTER (often) AS common_seq_count_5pct FROM r GROUP BY 1),
    e AS (SELECT unnest(list_distinct({_STEPS})) AS label FROM processed_workflows),
    g AS (SELECT count(*) AS common_constructs_count FROM (SELECT label FROM e GROUP BY 1 HAVING count(*) * 100 >= 5 * (SELECT total FROM t WHERE language = 'Overall')))"""
ORACLES = {
    "arrow_normalise": f"SELECT workflow_id, processed_at, array_to_string({_STEPS}, ' → ') AS sequence, len({_STEPS}) AS length FROM processed_workflows",
    "sequence_first_occurrence": f"""
        WITH l AS (SELECT workflow_id, processed_at, {_STEPS} AS labels FROM processed_workflows)
        SELECT workflow_id, processed_at, coalesce(array_to_string(list_filter(labels, lambda x, i: list_position(labels, x) = i), ' → '), '') AS sequence FROM l""",
    "top_sequences": f"""
        WITH {_SEQ},
        c AS (SELECT language, array_to_string(labels, ' → ') AS sequence, any_value(len(labels)) AS length, count(*) AS count FROM s GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY count DESC, sequence) AS rank FROM c)
        SELECT language, rank, sequence, count, round(100.0 * count / total, 2) AS percentage, count * 100 >= 5 * total AS meets, length FROM r JOIN t USING (language) WHERE rank <= 10""",
    "common_sequences": f"""
        WITH {_EVENTS}, c AS (SELECT scope, array_to_string(labels, ' → ') AS sequence, count(*) AS count FROM s GROUP BY ALL)
        SELECT scope, sequence, count, round(100.0 * count / total, 2) AS percentage FROM c JOIN t USING (scope) WHERE count * 100 >= 5 * total""",
    "ngram_prefix_suffix": f"""
        WITH {_SEQ},
        g AS (SELECT language, labels, unnest([2, 3, 4]) AS n FROM s),
        h AS (SELECT language, 'prefix' AS position, n, array_to_string(labels[:n], ' → ') AS ngram FROM g WHERE len(labels) >= n UNION ALL SELECT language, 'suffix', n, array_to_string(labels[-n:], ' → ') FROM g WHERE len(labels) >= n),
        c AS (SELECT language, position, n, ngram, count(*) AS count FROM h GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY language, position, n ORDER BY count DESC, ngram) AS i FROM c)
        SELECT language, position, n, ngram, count, round(100.0 * count / total, 2) AS percentage FROM r JOIN t USING (language) WHERE i <= 10""",
    "step_transitions": f"""
        WITH {_SEQ},
        g AS (SELECT language, labels, unnest(range(1, len(labels))) AS i FROM s),
        c AS (SELECT language, labels[i] AS from_step, labels[i + 1] AS to_step, count(*) AS count FROM g GROUP BY ALL),
        r AS (SELECT *, sum(count) OVER (PARTITION BY language) AS whole, row_number() OVER (PARTITION BY language ORDER BY count DESC, from_step, to_step) AS k FROM c)
        SELECT language, from_step, to_step, count, round(100.0 * count / whole, 3) AS percentage FROM r WHERE k <= 50""",
    "step_cooccurrence": f"""
        WITH {_SEQ},
        e AS (SELECT i, language, unnest(list_distinct(labels)) AS step FROM (SELECT row_number() OVER () AS i, * FROM s)),
        c AS (SELECT a.language, a.step AS step_a, b.step AS step_b, count(*) AS count FROM e a JOIN e b ON a.i = b.i AND a.step < b.step GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY count DESC, step_a, step_b) AS k FROM c)
        SELECT language, step_a, step_b, count, round(100.0 * count / total, 2) AS percentage FROM r JOIN t USING (language) WHERE k <= 30""",
    "construct_frequency": f"""
        WITH {_EVENTS}, e AS (SELECT scope, unnest(list_distinct(labels)) AS label FROM s), c AS (SELECT scope, label, count(*) AS count FROM e GROUP BY ALL)
        SELECT scope, label, count, round(100.0 * count / total, 2) AS percentage, count * 100 >= 5 * total AS is_common FROM c JOIN t USING (scope)""",
    "construct_absence": f"""
        WITH {_SEQ},
        b AS (SELECT language, labels, list_contains(labels, 'Fetch Sources') AS f, list_has_any(labels, ['Run Unit Suite', 'Run Integration Suite', 'Run Smoke Suite']) AS t, list_has_any(labels, ['Compile Modules', 'Assemble Bundle']) AS b FROM s),
        x AS (SELECT language, unnest([{{'p': 'no_checkout', 'v': NOT f}}, {{'p': 'no_test', 'v': NOT t}}, {{'p': 'no_build', 'v': NOT b}}, {{'p': 'test_without_build', 'v': t AND NOT b}}, {{'p': 'build_without_test', 'v': b AND NOT t}},
              {{'p': 'neither', 'v': NOT t AND NOT b}}, {{'p': 'checkout_only', 'v': f AND len(labels) = 1}}, {{'p': 'not_first', 'v': f AND labels[1] <> 'Fetch Sources'}}]) AS u FROM b)
        SELECT language, u.p AS pattern, count(*) FILTER (u.v) AS count, round(100.0 * count(*) FILTER (u.v) / count(*), 2) AS percentage FROM x GROUP BY 1, 2""",
    "non_first_filter": f"""
        WITH {_SEQ}, c AS (SELECT language, labels[1] AS first_step, count(*) AS count FROM s WHERE labels[1] <> 'Fetch Sources' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY count DESC, first_step) AS rank FROM c)
        SELECT * FROM r WHERE rank <= 20""",
    "label_display": f"""
        WITH k AS (SELECT label_key FROM step_labels UNION ALL SELECT unnest({sorted({*labels.LABELS, *labels.DISPLAY})})), d AS (SELECT unnest({list(labels.DISPLAY)}) AS label_key, unnest({list(labels.DISPLAY.values())}) AS shown)
        SELECT label_key, coalesce(d.shown, CASE WHEN contains(label_key, '_') THEN array_to_string(list_transform(string_split(label_key, '_'), lambda x: upper(x[1]) || x[2:]), ' ') ELSE label_key END) AS shown FROM k LEFT JOIN d USING (label_key)""",
    "trigger_x_construct": " UNION ALL ".join(
        f"""SELECT '{t}' AS trigger, '{c}' AS construct, round(100.0 * count(*) FILTER ({t} = 1 AND {c} = 1) / count(*) FILTER ({t} = 1), 2) AS pct_with, round(100.0 * count(*) FILTER ({t} = 0 AND {c} = 1) / count(*) FILTER ({t} = 0), 2) AS pct_without,
            count(*) FILTER ({t} = 1) AS n_with, count(*) FILTER ({t} = 0) AS n_without,
            round(100.0 * count(*) FILTER ({t} = 1 AND {c} = 1) / count(*) FILTER ({t} = 1) - 100.0 * count(*) FILTER ({t} = 0 AND {c} = 1) / count(*) FILTER ({t} = 0), 2) AS diff FROM processed_workflows"""
        for t in TRIGGERS
        for c in CONSTRUCTS
    ),
    "modularity_x_complexity": " UNION ALL ".join(
        f"""SELECT '{k}' AS modularity_type, CASE WHEN {k} = 1 THEN 'uses' ELSE 'no_use' END AS "group", count(*) AS n, round(avg(sequence_length), 4) AS avg_sequence_length, round(avg(completeness_score), 4) AS avg_completeness,
            round(100.0 * count(*) FILTER (sha_percentage > 0) / count(*), 2) AS pct_sha_pinned, round(100.0 * count(*) FILTER (uses_cache = 1) / count(*), 2) AS pct_uses_cache, round(100.0 * count(*) FILTER (has_test = 1) / count(*), 2) AS pct_has_test,
            round(100.0 * count(*) FILTER (has_build = 1) / count(*), 2) AS pct_has_build FROM processed_workflows GROUP BY 2"""
        for k in ("uses_reusable_workflows", "uses_composite_actions")
    ),
    "pinning_by_scope": f"""
        WITH {_PROFILE}
        SELECT language, count(*) AS n, {", ".join(f"round(100.0 * count(*) FILTER ({c} > 0) / count(*), 2) AS pct_any_{k}, round(sum(coalesce({c}, 0)) / count(*), 4) AS avg_{k}" for k, c in (("sha", "pinned_to_sha"), ("tag", "pinned_to_tag"), ("branch", "pinned_to_branch"), ("unpinned", "unpinned")))}
        FROM s GROUP BY 1""",
    "language_summary": f"{_SUMMARY} SELECT * REPLACE (coalesce(common_seq_count_5pct, 0) AS common_seq_count_5pct) FROM a LEFT JOIN o USING (language)",
    "global_summary": f"""{_SUMMARY}
        SELECT * EXCLUDE (language, max_sequence_length, avg_modularity_constructs, top1_sequence, top1_pct) RENAME (workflow_count AS total_workflows, common_seq_count_5pct AS common_full_sequences_count) FROM a LEFT JOIN o USING (language), g WHERE language = 'Overall'""",
}
ORACLES["absence_pivot"] = f"""
    SELECT pattern, {", ".join(f"max(percentage) FILTER (language = '{x}') AS {n}" for x, n in (("Overall", "overall"), ("Python", "python"), ("Java", "java"), ("C++", "cpp")))} FROM ({ORACLES['construct_absence']}) GROUP BY 1"""
