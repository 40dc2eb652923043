"""Queries on workflow files: parsing, metrics, profiles, classification, rules, samples, chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import canonical_language
from weftline.operators import bands, classify, dag, pipeline, rules, sampling, workflow
from weftline.session import cut, once, shared_dir, spread
from weftline.sources import files as sources
from weftline.sources import sinks
from weftline.sources.tables import table

#: File names by which one workflow of a project is chosen, best first. Fixed values.
PREFERRED = ("ci.yml", "test.yml", "tests.yml", "build.yml", "main.yml", "workflow.yml", "python.yml", "java.yml", "cpp.yml", "c++.yml")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, collected_at, language, text, doc of every file; parsed once for all queries of an application."""

    def parsed() -> DataFrame:
        rows = spread(table(spark, folder, "yaml_reference").select("workflow_id", "collected_at", "language", "full_workflow_yaml"))
        return rows.select("workflow_id", "collected_at", canonical_language(F.col("language")).alias("language"), F.col("full_workflow_yaml").alias("text"), workflow.parsed(F.col("full_workflow_yaml")).alias("doc"))

    return once(spark, f"parsed files of {folder}", parsed)


def line_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", workflow.line_count(F.col("text")).alias("lines"))


def escape_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text", workflow.escaped(F.col("text")).alias("line"))
    return rows.select("doc_id", F.length("line").alias("length"), (workflow.unescaped(F.col("line")).eqNullSafe(F.col("text"))).alias("same"))


def yaml_metrics(spark: SparkSession, folder: str) -> DataFrame:
    docs = workflow.prepared(_files(spark, folder).where("doc.status = 'ok'"))
    return docs.select("workflow_id", "collected_at", "language", *(c.alias(n) for n, c in workflow.metrics("doc", "text").items()))


def yaml_profile(spark: SparkSession, folder: str) -> DataFrame:
    docs = workflow.prepared(_files(spark, folder).where("doc.status = 'ok'"))
    return docs.select("workflow_id", "collected_at", F.array_join("doc.job_order", ", ").alias("job_order"), *(c.alias(n) for n, c in workflow.profile("doc").items()))


def reject_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    docs = _files(spark, folder).select("language", F.col("doc.status").alias("status"))
    return docs.groupBy("language", "status").agg(F.count("*").alias("files"))


def classified_steps(spark: SparkSession, folder: str) -> DataFrame:
    """language, label, steps: the labels of all steps of all files."""
    docs = _files(spark, folder).where("doc.status = 'ok'")
    steps = docs.select("language", F.explode(F.expr("flatten(transform(doc.jobs, j -> j.steps))")).alias("s"))
    # equal steps are classified once
    equal = steps.groupBy("language", "s.name", "s.uses", "s.run").agg(F.count("*").alias("w"))
    # as an element of an array, as the rules are too many for compiled code around an aggregate
    label = F.get(F.transform(F.array(F.struct("name", "uses", "run", "language")), lambda s: classify.classify_step(s["name"], s["uses"], s["run"], s["language"])), F.lit(0))
    return equal.withColumn("label", label).groupBy("language", "label").agg(F.sum("w").alias("steps"))


def workflow_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, collected_at, and the profile with its sequence of every file that has steps: processed_workflows from yaml_reference."""
    return pipeline.processed(_files(spark, folder), ["workflow_id", "collected_at"])


def workflow_complexity(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, collected_at, file_size_bytes and what a sampling frame keeps of every file that parses."""
    docs = workflow.prepared(_files(spark, folder).where("doc.status = 'ok'"))
    return docs.select("workflow_id", "collected_at", F.octet_length("text").alias("file_size_bytes"), *(c.alias(n) for n, c in workflow.complexity("doc").items()))


def classify_actions(spark: SparkSession, folder: str) -> DataFrame:
    """uses, label: every action that a line of a file names."""
    found = table(spark, folder, "yaml_reference").select(F.explode(F.expr("regexp_extract_all(full_workflow_yaml, 'uses: ([A-Za-z0-9_./-]+)', 1)")).alias("uses")).distinct()
    return found.select("uses", classify.classify_action(F.col("uses")).alias("label"))


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, digest: the texts of all documents, written as CSV with a byte order mark into the shared folder and read again."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(workflow.escaped(F.col("text")), F.lit("")).alias("text"))
    path = f"{shared_dir(spark).rstrip('/')}/weftline-{uuid.uuid4().hex}"
    sinks.write_csv(rows, path, bom=True)
    back = sources.robust(spark, path, ["doc_id", "text"])
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.coalesce(workflow.unescaped(F.col("text")), F.lit(""))).alias("digest"))


def classify_lines(spark: SparkSession, folder: str) -> DataFrame:
    """label, lines: the rules of step names over the lines of all documents."""
    lines = spread(table(spark, folder, "documents").select("text")).select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("w"))
    return lines.groupBy(classify.classify_text(F.col("line")).alias("label")).agg(F.sum("w").alias("lines"))


def rule_detail(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.evaluate(_files(spark, folder), ["workflow_id", "collected_at", "language"], enabled_only=False)
    return found.withColumn("justifiable", F.when(F.col("violation") == 1, rules.justifiable(F.col("rule_id"), F.col("language"))))


def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rules.scores(rules.evaluate(_files(spark, folder), ["workflow_id", "collected_at"]), ["workflow_id", "collected_at"])


def rule_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return rules.ranking(rules.evaluate(_files(spark, folder), ["workflow_id"]))


def rule_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rules.violation_matrix(rules.evaluate(_files(spark, folder), ["workflow_id", "collected_at"]), ["workflow_id", "collected_at"])


def stateful_line_scan(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, collected_at, install_without_cache, static_keys: the rules that read lines of text."""
    rows = table(spark, folder, "yaml_reference").select("workflow_id", "collected_at", F.coalesce("full_workflow_yaml", F.lit("")).alias("text"))
    by_id = {r.rule_id: r for r in rules.RULES}
    return rows.select("workflow_id", "collected_at", F.expr(by_id["EFF-01"].condition).alias("install_without_cache"), F.expr(f"size({rules.CACHE_KEYS})").alias("static_keys"))


def action_usage_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, collected_at, action lines, distinct actions and pins, from the text alone."""
    rows = table(spark, folder, "yaml_reference").select("workflow_id", "collected_at", F.expr("regexp_extract_all(coalesce(full_workflow_yaml, ''), 'uses: ([A-Za-z0-9_./-]+@[A-Za-z0-9_./-]+)', 1)").alias("u"))
    kinds = {k: F.expr(f"size(filter(array_distinct(u), x -> {workflow.pin_kind('x')} = '{k}'))").alias(f"pinned_{k}") for k in ("sha", "tag", "branch")}
    return rows.select("workflow_id", "collected_at", F.size("u").alias("uses"), F.expr("size(array_distinct(transform(u, x -> substring_index(x, '@', 1))))").alias("actions"), *kinds.values())


def yaml_roundtrip_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as workflow files, parsed again, and measured: jobs are suppliers, steps line items."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag")
    # one shuffle for both levels; its number of partitions is kept for the parser
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    item = F.concat(F.lit("      - uses: shop/part-"), F.col("l_partkey"), F.lit("@v1\n"), F.when(F.col("l_returnflag") == "R", "        if: returned\n").otherwise(""))
    job = lines.groupBy("l_orderkey", "l_suppkey").agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("steps"))
    head = F.concat(F.lit("  s"), F.col("l_suppkey"), F.lit(":\n    runs-on: x\n"))
    order = job.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_suppkey", head.alias("head"), "steps"))).alias("j"))
    needs = "transform(j, (x, i) -> concat(x.head, case when i > 0 then concat('    needs: s', cast(j[i - 1].l_suppkey as string), '\\n') else '' end, '    steps:\\n', x.steps))"
    text = F.concat(F.lit("on: push\njobs:\n"), F.array_join(F.expr(needs), ""))
    docs = order.select("l_orderkey", text.alias("text")).withColumn("doc", workflow.parsed(F.col("text")))
    docs = workflow.prepared(docs)
    measured = workflow.metrics("doc", "text")
    names = ("lines_of_yaml", "num_jobs", "num_steps", "max_sequential_steps", "vertical_depth", "num_conditionals", "num_job_dependencies", "num_unique_external_actions", "num_marketplace_actions", "avg_steps_per_job", "conditional_density", "has_job_dependencies")
    return docs.select("l_orderkey", *(measured[n].alias(n) for n in names))


def primary_per_project(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "yaml_reference").where("project_id is not null").select("project_id", "full_path").distinct()
    return workflow.workflow_order(rows, "project_id", "full_path", PREFERRED)


def project_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling of a path in the error log, and its project."""
    rows = table(spark, folder, "parsing_errors_java").select("file").distinct()
    return rows.select("file", workflow.project_of(F.col("file")).alias("project_id"))


def _frame(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sample_metadata").groupBy("workflow_id").agg(F.min(canonical_language(F.col("language"))).alias("language"), F.max("num_jobs").alias("num_jobs"), F.max("num_steps").alias("num_steps"))
    level = F.when(F.col("num_steps") <= 5, "simple").when(F.col("num_steps") <= 10, "moderate").otherwise("complex")
    return rows.where("language is not null").withColumn("stratum", F.concat_ws("_", "language", level, bands.job_category(F.col("num_jobs"))))


def stratified_allocation(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.allocate(_frame(spark, folder), "language", "stratum", 382)


def stratified_sample_md5(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stratified_sample(_frame(spark, folder), "workflow_id", "language", "stratum", 382).select("workflow_id", "language", "stratum")


def sample_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the sample with more than 15 steps count as failed and get replacements."""
    frame = cut(_frame(spark, folder))
    sample = cut(sampling.stratified_sample(frame, "workflow_id", "language", "stratum", 382))
    return sampling.replacements(sample, frame, "workflow_id", "language", "stratum", F.col("num_steps") > 15)


def sample_summary(spark: SparkSession, folder: str) -> DataFrame:
    """language, workflows, unique_projects, average size, jobs and steps, and the numbers of workflows per tertile of steps and third of file sizes."""
    rows = cut(table(spark, folder, "sample_metadata").select("workflow_id", F.col("language").alias("spelling"), "project_id", "file_size_kb", "num_jobs", "num_steps", "workflow_file", "full_path"))
    sized = bands.quantile_labels(rows, "file_size_kb", ["small_files", "medium_files", "large_files"])
    kinds = bands.tertiles(rows.groupBy("workflow_id").agg(F.max("num_steps").alias("steps")), "steps", ["workflow_id"]).select("workflow_id", F.col("tertile").alias("kind"))
    sized = sized.join(kinds, "workflow_id", "left").withColumn("language", canonical_language(F.col("spelling")))
    averages = [F.round(F.avg(c), 2).alias(n) for c, n in (("file_size_kb", "avg_file_size_kb"), ("num_jobs", "avg_jobs"), ("num_steps", "avg_steps"))]
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("simple", "moderate", "complex")] + [F.count_if(F.col("label") == k).alias(k) for k in ("small_files", "medium_files", "large_files")]
    return sized.groupBy("language").agg(F.count("*").alias("workflows"), F.countDistinct("project_id").alias("unique_projects"), *averages, *counts)


def dag_depth_recursive(spark: SparkSession, folder: str) -> DataFrame:
    """o_custkey, depth, cyclic: chains of a customer's consecutive orders of the same status."""
    from pyspark.sql import Window

    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    before = F.lag(F.struct("o_orderkey", "o_orderstatus")).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = orders.withColumn("p", before).where("p.o_orderstatus = o_orderstatus").select("o_custkey", F.col("p.o_orderkey").alias("a"), F.col("o_orderkey").alias("b"))
    return dag.longest_chains(edges, "o_custkey", "a", "b")


QUERIES = {
    f.__name__: f
    for f in (
        line_count, escape_roundtrip, yaml_metrics, yaml_profile, reject_quarantine, workflow_profiles, workflow_complexity, csv_roundtrip, classify_actions, classified_steps, classify_lines, rule_detail, rule_scores, rule_ranking, rule_matrix, stateful_line_scan,
        action_usage_distinct, yaml_roundtrip_metrics, primary_per_project, project_ids, stratified_allocation, stratified_sample_md5, sample_repair, sample_summary, dag_depth_recursive,
    )
}

_LANG = "CASE lower(trim(language, E' \\t\\n\\r')) WHEN 'python' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'c++' THEN 'C++' WHEN 'cpp' THEN 'C++' END"
_INSTALL = "(?i)(pip3? install|mvn install|gradle build|apt-get install|npm install|yarn install|conan install|vcpkg install)"
_FRAME = f"""
    f AS (SELECT workflow_id, min({_LANG}) AS language, max(num_jobs) AS num_jobs, max(num_steps) AS num_steps FROM sample_metadata GROUP BY 1),
    r AS (SELECT *, language || '_' || CASE WHEN num_steps <= 5 THEN 'simple' WHEN num_steps <= 10 THEN 'moderate' ELSE 'complex' END || coalesce('_' || CASE WHEN num_jobs = 1 THEN 'single_job' WHEN num_jobs <= 3 THEN 'few_jobs' WHEN num_jobs IS NOT NULL THEN 'many_jobs' END, '') AS stratum FROM f WHERE language IS NOT NULL),
    c AS (SELECT language, stratum, count(*) AS available FROM r GROUP BY ALL),
    g AS (SELECT *, sum(available) OVER () AS n, sum(available) OVER (PARTITION BY language) AS gn FROM c),
    w AS (SELECT *, least(greatest(round(382 * gn / n), 10), gn)::BIGINT AS gw FROM g),
    v AS (SELECT *, least(greatest(ceil(available * gw / gn), 1), available)::BIGINT AS sw FROM w),
    x AS (SELECT *, greatest(least(sw, gw - coalesce(sum(sw) OVER (PARTITION BY language ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS iw FROM v),
    y AS (SELECT *, greatest(least(iw, 382 - coalesce(sum(iw) OVER (ORDER BY language, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS tw FROM x),
    z AS (SELECT *, available - tw AS room, 382 - sum(tw) OVER () AS lack FROM y),
    a AS (SELECT language, stratum, available, (tw + greatest(least(room, lack - coalesce(sum(room) OVER (ORDER BY language, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0))::BIGINT AS wanted FROM z),
    m AS (SELECT workflow_id, language, stratum, num_steps FROM (SELECT r.*, wanted, row_number() OVER (PARTITION BY r.language, r.stratum ORDER BY md5('42' || workflow_id::VARCHAR), workflow_id) AS k FROM r JOIN a ON a.language = r.language AND a.stratum = r.stratum) WHERE k <= wanted)"""


def _cases(text: str, found: tuple[tuple[str, str], ...], otherwise: str) -> str:
    """A CASE of patterns in order."""
    return f"CASE {' '.join(f"""WHEN regexp_matches({text}, '{pattern}') THEN '{label}'""" for label, pattern in found)} ELSE {otherwise} END"


def _action_test(test: str, words: list[str]) -> str:
    found = " OR ".join(f"starts_with(s, '{w}')" if test == "begins" else f"contains(s, '{w}')" for w in words)
    return f"own AND ({found})" if test == "local" else f"({found})"


ORACLES = {
    "line_count": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents)
        SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + CASE WHEN right(t, 1) = chr(10) THEN 0 ELSE 1 END END AS lines FROM t""",
    "escape_roundtrip": r"""
        WITH e AS (SELECT doc_id, text, replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r') AS line FROM documents)
        SELECT doc_id, length(line) AS length, array_to_string(list_transform(string_split(line, '\\'), lambda x: replace(replace(x, '\n', chr(10)), '\r', chr(13))), '\') IS NOT DISTINCT FROM text AS same FROM e""",
    "stateful_line_scan": rf"""
        WITH t AS (SELECT row_number() OVER () AS i, workflow_id, collected_at, coalesce(full_workflow_yaml, '') AS text FROM yaml_reference),
        l AS (SELECT i, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t),
        m AS (SELECT i, k, contains(line, 'actions/cache') AS c, regexp_matches(line, '(?i)key:[ \t]*[^ \t\r]') AS y, NOT regexp_matches(regexp_extract(line, '(?i)key:[ \t]*(.+)', 1), '(?i)hashFiles[(]') AS s FROM l),
        b AS (SELECT *, max(CASE WHEN c THEN k END) OVER (PARTITION BY i ORDER BY k) AS c_at, max(CASE WHEN y THEN k END) OVER (PARTITION BY i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y_at FROM m),
        n AS (SELECT i, count(*) FILTER (y AND s AND c_at IS NOT NULL AND (y_at IS NULL OR y_at < c_at)) AS static_keys FROM b GROUP BY 1)
        SELECT workflow_id, collected_at, regexp_matches(text, '{_INSTALL}') AND NOT regexp_matches(text, '(?i)(actions/cache|cache:)') AS install_without_cache, static_keys FROM t JOIN n USING (i)""",
    "action_usage_distinct": r"""
        WITH t AS (SELECT workflow_id, collected_at, regexp_extract_all(coalesce(full_workflow_yaml, ''), 'uses: ([A-Za-z0-9_./-]+@[A-Za-z0-9_./-]+)', 1) AS u FROM yaml_reference)
        SELECT workflow_id, collected_at, len(u) AS uses, len(list_distinct(list_transform(u, lambda x: split_part(x, '@', 1)))) AS actions,
               len(list_filter(list_distinct(u), lambda x: regexp_matches(x, '(?i)@[0-9a-f]{40}$'))) AS pinned_sha,
               len(list_filter(list_distinct(u), lambda x: regexp_matches(x, '(?i)@v[0-9][a-z0-9_.-]*$'))) AS pinned_tag,
               len(list_filter(list_distinct(u), lambda x: NOT regexp_matches(x, '(?i)@[0-9a-f]{40}$') AND NOT regexp_matches(x, '(?i)@v[0-9][a-z0-9_.-]*$') AND regexp_matches(x, '@[A-Za-z]'))) AS pinned_branch FROM t""",
    "yaml_roundtrip_metrics": """
        WITH j AS (SELECT l_orderkey, l_suppkey, count(*) AS k, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL),
        o AS (SELECT l_orderkey, count(*) AS jobs, sum(k)::BIGINT AS steps, max(k) AS m, sum(r)::BIGINT AS c FROM j GROUP BY 1),
        p AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)
        SELECT l_orderkey, 2 + 3 * jobs + (jobs - 1) + steps + c AS lines_of_yaml, jobs AS num_jobs, steps AS num_steps, m AS max_sequential_steps, jobs AS vertical_depth, c AS num_conditionals, jobs - 1 AS num_job_dependencies,
               parts AS num_unique_external_actions, parts AS num_marketplace_actions, round(steps / jobs, 2) AS avg_steps_per_job, round(c / (jobs + steps), 3) AS conditional_density, jobs > 1 AS has_job_dependencies FROM o JOIN p USING (l_orderkey)""",
    "primary_per_project": f"""
        WITH d AS (SELECT DISTINCT project_id, full_path FROM yaml_reference WHERE project_id IS NOT NULL),
        r AS (SELECT *, coalesce(list_position({list(PREFERRED)}, lower(split_part(replace(full_path, chr(92), '/'), '/', -1))), 0) AS p, count(*) OVER (PARTITION BY project_id) AS workflows_in_project FROM d),
        k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN p = 0 THEN 100 ELSE p END, full_path) AS i FROM r)
        SELECT project_id, full_path, workflows_in_project FROM k WHERE i = 1""",
    "project_ids": r"""
        SELECT DISTINCT file, CASE WHEN regexp_matches(replace(file, chr(92), '/'), '(^|/)[^/@]+@[^/]+/') THEN replace(regexp_extract(replace(file, chr(92), '/'), '(?:^|/)([^/@]+@[^/]+)/', 1), '@', '/') END AS project_id FROM parsing_errors_java""",
    "stratified_allocation": f"WITH {_FRAME} SELECT * FROM a",
    "stratified_sample_md5": f"WITH {_FRAME} SELECT workflow_id, language, stratum FROM m",
    "sample_repair": f"""
        WITH {_FRAME},
        need AS (SELECT workflow_id AS failed, language, stratum, md5('42' || workflow_id::VARCHAR) AS lot FROM m WHERE num_steps > 15),
        spare AS (SELECT workflow_id, language, stratum, md5('42' || workflow_id::VARCHAR) AS lot FROM r WHERE NOT num_steps > 15 AND workflow_id NOT IN (SELECT workflow_id FROM m)),
        h1 AS (SELECT a.failed, b.workflow_id AS replacement, 'stratum' AS level FROM (SELECT *, row_number() OVER (PARTITION BY language, stratum ORDER BY lot, failed) AS k FROM need) a JOIN (SELECT *, row_number() OVER (PARTITION BY language, stratum ORDER BY lot, workflow_id) AS k FROM spare) b USING (language, stratum, k)),
        n2 AS (SELECT * FROM need WHERE failed NOT IN (SELECT failed FROM h1)), s2 AS (SELECT * FROM spare WHERE workflow_id NOT IN (SELECT replacement FROM h1)),
        h2 AS (SELECT a.failed, b.workflow_id AS replacement, 'group' AS level FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY lot, failed) AS k FROM n2) a JOIN (SELECT *, row_number() OVER (PARTITION BY language ORDER BY lot, workflow_id) AS k FROM s2) b USING (language, k)),
        n3 AS (SELECT * FROM n2 WHERE failed NOT IN (SELECT failed FROM h2)), s3 AS (SELECT * FROM s2 WHERE workflow_id NOT IN (SELECT replacement FROM h2)),
        h3 AS (SELECT a.failed, b.workflow_id AS replacement, 'any' AS level FROM (SELECT *, row_number() OVER (ORDER BY lot, failed) AS k FROM n3) a JOIN (SELECT *, row_number() OVER (ORDER BY lot, workflow_id) AS k FROM s3) b USING (k))
        SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3""",
    "sample_summary": f"""
        WITH e AS (SELECT list_distinct([quantile_cont(file_size_kb, 0.0), quantile_cont(file_size_kb, 1 / 3), quantile_cont(file_size_kb, 2 / 3), quantile_cont(file_size_kb, 1.0)]).list_sort() AS e FROM sample_metadata),
        w AS (SELECT workflow_id, max(num_steps) AS num_steps FROM sample_metadata GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY num_steps, workflow_id) AS r, count(*) OVER () AS n FROM w WHERE num_steps IS NOT NULL),
        t AS (SELECT workflow_id, CASE WHEN r <= 1 + (n - 1) / 3 THEN 'simple' WHEN r <= 1 + 2 * ((n - 1) / 3) THEN 'moderate' ELSE 'complex' END AS kind FROM r),
        l AS (SELECT m.*, kind, CASE WHEN file_size_kb IS NULL THEN NULL WHEN len(e) = 1 THEN 'small' ELSE ['small', 'medium', 'large'][least(len(list_filter(e[2:], lambda x: x < file_size_kb)) + 1, len(e) - 1)] END AS size FROM sample_metadata m LEFT JOIN t USING (workflow_id), e)
        SELECT {_LANG} AS language, count(*) AS workflows, count(DISTINCT project_id) AS unique_projects, round(avg(file_size_kb), 2) AS avg_file_size_kb, round(avg(num_jobs), 2) AS avg_jobs, round(avg(num_steps), 2) AS avg_steps,
               {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("simple", "moderate", "complex"))}, {", ".join(f"count(*) FILTER (size = '{k}') AS {k}_files" for k in ("small", "medium", "large"))} FROM l GROUP BY 1""",
    "csv_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "classify_lines": f"""
        WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT lower(trim(line, ' ')) AS line, count(*) AS w FROM l GROUP BY 1)
        SELECT {_cases("line", classify.name_rules(), "'other'")} AS label, sum(w)::BIGINT AS lines FROM w GROUP BY 1""",
    "classify_actions": f"""
        WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(full_workflow_yaml, 'uses: ([A-Za-z0-9_./-]+)', 1)) AS uses FROM yaml_reference), a AS (SELECT uses, lower(uses) AS s, starts_with(lower(uses), './') OR contains(lower(uses), '.github/actions/') AS own FROM u)
        SELECT uses, CASE {" ".join(f"WHEN {_action_test(test, words)} THEN '{label}'" for label, test, words in classify.action_rules())} ELSE 'external_action' END AS label FROM a""",
    "dag_depth_recursive": """
        WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderkey) OVER w AS p, lag(o_orderstatus) OVER w AS ps FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
        e AS (SELECT o_custkey, p AS a, o_orderkey AS b FROM o WHERE ps = o_orderstatus),
        w AS (SELECT o_custkey, b AS n, 2 AS depth FROM e UNION ALL SELECT e.o_custkey, e.b, w.depth + 1 FROM w JOIN e ON e.o_custkey = w.o_custkey AND e.a = w.n)
        SELECT o_custkey, max(depth) AS depth, false AS cyclic FROM w GROUP BY 1""",
}
