"""Orders written as workflow files, parsed again, measured, profiled and held against the rules; SQL finds the same in the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import pipeline, rules, stats, workflow
from weftline.operators.histogram import value_histogram
from weftline.plans.metrics import fisher_sql, kruskal_sql
from weftline.session import once
from weftline.sources.tables import table

#: The lines of a step by the kind of its line item; {p} is the part.
_STEPS = (
    ("action", "uses: shop/part-{p}@v1"),
    ("branch", "uses: shop/part-{p}@main"),
    ("pinned", "uses: Shop/part-{p}@0123456789abcdef0123456789abcdef01234567"),
    ("checkout", "name: Checkout code\n        uses: actions/checkout@v4"),
    ("test", "run: pytest -q part_{p}"),
    ("secret", "name: Part {p}\\n        run: make && zap ${{ secrets.P{p} }}"),
    ("event", "run: zap ${{ github.event.issue.p{p} }}"),
    ("local", "uses: ./tools/part-{p}"),
    ("cache", "uses: actions/cache@v4\\n        with:\\n          key: part-{p}"),
    ("install", "run: pip install part-{p}\\n        continue-on-error: true"),
    ("image", "run: zap {p}\\n        image: zap/part-{p}:latest"),
)
#: Which kind a line item is, in Spark and in DuckDB.
_KIND = "CASE (l_partkey + l_linenumber) % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(_STEPS)) + " END"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of _written(), written and parsed once for all queries of an application."""
    return once(spark, f"orders as files of {folder}", lambda: _written(spark, folder))


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """o_orderkey, text, doc: jobs are suppliers, each needing the one before it, steps line items in order of part and kind."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    # one shuffle for all levels; its number of partitions is kept for the parser
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    kind = F.expr(_KIND)
    body = F.lit(None).cast("string")
    for k, text in _STEPS:
        body = F.when(kind == k, F.replace(F.lit(text.replace("\\n", "\n")), F.lit("{p}"), F.col("l_partkey").cast("string"))).otherwise(body)
    item = F.concat(F.lit("      - "), body, F.when(F.col("l_returnflag") == "R", "\n        if: returned\n").otherwise("\n"))
    step = F.struct("l_partkey", "l_linenumber", item.alias("t"))
    job = lines.groupBy("l_orderkey", "l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["t"]), "").alias("steps"))
    head = F.concat(
        F.lit("  s"), F.col("l_suppkey"), F.when(F.col("l_suppkey") % 2 == 0, ":\n    runs-on: Ubuntu-latest\n").otherwise(":\n    runs-on: ubuntu-22.04\n"), F.when(F.col("l_suppkey") % 3 == 0, "    timeout-minutes: 5\n").otherwise("")
    )
    order = job.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_suppkey", head.alias("head"), "steps"))).alias("j"))
    needs = "transform(j, (x, i) -> concat(x.head, case when i > 0 then concat('    needs: s', cast(j[i - 1].l_suppkey as string), '\\n') else '' end, '    steps:\\n', x.steps))"
    order = order.join(orders, order.l_orderkey == orders.o_orderkey)
    on = F.when(F.col("o_orderstatus") == "F", "on: push\n").when(F.col("o_orderstatus") == "O", "on: [push, pull_request_target]\n").otherwise("on:\n  schedule: [{cron: '0 1 * * *'}]\n  push: {branches: [main]}\n  workflow_dispatch:\n")
    k = F.col("o_orderkey")
    rights = F.when(k % 3 == 0, "permissions: {contents: read}\n").when(k % 3 == 1, "permissions: write-all\n").otherwise("")
    runs = F.when(k % 4 == 0, "concurrency: {group: x, cancel-in-progress: true}\n").when(k % 4 == 1, "concurrency: {group: x}\n").otherwise("")
    text = F.concat(on, rights, runs, F.lit("jobs:\n"), F.array_join(F.expr(needs), ""))
    return order.select("o_orderkey", text.alias("text")).withColumn("language", F.lit("Python")).withColumn("doc", workflow.parsed(F.col("text")))


def yaml_roundtrip_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of every order's workflow: sequence, presence, events, caches, modularity, pins."""
    return pipeline.processed(_documents(spark, folder), ["o_orderkey"])


def yaml_roundtrip_complexity(spark: SparkSession, folder: str) -> DataFrame:
    """What a sampling frame keeps of every order's workflow, with its nesting."""
    docs = workflow.prepared(_documents(spark, folder))
    return docs.select("o_orderkey", F.col("doc.max_nesting_depth").alias("max_nesting_depth"), F.col("doc.full_depth").alias("full_depth"), F.array_join("doc.job_order", ", ").alias("job_order"), *(c.alias(n) for n, c in workflow.complexity("doc").items()))


def _detail(spark: SparkSession, folder: str, enabled_only: bool) -> DataFrame:
    return rules.evaluate(_documents(spark, folder), ["o_orderkey", "language"], enabled_only=enabled_only)


def rule_roundtrip_detail(spark: SparkSession, folder: str) -> DataFrame:
    """o_orderkey, rule_id, violation, outcome, justifiable, of all twenty rules."""
    found = _detail(spark, folder, False)
    return found.select("o_orderkey", "rule_id", "severity", "violation", "outcome", F.when(F.col("violation") == 1, rules.justifiable(F.col("rule_id"), F.col("language"))).alias("justifiable"))


def rule_roundtrip_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rules.scores(_detail(spark, folder, True), ["o_orderkey"])


def rule_roundtrip_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return rules.ranking(_detail(spark, folder, True)).select("rank", "rule_id", "severity", "violations", "total_checked", "prevalence_pct", "risk_score")


def rule_roundtrip_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rules.violation_matrix(_detail(spark, folder, True), ["o_orderkey"])


def _by_status(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    return found.join(table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status_group")), "o_orderkey")


def rule_roundtrip_proportions(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of each rule compared between the statuses of orders."""
    ids = [r.rule_id.replace("-", "_") for r in rules.RULES if r.enabled]
    return stats.fisher(stats.contingency(_by_status(spark, folder, rule_roundtrip_matrix(spark, folder)), "status_group", ids))


def rule_roundtrip_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Scores compared between the statuses of orders."""
    scored = _by_status(spark, folder, rule_roundtrip_scores(spark, folder))
    hist = value_histogram(scored, "status_group", ["compliance_score", "total_violations", "weighted_severity"])
    return stats.kruskal_wallis(hist).withColumn("p_value", F.round("p_value", 8))


QUERIES = {f.__name__: f for f in (rule_roundtrip_proportions, rule_roundtrip_ranks, yaml_roundtrip_profile, yaml_roundtrip_complexity, rule_roundtrip_detail, rule_roundtrip_scores, rule_roundtrip_ranking, rule_roundtrip_matrix)}

#: i: line items with kind and order; j: jobs; o: orders that have any.
_BASE = f"""
    i AS (SELECT *, {_KIND} AS kind, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS job FROM lineitem),
    j AS (SELECT l_orderkey AS o_orderkey, l_suppkey, count(*) AS steps FROM i GROUP BY ALL),
    n AS (SELECT o_orderkey, count(*) AS jobs, sum(steps)::BIGINT AS steps, max(steps) AS longest, count(*) FILTER (l_suppkey % 2 = 0) AS moving, count(*) FILTER (l_suppkey % 3 <> 0) AS untimed, string_agg('s' || l_suppkey, ', ' ORDER BY l_suppkey) AS order_ FROM j GROUP BY 1),
    k AS (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'R') AS ifs, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k, _ in _STEPS)}, {", ".join(f"count(DISTINCT l_partkey) FILTER (kind = '{k}') AS {k}s" for k, _ in _STEPS)} FROM i GROUP BY 1),
    o AS (SELECT * FROM orders JOIN n USING (o_orderkey) JOIN k USING (o_orderkey))"""
#: Violation of each rule from the orders alone.
_RULES = {
    "SEC-01": (5, "Security", "secret > 0"), "SEC-02": (5, "Security", "o_orderkey % 3 = 2"), "SEC-03": (5, "Security", "branch > 0"), "VER-01": (3, "Versioning", "moving > 0"), "REL-01": (3, "Reliability", "untimed > 0"), "REL-02": (4, "Reliability", "install > 0"),
    "WA-01": (5, "Workflow Activator", "o_orderstatus = 'O' AND o_orderkey % 3 <> 0"), "EFF-01": (3, "Efficiency", "install > 0 AND cache = 0"), "EFF-02": (3, "Efficiency", "cache > 0"), "MAINT-01": (3, "Maintainability", "steps > 15"),
    "D1": (4, "Security", "o_orderkey % 3 = 1"), "D2": (5, "Security", "event > 0"), "D3": (3, "Security", "action > 0"), "D4": (1, "Versioning", "pinned > 0"), "D5": (3, "Versioning", "image > 0"), "D6": (2, "Reliability", "o_orderkey % 4 > 1"), "D7": (2, "Reliability", "o_orderkey % 4 = 1"),
    "D8": (2, "Workflow Activator", "o_orderstatus <> 'P'"), "D9": (2, "Workflow Activator", "o_orderstatus = 'P'"), "D10": (2, "Efficiency", "jobs = 1 AND steps >= 6"),
}
_ENABLED = {r: x for r, x in _RULES.items() if "-" in r}
_HELD = lambda which: "d AS (" + " UNION ALL ".join(f"SELECT o_orderkey, '{r}' AS rule_id, {s} AS severity, '{c}' AS category, coalesce({v}, false)::INT AS violation FROM o" for r, (s, c, v) in which.items()) + ")"
#: The label of a kind of step, or its name where it has none.
_LABEL = """CASE kind WHEN 'action' THEN 'shop/part-' || l_partkey WHEN 'branch' THEN 'shop/part-' || l_partkey WHEN 'pinned' THEN 'Shop/part-' || l_partkey WHEN 'checkout' THEN 'Checkout Repository' WHEN 'test' THEN 'Execute Tests'
    WHEN 'secret' THEN 'Compile' WHEN 'event' THEN 'zap ${{ github.event.issue.p' || l_partkey || ' }}' WHEN 'local' THEN './tools/part-' || l_partkey WHEN 'cache' THEN 'Manage Build Cache' WHEN 'install' THEN 'Install Project Dependencies' ELSE 'zap ' || l_partkey END"""
_CALLED = """CASE kind WHEN 'action' THEN 'shop/part-' || l_partkey WHEN 'branch' THEN 'shop/part-' || l_partkey WHEN 'pinned' THEN 'Shop/part-' || l_partkey WHEN 'checkout' THEN 'Checkout code' WHEN 'test' THEN 'pytest -q part_' || l_partkey
    WHEN 'secret' THEN 'Part ' || l_partkey WHEN 'event' THEN 'zap ${{ github.event.issue.p' || l_partkey || ' }}' WHEN 'local' THEN './tools/part-' || l_partkey WHEN 'cache' THEN 'actions/cache' WHEN 'install' THEN 'pip install part-' || l_partkey ELSE 'zap ' || l_partkey END"""
ORACLES = {
    "yaml_roundtrip_profile": f"""
        WITH {_BASE},
        s AS (SELECT l_orderkey AS o_orderkey, job, l_suppkey, CASE WHEN kind = 'secret' THEN 'Build Source Code' ELSE {_LABEL} END AS label, {_CALLED} AS called, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_linenumber) AS pos FROM i),
        f AS (SELECT o_orderkey, label, min(pos) AS pos FROM s GROUP BY ALL),
        q AS (SELECT o_orderkey, string_agg(label, ' → ' ORDER BY pos) AS sequence_id, count(*) AS sequence_length FROM f GROUP BY 1),
        b AS (SELECT o_orderkey, l_suppkey, '[s' || l_suppkey || ']: ' || string_agg(called, ' → ' ORDER BY pos) AS job_text FROM s GROUP BY 1, 2),
        c AS (SELECT o_orderkey, string_agg(job_text, ' || ' ORDER BY l_suppkey) AS job_sequences FROM b GROUP BY 1),
        p AS (SELECT *, actions + branchs + pinneds + (checkout > 0)::INT + (cache > 0)::INT AS total, (checkout > 0)::INT + (test > 0)::INT + (secret > 0)::INT AS present FROM o)
        SELECT o_orderkey, 'Python' AS language, jobs AS num_jobs, steps AS num_steps_total, round(steps / jobs, 2) AS avg_steps_per_job, sequence_id, sequence_length, job_sequences,
               (checkout > 0)::INT AS has_checkout, 0 AS has_setup, (test > 0)::INT AS has_test, (secret > 0)::INT AS has_build, round(present / 4, 2) AS completeness_score,
               CASE o_orderstatus WHEN 'F' THEN 'push' WHEN 'O' THEN 'pull_request_target, push' ELSE 'push, schedule, workflow_dispatch' END AS events, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS num_events,
               CASE WHEN o_orderstatus = 'P' THEN '0 1 * * *' ELSE '' END AS schedule_pattern, 1 AS has_push, 0 AS has_pull_request, (o_orderstatus = 'P')::INT AS has_schedule, (o_orderstatus = 'P')::INT AS has_workflow_dispatch, jobs AS dependency_depth,
               (cache > 0)::INT AS uses_cache, cache AS cache_count, cache AS num_cache_keys, coalesce(cache_keys, '') AS cache_keys,
               0 AS reusable_workflow_count, local AS local_action_count, 0 AS composite_action_count, (secret > 0)::INT AS has_chained_commands, total AS external_actions_count, total AS total_actions, 0 AS uses_reusable_workflows, 0 AS uses_composite_actions, (local > 0)::INT AS uses_local_actions,
               local AS total_modularity_constructs, pinneds AS pinned_to_sha, CASE WHEN total = 0 THEN 0 ELSE round(100 * (pinneds / total), 1) END AS sha_percentage, actions + (checkout > 0)::INT + (cache > 0)::INT AS pinned_to_tag,
               CASE WHEN total = 0 THEN 0 ELSE round(100 * ((actions + (checkout > 0)::INT + (cache > 0)::INT) / total), 1) END AS tag_percentage, branchs AS pinned_to_branch, CASE WHEN total = 0 THEN 0 ELSE round(100 * (branchs / total), 1) END AS branch_percentage, 0 AS unpinned, 0.0 AS unpinned_percentage
        FROM p JOIN q USING (o_orderkey) JOIN c USING (o_orderkey)
        LEFT JOIN (SELECT l_orderkey AS o_orderkey, string_agg('part-' || l_partkey, ' | ' ORDER BY l_suppkey, l_partkey, l_linenumber) AS cache_keys FROM i WHERE kind = 'cache' GROUP BY 1) USING (o_orderkey)""",
    "yaml_roundtrip_complexity": f"""
        WITH {_BASE}
        SELECT o_orderkey, 3 AS max_nesting_depth, CASE WHEN cache > 0 THEN 5 ELSE 4 END AS full_depth, order_ AS job_order, jobs AS num_jobs, steps AS num_steps, longest AS max_steps_per_job, action + branch + pinned + checkout + local + cache AS num_actions_used, test + secret + event + install + image AS num_run_commands,
               (SELECT count(DISTINCT CASE kind WHEN 'action' THEN 'p' || l_partkey WHEN 'branch' THEN 'p' || l_partkey WHEN 'pinned' THEN 'P' || l_partkey WHEN 'checkout' THEN 'c' WHEN 'local' THEN 'l' || l_partkey WHEN 'cache' THEN 'k' END) FROM i WHERE i.l_orderkey = o.o_orderkey) AS num_unique_actions,
               false AS has_matrix, ifs > 0 AS has_conditions, order_ AS job_names FROM o""",
    "rule_roundtrip_detail": f"""
        WITH {_BASE}, {_HELD(_RULES)}
        SELECT o_orderkey, rule_id, severity, violation, CASE violation WHEN 1 THEN 'violation' ELSE 'compliant' END AS outcome,
               CASE WHEN violation = 0 THEN NULL WHEN rule_id = 'SEC-02' THEN 'unless policy' WHEN rule_id IN ('SEC-01', 'SEC-03', 'WA-01', 'EFF-01') THEN 'no' ELSE 'possibly' END AS justifiable FROM d""",
    "rule_roundtrip_scores": f"""
        WITH {_BASE}, {_HELD(_ENABLED)}
        SELECT o_orderkey, 'ok' AS status, sum(violation)::BIGINT AS total_violations, sum(severity * violation)::BIGINT AS weighted_severity, round(1 - sum(severity * violation) / 39, 4) AS compliance_score, coalesce(string_agg(DISTINCT category, ', ' ORDER BY category) FILTER (violation = 1), '') AS categories_violated FROM d GROUP BY 1""",
    "rule_roundtrip_ranking": f"""
        WITH {_BASE}, {_HELD(_ENABLED)},
        g AS (SELECT rule_id, severity, sum(violation)::BIGINT AS violations, count(*) AS total_checked, round(100.0 * sum(violation) / count(*), 1) AS prevalence_pct FROM d GROUP BY 1, 2)
        SELECT row_number() OVER (ORDER BY round(severity * prevalence_pct / 100, 3) DESC, rule_id) AS rank, *, round(severity * prevalence_pct / 100, 3) AS risk_score FROM g""",
    "rule_roundtrip_matrix": f"WITH {_BASE} SELECT o_orderkey, " + ", ".join(f"coalesce({v}, false)::INT AS {r.replace('-', '_')}" for r, (_, _, v) in _ENABLED.items()) + " FROM o",
}
_IDS = [r.replace("-", "_") for r in _ENABLED]
ORACLES["rule_roundtrip_proportions"] = fisher_sql(
    f"vm AS ({ORACLES['rule_roundtrip_matrix']}), b AS (SELECT o_orderstatus AS language, {', '.join(f'{i} = 1 AS {i}' for i in _IDS)} FROM vm JOIN orders USING (o_orderkey)), f AS (UNPIVOT b ON {', '.join(_IDS)} INTO NAME feature VALUE yes)"
)
_SCORED = ("compliance_score", "total_violations", "weighted_severity")
ORACLES["rule_roundtrip_ranks"] = kruskal_sql(
    f"""WITH w AS ({ORACLES['rule_roundtrip_scores']}), l AS (SELECT o_orderstatus AS language, {', '.join(f'{c}::DOUBLE AS {c}' for c in _SCORED)} FROM w JOIN orders USING (o_orderkey)),
    u AS (UNPIVOT l ON {', '.join(_SCORED)} INTO NAME metric VALUE value), g AS (SELECT * FROM u)"""
)
