"""Operators on hand-made rows: worked examples, nulls, ties, repeated rows, empty tables."""

import io
import json
import math
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions.numbers import p_text, two_sided
from weftline.functions.table import register
from weftline.functions.text import canonical_language
from weftline.operators import bands, classify, dag, describe, labels, pipeline, rules, sampling, scopes, sequences, stats, workflow
from weftline.operators.histogram import quantiles, running, value_histogram
from weftline.operators.numbering import numbered
from weftline.plans.metrics import NUMERIC
from weftline.session import ship
from weftline.sources import files, sinks
from weftline.streaming import ingest


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def measured(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("doc", workflow.parsed(F.col("text")))
    rows = workflow.prepared(rows)
    return rows.select("id", "doc", *(c.alias(n) for n, c in workflow.metrics("doc", "text").items()), *(c.alias(f"p_{n}") for n, c in workflow.profile("doc").items())).orderBy("id").collect()


def test_metrics_of_worked_examples(spark):
    def jobs(needs):
        return "on: push\njobs:\n" + "".join(f"  {j}:\n    needs: {json.dumps(n)}\n    steps: [{{run: x}}]\n" for j, n in needs.items())

    matrix = "jobs:\n  a:\n    strategy:\n      matrix:\n        os: [1, 2, 3]\n        v: [1, 2, 3, 4]\n        include: [{os: 1}]\n        exclude: [{os: 2}]\n    steps: []\n"
    uses = "jobs:\n  a:\n    uses: o/r/.github/workflows/x.yml@v1\n  b:\n    steps:\n" + "".join(f"      - uses: {u}\n" for u in ("./local", "o/r@v1", "o/r@v2", "o/r/sub@" + "a1" * 20, "actions/x@v4", "docker://img", "plain@main"))
    rows = measured(
        spark,
        jobs({"A": [], "B": ["A"], "C": ["B"], "D": ["C"]}), jobs({"A": [], "B": "A", "C": "A", "D": "A"}), jobs({"A": [], "B": ["A"], "C": ["A"], "D": ["B", "C"]}), jobs({"A": ["B"], "B": ["A"]}), jobs({"A": ["nobody"]}),
        matrix, uses, "jobs:\n  test:\n    steps: [{if: x, run: 'a && b'}, {run: c}]\n    if: y\n", "a: {b: {c: [{d: 1}]}}\njobs: {}\n",
    )
    assert [(r.num_job_dependencies, r.vertical_depth) for r in rows[:5]] == [(3, 4), (3, 2), (4, 3), (2, 2), (1, 1)]
    assert [r.p_dependency_depth for r in rows[:5]] == [4, 2, 3, 3, 1]
    assert rows[5].matrix_size == 12 and rows[5].has_matrix
    u = rows[6]
    assert (u.num_local_actions, u.num_reusable_workflows, u.num_unique_external_actions, u.num_marketplace_actions) == (1, 1, 4, 1)
    assert (u.p_pinned_to_sha, u.p_pinned_to_tag, u.p_pinned_to_branch, u.p_unpinned, u.p_total_actions) == (1, 3, 1, 1, 6)
    assert (rows[7].num_conditionals, rows[7].conditional_density, rows[7].p_has_chained_commands) == (2, 0.667, 1)
    assert (rows[8].max_nesting_depth, rows[8].doc.full_depth, rows[8].job_parallelism, rows[8].avg_steps_per_job) == (3, 4, 0, 0.0)


def test_status_of_odd_files(spark):
    texts = [None, "", "a: [", "- 1", "a: 1", "jobs: 3", "jobs:\n  a:\n    steps:\n", "jobs:\n  a:\n    steps: [{uses: 3}]", "jobs:\n  a: text\n", "on: [push, Pull_request]\njobs: {}", "jobs:\n  a:\n    steps: []\n" * 2]
    rows = measured(spark, *texts)
    assert [r.doc.status for r in rows] == ["empty", "empty", "parse_error", "not_mapping", "missing_jobs", "missing_jobs", "extract_error", "extract_error", "ok", "ok", "ok"]
    assert rows[9].doc.events == ["pull_request", "push"] and rows[8].num_jobs == 0 and rows[8].job_parallelism == 1


def test_job_order_and_depth():
    assert workflow.job_order({"d": ["b", "c"], "b": ["a"], "c": ["a"], "a": []}) == ["a", "b", "c", "d"]
    assert workflow.job_order({"a": ["b"], "b": ["a"], "c": ["x"]}) == ["b", "a", "c"]
    chain = {str(i): [str(i + 1)] for i in range(200)} | {"200": []}
    assert workflow.chain_depth(chain) == 201 and len(workflow.job_order(chain)) == 201


def test_text_functions(spark):
    rows = spark.createDataFrame([("a\r\nb\rc\n",), ("",), (None,), ("x",), ('q\\n"\n\r\\',), ("\x00\\\x00\\\\n",)], "t string")
    out = rows.select(workflow.line_count(F.col("t")).alias("n"), workflow.unescaped(workflow.escaped(F.col("t"))).eqNullSafe(F.col("t")).alias("same"), workflow.escaped(F.col("t")).contains("\n").alias("fed")).collect()
    assert [r.n for r in out] == [3, 0, 0, 1, 3, 1] and all(r.same for r in out) and not any(r.fed for r in out)
    langs = spark.createDataFrame([(" CPP\t",), ("c++",), ("PYTHON ",), ("Rust",), (None,)], "l string").select(canonical_language(F.col("l")).alias("l")).collect()
    assert [r.l for r in langs] == ["C++", "C++", "Python", None, None]
    paths = spark.createDataFrame([("x/o@r/a.yml",), ("D:\\s\\o@r\\.github\\workflows\\a.yml",), ("a.yml",), (None,)], "p string").select(workflow.project_of(F.col("p")).alias("p")).collect()
    assert [r.p for r in paths] == ["o/r", "o/r", None, None]


def test_sequences(spark):
    rows = spark.createDataFrame([("x", "A → B->C"), ("x", "A â\x86\x92 B => C"), ("x", "A > A"), ("y", " → "), ("y", None), (None, "B")], "scope string, s string").select("scope", sequences.steps(F.col("s")).alias("labels"))
    merged = sequences.merged(rows, "scope", "labels")
    top = {(r.scope, r.sequence): (r["count"], r.percentage, r.rank) for r in sequences.top_sequences(merged).collect()}
    assert top[("x", "A → B → C")] == (2, 66.67, 1) and top[("Overall", "A → B → C")][0] == 2 and ("y", "") not in top
    assert {(r.from_step, r.to_step): r["count"] for r in sequences.transitions(merged).where("scope = 'Overall'").collect()} == {("A", "B"): 2, ("B", "C"): 2, ("A", "A"): 1}
    assert {(r.step_a, r.step_b): r["count"] for r in sequences.pair_counts(merged).where("scope = 'x'").collect()} == {("A", "B"): 2, ("A", "C"): 2, ("B", "C"): 2}
    wide = spark.createDataFrame([("x", [f"l{i:02}" for i in range(23)]), ("x", ["l00", "l22", "l00"])], "scope string, labels array<string>")
    by_chunk = [sorted(map(tuple, sequences.pair_counts(sequences.merged(wide, "scope", "labels"), 1000, c).collect())) for c in (256, 7)]
    assert by_chunk[0] == by_chunk[1] and len(by_chunk[0]) == 2 * 23 * 22 // 2
    assert sequences.end_ngrams(merged.limit(0)).collect() == [] and sequences.common_sequences(merged.limit(0)).collect() == []


def test_bands(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", None), ("b", float("nan")), (None, 5.0)], "g string, v double")
    out = {(r.g, r.band): (r["count"], r.percentage) for r in bands.band_distribution(rows, "g", ["v"]).collect()}
    assert out[("a", "low")] == (7, 70.0) and out[("a", "high")] == (1, 10.0) and sum(n for (g, _), (n, _) in out.items() if g == "Overall") == 11
    assert ("b", "low") not in out
    labelled = bands.quantile_labels(rows.where("g = 'a'"), "v", ["s", "m", "l"]).orderBy("v").collect()
    assert [r.label for r in labelled] == list("ssssmmmlll")
    same = bands.quantile_labels(spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double"), "v", ["s", "m"]).collect()
    assert [r.label for r in same] == ["s", "s", None]
    five = bands.tertiles(spark.createDataFrame([(i, 7) for i in range(5)], "id int, v int"), "v", ["id"]).orderBy("id").collect()
    assert [r.tertile for r in five] == ["simple", "simple", "moderate", "complex", "complex"]


def test_descriptives(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0), (None, 0.0)], "g string, v double")
    out = {r.g: r for r in describe.descriptives(rows, "g", ["v"]).collect()}
    assert (out["a"].n, out["a"]["mean"], out["a"]["median"], out["a"]["std"]) == (3, 2.3333, 2.0, 1.5275)
    assert out["b"]["std"] is None and out["Overall"].n == 5
    assert describe.descriptives(rows.limit(0), "g", ["v"]).collect() == []


def test_rank_tests(spark):
    import itertools

    groups = {"a": [1, 2, 2, 5], "b": [2, 3, 7], "c": [0, 0, 9, 9, 4]}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    hist = value_histogram(rows, "g", ["v"])
    pooled = sorted(v for vs in groups.values() for v in vs)
    rank = lambda v, p: sum(x < v for x in p) + (p.count(v) + 1) / 2
    n = len(pooled)
    h = 12 / (n * (n + 1)) * sum(sum(rank(v, pooled) for v in vs) ** 2 / len(vs) for vs in groups.values()) - 3 * (n + 1)
    h /= 1 - sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled)) / (n**3 - n)
    found = stats.kruskal_wallis(hist).collect()[0]
    assert found.h == pytest.approx(h, abs=5e-4) and found.p_value == pytest.approx(math.exp(-h / 2))
    for r in stats.mann_whitney(hist).collect():
        a, b = groups[r.group_1], groups[r.group_2]
        u = sum((x > y) + (x == y) / 2 for x, y in itertools.product(a, b))
        assert r.u == u and r.delta == pytest.approx(2 * u / (len(a) * len(b)) - 1, abs=1e-6) and 0 <= r.p_value <= 1
    assert stats.kruskal_wallis(hist.where("group <> 'c'")).collect() == []
    flat = value_histogram(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "g string, v double"), "g", ["v"])
    assert stats.kruskal_wallis(flat).collect()[0].h is None and {r.z for r in stats.mann_whitney(flat).collect()} == {None}


def test_running_counts(spark):
    hist = spark.createDataFrame([("k", float(v), 2) for v in (-5, -0.5, 0, 0.001, 3, 1e9)], "k string, value double, cnt int")
    assert [r.before for r in running(hist, ["k"]).orderBy("value").collect()] == [0, 2, 4, 6, 8, 10]


def test_proportions(spark):
    table = spark.createDataFrame([("f", "a", 3, 1), ("f", "b", 0, 4), ("g", "a", 0, 4), ("g", "b", 0, 4)], "feature string, group string, yes bigint, no bigint")
    out = stats.fisher(table).collect()
    assert len(out) == 1 and out[0].p_value == pytest.approx(2 / 14, abs=1e-8)
    chi = {r.feature: r for r in stats.chi_square(table).collect()}
    assert (chi["g"].statistic, chi["g"].p_value, chi["g"].note) == (0.0, 1.0, "no variation") and chi["f"].note == "expected count below 5"
    shown = spark.createDataFrame([(0.00001,), (0.5,), (None,)], "p double").select(p_text(F.col("p")).alias("p")).collect()
    assert [r.p for r in shown] == ["1.0000e-05", "0.5000", None]
    z = spark.createDataFrame([(1.959964,), (None,)], "z double").select(two_sided(F.col("z")).alias("p")).collect()
    assert z[0].p == pytest.approx(0.05, abs=1e-6) and z[1].p is None


def test_fisher_against_all_tables():
    import itertools

    for table in itertools.product(range(0, 7), repeat=4):
        y1, n1, y2, n2 = table
        if not (y1 + y2 and n1 + n2 and y1 + n1 and y2 + n2):
            continue
        ways = lambda k: math.comb(y1 + n1, k) * math.comb(y2 + n2, y1 + y2 - k)
        ks = range(max(0, y1 + y2 - y2 - n2), min(y1 + n1, y1 + y2) + 1)
        assert stats.fisher_p(*table) == pytest.approx(sum(ways(k) for k in ks if ways(k) <= ways(y1)) / sum(map(ways, ks)), rel=1e-9), table
    began = time.perf_counter()
    assert 0 < stats.fisher_p(500_000_000, 500_000_000, 500_030_000, 499_970_000) < 1
    assert stats.fisher_p(10**9, 10, 10**9, 10) == pytest.approx(1.0) and stats.fisher_p(10**6, 0, 0, 10**6) == 0.0
    assert time.perf_counter() - began < 2


def test_tails(spark):
    from weftline.functions.numbers import chi_tail, exact_u

    rows = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (11.070497693516351, 5), (0.0, 3), (None, 1), (18.307038053275146, 10)], "x double, k int")
    assert [r.p and round(r.p, 9) for r in rows.select(chi_tail(F.col("x"), F.col("k")).alias("p")).collect()] == [0.05, 0.05, 0.05, 1.0, None, 0.05]
    import itertools

    for n1, n2 in ((1, 1), (2, 5), (4, 4), (3, 8)):
        us = [sum(x > y for x in c for y in range(n1 + n2) if y not in c) for c in itertools.combinations(range(n1 + n2), n1)]
        asked = spark.createDataFrame([(float(u), n1, n2) for u in range(n1 * n2 + 1)], "u double, a int, b int")
        for r in asked.select("u", exact_u(F.col("u"), F.col("a"), F.col("b")).alias("p")).collect():
            high = max(r.u, n1 * n2 - r.u)
            assert r.p == pytest.approx(min(1, 2 * sum(u >= high for u in us) / len(us)))
    two = spark.createDataFrame([("f", "a", 30, 20), ("f", "b", 15, 35)], "feature string, group string, yes bigint, no bigint")
    r = stats.chi_square(two).first()
    assert r.statistic == pytest.approx(sum((abs(o - e) - 0.5) ** 2 / e for o, e in ((30, 22.5), (20, 27.5), (15, 22.5), (35, 27.5))), abs=1e-4) and 0.004 < r.p_value < 0.006


def test_numbering(spark):
    rows = [("hot", i % 5, i) for i in range(500)] + [(None, 1, i) for i in range(20)] + [("x", None, 1), ("x", 3, 2)]
    frame = spark.createDataFrame(rows, "g string, v int, id int")
    out = numbered(frame.repartition(7), ["g"], [F.col("v"), F.col("id")], "place").collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for g in ("hot", None, "x"):
        assert [tuple(r)[:3] for r in sorted((r for r in out if r.g == g), key=lambda r: r.place)] == sorted((r for r in rows if r[0] == g), key=key)
        assert sorted(r.place for r in out if r.g == g) == list(range(1, sum(r[0] == g for r in rows) + 1))
    assert numbered(frame.limit(0), [], [F.col("v")]).collect() == [] and sorted(r.k for r in numbered(frame, [], [F.col("id")]).collect()) == list(range(1, 523))


def test_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    values = {"a": [*rng.integers(-5, 9, 400).astype(float), *rng.normal(0, 1e6, 50)], "b": [4.5], "c": [1e15 + x for x in range(7)]}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.73, 1.0]
    for r in quantiles(value_histogram(rows, "g", ["v"]), ["group", "metric"], shares).collect():
        assert list(r.p) == pytest.approx(np.quantile(values[r.group], shares).tolist(), rel=1e-12) and r.n == len(values[r.group])
    spread = {r.g: r["std"] for r in describe.descriptives(rows, "g", ["v"]).collect()}
    assert spread["c"] == pytest.approx(np.std(range(7), ddof=1), abs=1e-4) and spread["b"] is None


def test_samples(spark):
    rows = spark.createDataFrame([(i, "g%d" % (i % 3 > 0), "s%d" % (i % 7)) for i in range(500)], "id int, g string, s string")
    one = {r.id for r in sampling.stratified_sample(rows, "id", "g", "s", 60).collect()}
    again = {r.id for r in sampling.stratified_sample(rows.repartition(7), "id", "g", "s", 60).collect()}
    assert len(one) == 60 and one == again
    small = sampling.allocate(rows.limit(5), "g", "s", 60).agg(F.sum("wanted")).collect()[0][0]
    assert small == 5
    assert sampling.stratified_sample(rows.limit(0), "id", "g", "s", 60).collect() == []


def test_chains(spark):
    edges = [("a", 1, 2), ("a", 2, 3), ("a", 1, 3), ("a", 1, 2), ("b", 1, 2), ("c", 1, 2), ("c", 2, 1), ("d", 1, 2), ("d", 2, 3), ("d", 3, 2), ("e", None, 1)]
    out = {r.g: (r.depth, r.cyclic) for r in dag.longest_chains(spark.createDataFrame(edges, "g string, x int, y int"), "g", "x", "y").collect()}
    assert out == {"a": (3, False), "b": (2, False), "c": (None, True), "d": (None, True)}


def test_classifier(spark):
    cases = [
        (("Run unit tests", None, None, None), "execute_tests"), ((None, "actions/cache/restore@v3", None, None), "manage_build_cache"), ((None, "./local", "pytest", None), "composite"), ((None, "x/y@v1", "pytest", None), "external_action"), ((None, None, "pytest -q", None), "execute_tests"),
        ((None, None, None, None), "other"), (("zzz", None, "zzz", None), "other"), (("", "Docker/Login-Action-x@v1", None, None), "configure_cloud_resources"), ((None, "./.github/actions/prepare_buildozer", None, None), "prepare_build_environment"), ((None, "o/install-poetry-x@v1", None, None), "install_project_dependencies"),
        ((None, "o/releaser", None, None), "publish_release"), ((None, "o/my-spec@v1", None, None), "execute_tests"), (("Generate the network model", None, None, None), "generate_network_model"), (("Rename artifact", None, None, None), "rename_artifact"),
        ((None, None, "pytest --cov=x", "Python"), "generate_test_coverage"), ((None, None, "pytest --cov=x", "Java"), "execute_tests"), ((None, None, "./gradlew check", "Java"), "execute_tests"), ((None, None, "ninja\n", "C++"), "compile_source_code"), ((None, None, "echo done", "C++"), "log_information"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, n string, u string, r string, l string").orderBy("i")
    out = rows.select(classify.classify_step(F.col("n"), F.col("u"), F.col("r"), F.col("l")).alias("l")).collect()
    assert [r.l for r in out] == [label for _, label in cases]
    assert len(classify.name_rules()) == len(labels.LABELS) == 136 and len(labels.ACTIONS) == 100
    shown = spark.createDataFrame([("static_analysis",), ("build_project",), ("Part 7",), ("unnamed_step",), (None,)], "l string").select(classify.shown(F.col("l")).alias("s")).collect()
    assert [r.s for r in shown] == ["Run Static Analysis", "Build Project", "Part 7", "Unnamed Step", None]


def test_pipeline(spark):
    text = """on: [push]
jobs:
  b:
    needs: a
    steps:
      - run: |

          pytest -q %s
          x
      - uses: zzz/qqq@v1
      - text
      - {}
      - run: pytest again
  c: nothing
  a:
    steps:
      - uses: actions/checkout@v4
      - name: Set up JDK 11
        uses: actions/setup-java@v2
  d:
    steps: []
""" % ("y" * 70)
    called = text.replace("[push]", "workflow_call")
    texts = [text, called, "jobs: {}", "jobs:\n  a:\n    steps: []", "a: [", None, text]
    rows = spark.createDataFrame([(i, t, "Python", 1) for i, t in enumerate(texts)], "id int, text string, language string, num_jobs int").withColumn("doc", workflow.parsed(F.col("text")))
    out = pipeline.processed(rows, ["id"]).orderBy("id").collect()
    assert [r.id for r in out] == [0, 6] and out[0][1:] == out[1][1:]
    r = out[0]
    assert r.sequence_id == "Checkout Repository → Setup Runtime Environment → Execute Tests → zzz/qqq → unknown → Unnamed Step" and r.sequence_length == 6
    assert r.job_sequences == "[a]: actions/checkout → Set up JDK 11 || [b]: pytest -q " + "y" * 50 + "... → zzz/qqq → unknown → unnamed_step → pytest again || [d]: (empty)"
    assert (r.num_jobs, r.num_steps_total, r.avg_steps_per_job, r.has_checkout, r.has_setup, r.has_test, r.has_build, r.completeness_score, r.dependency_depth) == (4, 7, 1.75, 1, 1, 1, 0, 0.75, 2)
    c = workflow.prepared(rows.where("id = 0")).select(*(c.alias(n) for n, c in workflow.complexity("doc").items())).first()
    assert tuple(c) == (4, 6, 5, 3, 2, 3, False, False, "b, c, a, d")
    assert pipeline.processed(rows.limit(0), ["id"]).collect() == []


def test_workflow_steps_in_sql(spark):
    register(spark)
    spark.createDataFrame([(1, "jobs:\n  a:\n    steps: [{run: x}, {uses: o/r@v1, name: n}]\n"), (2, "a: ["), (3, None)], "id int, text string").createOrReplaceTempView("files")
    out = spark.sql("SELECT id, s.* FROM files, LATERAL workflow_steps(text) s ORDER BY id, position").collect()
    assert [tuple(r) for r in out] == [(1, "ok", "a", 1, None, None, "x"), (1, "ok", "a", 2, "n", "o/r@v1", None), (2, "parse_error", None, None, None, None, None), (3, "empty", None, None, None, None, None)]


def test_pivot_and_guide(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "x", 1), ("a", "y", 5), ("b", "z", 7)], "k string, c string, v int")
    assert sorted(map(tuple, scopes.pivot_first(rows, ["k"], "c", ["x", "y"], "v").collect())) == [("a", 1, 5), ("b", None, None)]
    assert len(bands.guide()) == 76 and {m for m, *_ in bands.guide()} == set(NUMERIC)
    values = spark.createDataFrame([("p", float(v)) for v in (0, 0, 1, 5, 6, 51)] + [("p", None), ("p", float("nan"))], "g string, matrix_size double")
    out = bands.fixed_bands(values, "g", spark.createDataFrame(bands.guide(), "metric string, label string, lo double, hi double")).collect()
    assert {r.label: r["count"] for r in out} == {"none": 2, "small": 2, "moderate": 1, "very_large": 1}


def test_rules(spark):
    good = "on: push\npermissions: {contents: read}\nconcurrency: {group: x, cancel-in-progress: true}\njobs:\n  a:\n    runs-on: ubuntu-22.04\n    timeout-minutes: 5\n    steps:\n      - uses: actions/cache@v4\n        with:\n          key: x-${{ hashFiles('a') }}\n      - run: pip install x\n"
    bad = "on: [pull_request_target, push]\njobs:\n  a:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: o/r@main\n      - uses: o/r@v1\n      - run: echo ${{ secrets.X }} ${{ github.event.issue.title }}\n        continue-on-error: true\n" + "      - run: x\n" * 15
    static = "on: push\npermissions: write-all\nconcurrency: x\njobs:\n  a:\n    timeout-minutes: 5\n    steps:\n      - uses: actions/cache@v4\n        with:\n          key: fixed\n      - run: pip install x\n"
    texts = [("good", good), ("bad", bad), ("static", static), ("broken", "a: ["), ("none", None)]
    rows = spark.createDataFrame(texts, "id string, text string").withColumn("doc", workflow.parsed(F.col("text")))
    detail = rules.evaluate(rows, ["id"], enabled_only=False)
    hits = {}
    for r in detail.where("violation = 1").collect():
        hits.setdefault(r.id, set()).add(r.rule_id)
    assert hits["good"] == {"D8"}
    assert {"SEC-01", "SEC-02", "SEC-03", "VER-01", "REL-01", "REL-02", "WA-01", "MAINT-01", "D2", "D3", "D6", "D8", "D10"} <= hits["bad"]
    assert {"EFF-02", "D1"} <= hits["static"] and "EFF-01" not in hits["static"]
    scored = {r.id: r for r in rules.scores(rules.evaluate(rows, ["id"]), ["id"]).collect()}
    assert scored["good"].compliance_score == 1.0 and scored["broken"].compliance_score == 0.0 and scored["none"].total_violations == 0
    ranked = rules.ranking(rules.evaluate(rows, ["id"])).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 11)) and {r.total_checked for r in ranked} == {3}
    assert {r.id: r.SEC_01 for r in rules.violation_matrix(rules.evaluate(rows, ["id"]), ["id"]).collect()}["bad"] == 1


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "w" / "java_yml_files" / "o@r"
    folder.mkdir(parents=True)
    (folder / "a.yml").write_bytes(b"a: \xff\n")
    (folder / "b.yaml").write_text("jobs: {}")
    (folder / "c.txt").write_text("no")
    found = {r.workflow_file: r for r in files.workflow_files(spark, str(tmp_path / "w")).collect()}
    assert set(found) == {"a.yml", "b.yaml"} and found["a.yml"].project_id == "o/r" and found["a.yml"].language == "java" and found["a.yml"].content == "a: �\n"
    zips = tmp_path / "z"
    zips.mkdir()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("d/x.yml", "a: 1")
    (zips / "ok.zip").write_bytes(packed.getvalue())
    (zips / "bad.zip").write_bytes(b"nothing")
    damaged = bytearray(packed.getvalue())
    damaged[damaged.index(b"a: 1")] ^= 1
    (zips / "half.zip").write_bytes(bytes(damaged))
    assert sorted((r.path or "", bytes(r.content or b""), r.error is None) for r in files.zipped_files(spark, str(zips)).collect()) == [("", b"", False), ("d/x.yml", b"", False), ("d/x.yml", b"a: 1", True)]
    assert files.extract(spark, str(zips), str(tmp_path / "kept")).count() == 3
    (zips / "bad.zip").unlink()
    assert files.extract(spark, str(zips), str(tmp_path / "kept")).count() == 3 and files.extract(spark, str(zips), str(tmp_path / "kept"), force=True).count() == 2
    narrow, side = files.without_content(files.workflow_files(spark, str(tmp_path / "w")), "full_path", "content")
    assert "content" not in narrow.columns and side.columns == ["full_path", "content"] and side.count() == 2
    rows = spark.createDataFrame([("a\nb", 'q"x'), (None, ",")], "c1 string, c2 string")
    assert sinks.write_csv(rows, str(tmp_path / "out"), bom=True) == 2
    back = files.delimited(spark, str(tmp_path / "out"), ["c1", "c2"])
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    with pytest.raises(ValueError):
        files.delimited(spark, str(tmp_path / "out"), ["c3"])
    assert sorted(map(tuple, files.robust(spark, str(tmp_path / "out"), ["c1", "c2"]).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    (tmp_path / "tabs.tsv").write_text('\ufeffa\tb\n1\t"x\ny"\n')
    (tmp_path / "plain.tsv").write_text("q\tb\tc\n1\t2\t3\t4\n5\n")
    assert [tuple(r) for r in files.robust(spark, str(tmp_path / "tabs.tsv"), ["a", "b"]).collect()] == [("1", "x\ny")]
    assert [tuple(r) for r in files.robust(spark, str(tmp_path / "plain.tsv"), ["a", "b", "c"]).collect()] == [("1", "2", "3\t4")]
    with pytest.raises(ValueError):
        files.robust(spark, str(tmp_path / "tabs.tsv"), ["a", "b", "z"])
    spaced = spark.createDataFrame([("  a ", "x")], "c1 string, c2 string")
    assert sinks.write_csv(spaced, str(tmp_path / "spaced")) == 1
    lines = spark.createDataFrame([("1\t2\t3\t4",), ("1",), ("1\t2\t",)], "value string")
    assert sorted(map(tuple, files.ragged(lines, ["a", "b", "c"]).collect())) == [("1", "2", ""), ("1", "2", "3\t4")]
    parsed = spark.createDataFrame([("x", "a: ["), ("y", "a: 1"), ("z", "jobs: {}")], "f string, text string").withColumn("doc", workflow.parsed(F.col("text")))
    good, skipped, errors = sinks.quarantine(parsed, "f")
    assert [r.f for r in good.collect()] == ["z"] and [r.file for r in skipped.collect()] == ["y"] and [r.file for r in errors.collect()] == ["x"]
    assert "c2" in sinks.report("T", rows)


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(1, "jobs:\n  a:\n    steps: [{run: x}]\n"), (2, "a: [")], "id int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_metrics(spark, str(tmp_path / "in"), rows.schema, "text", ["id"])
    ingest.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    ingest.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.id, r.num_steps) for r in out if r.id == 1) == [(1, 1), (1, 1)] and {r.status for r in out} == {"ok", "parse_error"}


def test_pins(spark):
    kinds = {"o/r": "unpinned", "o/r@" + "A1b2" * 10: "sha", "o/r@V1": "tag", "o/r@v1.2-rc": "tag", "o/r@v1 ": "tag", "o/r@main": "branch", "o/r@feat/x@v2": "unpinned", "o/r@v1/x": "branch", "o/r@1.0": "unpinned", "o/r@": "unpinned"}
    rows = spark.createDataFrame([(u,) for u in kinds], "u string")
    assert {r.u: r.k for r in rows.select("u", F.expr(workflow.pin_kind("u")).alias("k")).collect()} == kinds


def test_project_choice(spark):
    rows = spark.createDataFrame([("p", "p/z.yml"), ("p", "p/build.yml"), ("p", "p/ci.yml"), ("q", "q/b.yml"), ("q", "q/a.yml")], "project string, path string")
    out = {r.project: (r.path, r.workflows_in_project) for r in workflow.workflow_order(rows, "project", "path", ["ci.yml", "build.yml"]).collect()}
    assert out == {"p": ("p/ci.yml", 3), "q": ("q/a.yml", 2)}


@pytest.mark.parametrize("one_task", [100_000, 3])
def test_long_chains(spark, one_task):
    n = 600
    edges = [("chain", i, i + 1) for i in range(n)] + [("ring", i, (i + 1) % n) for i in range(n)] + [("tail", i, i + 1) for i in range(n)] + [("tail", n, n - 1), ("self", 1, 1)]
    edges += [("fork", 0, 1), ("fork", 1, 2), ("fork", 2, 9), ("fork", 0, 9), ("fork", 9, 10), ("fork", 9, 11), ("fork", 11, 12), ("both", 1, 2), ("both", 5, 6), ("both", 6, 5), ("unreached", 1, 2), ("unreached", 3, 4), ("unreached", 4, 3)]
    edges += [("ladder", i, j) for i in range(6) for j in (i + 1, i + 2)]
    found = dag.longest_chains(spark.createDataFrame(edges, "g string, x int, y int"), "g", "x", "y", one_task).collect()
    out = {r.g: (r.depth, r.cyclic) for r in found}
    assert out == {"chain": (n + 1, False), "ring": (None, True), "tail": (None, True), "self": (None, True), "fork": (6, False), "both": (None, True), "unreached": (None, True), "ladder": (7, False)}


def test_aliases_that_loop_or_explode():
    began = time.perf_counter()
    loop = workflow.parse_document("a: &x {b: *x}\njobs: {}\n")
    bomb = "a0: &a0 [x, x, x, x, x, x, x, x, x]\n" + "".join(f"a{i}: &a{i} [{', '.join([f'*a{i - 1}'] * 9)}]\n" for i in range(1, 12)) + "on: *a11\njobs: {}\n"
    deep = workflow.parse_document("[" * 200_000 + "]" * 200_000)
    assert loop["status"] == "extract_error" and "cycle" in loop["error"] and workflow.parse_document(bomb)["status"] == "extract_error" and deep["status"] == "parse_error"
    shared = workflow.parse_document("a: &x {b: {c: 1}}\nd: [*x, *x]\njobs: {}\n")
    assert (shared["max_nesting_depth"], shared["full_depth"]) == (2, 3)
    assert time.perf_counter() - began < 5


def test_walks_with_cycles():
    import random

    def tried(needs, in_cycle):
        walk = lambda j, above: in_cycle if j in above else 1 + max((walk(x, above | {j}) for x in needs[j] if x in needs), default=0)
        return max((walk(j, frozenset()) for j in needs), default=0)

    rng = random.Random(1)
    for _ in range(500):
        needs = {str(i): [str(rng.randint(0, 8)) for _ in range(rng.randint(0, 3))] for i in range(rng.randint(0, 7))}
        assert [workflow.chain_depth(needs, c) for c in (0, 1)] == [tried(needs, c) for c in (0, 1)], needs
    began = time.perf_counter()
    ladder = {f"{i}{s}": [f"{i + 1}a", f"{i + 1}b"] for i in range(60) for s in "ab"} | {"60a": ["60b"], "60b": ["60a"]}
    assert workflow.chain_depth(ladder) == 62 and workflow.chain_depth(ladder | {"60a": ["0a"]}) > 60
    assert workflow.chain_depth({str(i): [str(i + 1)] for i in range(20_000)}) == 20_000
    assert time.perf_counter() - began < 2


def test_samples_of_repeated_keys(spark):
    kinds = "id int, g string, s string"
    hot = spark.createDataFrame([(1 if i % 3 == 0 else i % 4, "g", "s") for i in range(3000)], kinds)
    assert sampling.stratified_sample(hot, "id", "g", "s", 100).count() == 100
    nulls = spark.createDataFrame([(None if i < 80 else i, "g", "s") for i in range(100)], kinds)
    found = [r.id for r in sampling.stratified_sample(nulls, "id", "g", "s", 60).collect()]
    assert len(found) == 60 and set(range(80, 100)) <= set(found)
