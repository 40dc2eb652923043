"""Samples and digests against their targets and exact ranks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import digest, sampling
from weftline.llm.digest import LEVELS, METRICS, _added, compress, digests, keys, last_places, merged, numbers, once, p5_found, percentiles
from weftline.llm.sampling import _repairs, proportional_sample, systematic
from weftline.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.mark.parametrize("bucket", [200_000, 7])
def test_systematic(spark, monkeypatch, bucket):
    monkeypatch.setattr(sampling, "BUCKET", bucket)
    rows = [(i, "a", 0.25) for i in range(100)] + [(i, "b", 0.1) for i in range(100, 300)] + [(300, None, 1.0), (301, "c", None), (302, "c", 7.0)]
    frame = spark.createDataFrame(rows, "id int, cat string, p double").withColumns({c: F.lit(1) for c in ("part", "c", "spot", "bucket", "upto", "draw")})
    out = systematic(frame, "id", "cat", "p").collect()
    chosen = {c: sum(r.chosen for r in out if r.cat == c) for c in ("a", "b", "c", None)}
    assert len(out) == len(rows) and 24 <= chosen["a"] <= 26 and 19 <= chosen["b"] <= 21 and chosen["c"] == 1 and chosen[None] == 1
    assert sum(chosen.values()) in (46, 47, 48)
    again = systematic(frame.repartition(5), "id", "cat", "p").collect()
    assert {r.id for r in out if r.chosen} == {r.id for r in again if r.chosen}
    assert {r.id for r in out if r.chosen} != {r.id for r in systematic(frame, "id", "cat", "p", seed=1).collect() if r.chosen}
    assert systematic(frame.limit(0), "id", "cat", "p").collect() == []


def test_proportional_sample(spark):
    units = [(i, "big") for i in range(700)] + [(i, "mid") for i in range(700, 990)] + [(i, "tiny") for i in range(990, 1000)] + [(2000, "untargeted"), (2001, None)]
    frame = spark.createDataFrame([(i, c, 5, 1) for i, c in units], "id int, stratum string, n int, target_bp int")
    targets = spark.createDataFrame([("big", 5000, 3), ("mid", 4500, 3), ("tiny", 300, 5), ("poor", 200, 4), (None, 1, 1), ("big", 5000, 3)], "stratum string, target_bp int, min_rows int")
    sample, report = proportional_sample(frame, "id", "stratum", targets)
    rows, found = sample.collect(), {r.stratum: r for r in report.collect()}
    assert len({r.id for r in rows}) == len(rows)
    assert (found["big"].wanted, found["mid"].wanted, found["tiny"].wanted, found["poor"].wanted) == (50, 45, 5, 4)
    # two more than its share for the floor of tiny: what rounding gave the others goes back
    assert (found["big"].selected, found["mid"].selected, found["tiny"].selected, found["poor"].selected) == (50, 45, 5, 0)
    assert found["tiny"].deviation_bp == 200.0 and found["poor"].deviation_bp == -200.0
    assert [found[s].filled for s in ("big", "mid", "tiny", "poor")] == [True, True, True, False]
    assert {s: sum(r.stratum == s for r in rows) for s in found} == {s: r.selected for s, r in found.items()}
    none, empty = proportional_sample(frame.limit(0), "id", "stratum", targets)
    assert none.collect() == [] and not any(r.filled for r in empty.collect())


def test_repairs():
    # (category, available, wanted, exact share)
    plan = [("a", 90, 30, 30.6), ("b", 90, 20, 20.2), ("c", 90, 10, 10.2), ("d", 7, 9, 1.0)]
    lacks, gives = _repairs(plan, {"a": 31, "b": 21, "c": 10, "d": 1}, 62)
    assert lacks == {"d": 6} and gives == {"a", "b"}
    assert _repairs(plan, {"a": 31, "b": 21, "c": 10, "d": 7}, 68) == ({}, {"b"})
    assert _repairs([], {}, 0) == ({}, set())


def test_keys_keep_the_order():
    rng = np.random.default_rng(1)
    values = np.unique(np.r_[0.0, -np.inf, np.inf, 0.3, 0.1 + 0.2, rng.lognormal(0, 9, 5000), -rng.lognormal(0, 9, 5000)])
    places = keys(values)
    assert (np.diff(places) > 0).all() and (numbers(places) == values).all() and keys(np.array([-0.0])) == keys(np.array([0.0]))
    assert numbers(np.array([2**63 - 1, -(2**63)])).tolist() == [np.inf, -np.inf]


@pytest.mark.parametrize("error", [0.5, 0.1, 0.02])
def test_rank_error_survives_merging(error):
    rng = np.random.default_rng(3)
    values = np.r_[rng.lognormal(0, 2, 6000), np.full(3000, 3.0), rng.integers(-9, 9, 1000)]
    rng.shuffle(values)
    k = keys(values)
    parts = []
    for part in np.array_split(k, 7):
        g, p, c = _added(np.zeros(len(part), np.int64), part, np.ones(len(part), np.int64))
        parts.append(compress(g, p, np.zeros(len(p), np.int64), c, np.array([int(len(part) * error / LEVELS)])))
    g, lo, level, n = (np.concatenate(x) for x in zip(*parts))
    g, lo, level, n = compress(g, lo, level, n, np.array([int(len(k) * error / LEVELS)]))
    assert n.sum() == len(k) and len(n) <= 3 * LEVELS / error + LEVELS
    hi = last_places(lo, level)
    for place in np.quantile(k, np.linspace(0, 1, 40)).astype(np.int64):
        sure, maybe = n[hi < place].sum(), n[lo < place].sum()
        assert sure <= (k < place).sum() <= maybe and maybe - sure <= error * len(k)


def test_marks_keep_their_ranks():
    rng = np.random.default_rng(4)
    k = keys(rng.lognormal(0, 2, 20_000))
    marks = np.unique(np.r_[k[:5], keys(np.array([0.5, 3.0, -1.0]))])
    g, p, c = _added(np.zeros(len(k), np.int64), k, np.ones(len(k), np.int64))
    _, lo, level, n = compress(g, p, np.zeros(len(p), np.int64), c, np.array([200]), (np.zeros(len(marks), np.int64), marks))
    hi = last_places(lo, level)
    assert len(n) < 5000
    for m in marks:
        assert n[hi < m].sum() == (k < m).sum() and n[lo <= m].sum() == (k <= m).sum()


@pytest.mark.parametrize("gathered", [2_000_000, 20_000])
def test_rank_error_of_many_values(spark, monkeypatch, gathered):
    """1.2 million values through digests() and merged(): the error stays within its bound, marks are exact."""
    monkeypatch.setattr(digest, "GATHERED", gathered)
    error, figures = 1 / 100, [1.0, 7.25]
    rows = spark.range(1_200_000).select((F.col("id") % 3).cast("int").alias("day"), F.when(F.col("id") % 10 < 3, F.lit(7.25)).otherwise(F.exp(F.randn(7) * 2) - F.lit(0.5)).alias("v"))
    values = np.sort(np.array([r[0] for r in rows.select("v").collect()]))
    days = digests(rows, ["day"], ["v"], error, {"v": figures})
    whole = merged(days, [], error, {"v": figures}).collect()
    lo, level, n = (np.array([r[c] for r in whole], np.int64) for c in ("lo", "level", "n"))
    hi = last_places(lo, level)
    assert n.sum() == len(values) and len(n) <= 3 * LEVELS / error + LEVELS and level.max() > 30
    worst = 0
    for v in [*np.quantile(values, np.linspace(0, 1, 60)), *figures]:
        place = keys(np.array([v]))[0]
        sure, maybe, true = n[hi < place].sum(), n[lo < place].sum(), (values < v).sum()
        assert sure <= true <= maybe and (v not in figures or sure == true)
        worst = max(worst, maybe - sure)
    assert 0 < worst <= error * len(values)
    assert n[lo <= keys(np.array([7.25]))[0]].sum() == (values <= 7.25).sum()


def test_digests_of_scopes(spark):
    rng = random.Random(2)
    rows = [(d, rng.choice(["x", None]), float(rng.randint(0, 50)), None) for d in (1, 2) for _ in range(300)] + [(1, "x", v, 1.0) for v in (-1.0, float("nan"), None, float("inf"))]
    frame = spark.createDataFrame([(*r, 1, 1) for r in rows], "day int, lang string, v double, w double, lo int, n int")
    days = digests(frame.repartition(5), ["day", "lang"], ["v", "w"])
    whole = percentiles(merged(days, ["lang"]), ["lang"], [0.1, 0.5, 0.9])
    out = {(r.lang, r.metric): r for r in whole.collect()}
    for lang in ("x", None):
        own = sorted(r[2] for r in rows if r[1] == lang and r[2] is not None and r[2] == r[2])
        assert out[lang, "v"].n == len(own)
        assert list(out[lang, "v"]["values"]) == [own[-(-len(own) * q // 10) - 1] for q in (1, 5, 9)]
    assert out["x", "w"].n == 4 and (None, "w") not in out
    assert digests(frame.limit(0), ["day", "lang"], ["v"]).collect() == []


def test_repeated_rows_count_once(spark):
    rows = [(1, "d", "java", 3, 1.0), (1, "d", "java", 3, 1.0), (1, "e", None, -1, float("nan")), (None, "d", "cpp", 5, None), (None, "d", "cpp", 5, None)]
    frame = spark.createDataFrame(rows, "workflow_id bigint, snapshot_day string, language string, a int, b double")
    out = sorted((r.language or "", r.a, r.b) for r in once(frame, ["a", "b"]).collect())
    assert out == [("", None, None), ("C++", 5.0, None), ("C++", 5.0, None), ("Java", 3.0, 1.0)]


def test_figure_beside_values(spark, tiny, tmp_path):
    metric = METRICS[0]
    rows = spark.read.parquet(f"{tiny}/workflow_metrics.parquet")
    rows.withColumn(metric, F.lit(0.1 + 0.2)).write.parquet(f"{tmp_path}/workflow_metrics.parquet")
    spark.createDataFrame([("Overall", metric, 0.3)], "language string, metric string, p90 double").write.parquet(f"{tmp_path}/comprehensive_descriptive_statistics.parquet")
    spark.createDataFrame([(metric, 0.1 + 0.2)], "metric string, p70_cutpoint double").write.parquet(f"{tmp_path}/percentile_thresholds.parquet")
    assert [tuple(r) for r in p5_found(spark, str(tmp_path)).collect()] == [("p90", "Overall", metric)]
