"""Labels, patterns, runs and pairs against plain code."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.llm import runs
from weftline.llm.labels import Resolver, distance, latest, pieces, resolve
from weftline.llm.pairs import cooccurrence
from weftline.llm.pattern_tree import PatternTree
from weftline.llm.patterns import frequent_patterns
from weftline.llm.runs import collapse_events, p2_runs
from weftline.session import ship

LABELS = ["Fetch Sources", "Assemble Bundle", "Assemble Bundles", "Draft Release Note", "Draft Release Notes", "Scan Image", "Sign Image", "Type Check"]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.mark.parametrize(
    "text, label",
    [
        ("fetch_sources", "Fetch Sources"), ("FETCH-SOURCES #4", "Fetch Sources"), ("FetchSources (linux; gcc-13)", "Fetch Sources"), ("[Build > Release] Fetch Sources", "Fetch Sources"), ("Step 12: Fetch Sources …", "Fetch Sources"), ("04 fetch.sources!", "Fetch Sources"),
        ("Fetch oSurces v2", "Fetch Sources"), ("Ftech Sources, attempt 3", "Fetch Sources"), ("Ｆｅｔｃｈ Ｓｏｕｒｃｅｓ", "Fetch Sources"), ("Fetch\xa0Sou​rces", "Fetch Sources"), ("**Assemble Bundle**", "Assemble Bundle"), ("assemblebundles 2", "Assemble Bundles"),
        ("Assemble Bundel", "Assemble Bundle"), ("Assemble Bundlse", "Assemble Bundles"), ("Draft Release Notse", "Draft Release Notes"), ("Draft Release Noet", "Draft Release Note"), ("🚀 Sgin Image", "Sign Image"), ("Scna Image", "Scan Image"), ("Something Else", "Something Else"),
    ],
)
def test_spellings(text, label):
    assert Resolver(LABELS)(text) == label


def test_every_single_slip_finds_its_label():
    find = Resolver(LABELS)
    for key, shown in list(find.exact.items()):
        for at in range(1, len(key) - 1):
            swapped = key[:at] + key[at + 1] + key[at] + key[at + 2 :]
            assert find(swapped) == shown
    assert distance("abcd", "acbd", 2) == 1 and distance("abc", "xyz", 2) == 3 and distance("", "ab", 2) == 2


def test_nearest_of_many():
    rng = random.Random(1)
    find = Resolver(["".join(rng.choice("abcde") for _ in range(rng.randint(3, 14))) for _ in range(300)])
    for key in list(find.exact)[::3]:
        changed = list(key)
        for _ in range(2):
            i = rng.randrange(len(changed))
            changed[i : i + 1] = rng.choice([[], [changed[i], "f"], ["f"], changed[i : i + 2][::-1]])
            changed = changed or ["f"]
        changed = "".join(changed)
        assert {k for k in find.exact if distance(changed, k, 2) <= 2} <= find._near(changed)
    assert Resolver(["Lint", "Scan Image"])("Linx") == "Lint" and Resolver(["Lint"])("Lixx") == "Lixx"


def test_pieces():
    long = "x" * 80
    assert pieces(f"A ({long} -> {long}) → B") == [f"A ({long} -> {long}) ", " B"] and len(pieces("(" * 50_000)) == 0
    assert pieces("A → B->C=>D > E ⟶ F; G â\x86\x92 H") == ["A ", " B", "C", "D ", " E ", " F", " G ", " H"]
    assert pieces("A (x; y) → [p > q] B") == ["A (x; y) ", " [p > q] B"]
    assert pieces(None) == pieces("") == pieces(" → ; -> ") == []
    assert len(pieces(" -> ".join(["x"] * 20_000))) == 20_000


def test_latest_and_resolve(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, "Fetch Sources", "Java", [1]), (1, t + timedelta(1), "Type Check → Type Check", "Java", [1, None]), (1, t + timedelta(1), "Type Check → Type Check", "Java", [1, None]), (2, None, None, None, None), (None, t, "x", "Java", [1])]
    frame = spark.createDataFrame(rows, "workflow_id bigint, processed_at timestamp, sequence_id string, language string, step_seconds array<int>")
    out = {r.workflow_id: r.l for r in latest(frame).select("workflow_id", resolve(F.col("sequence_id"), LABELS).alias("l")).collect()}
    assert out == {1: ["Type Check", "Type Check"], 2: []}
    assert latest(frame.limit(0)).collect() == []


def contains(sequence, pattern):
    rest = iter(sequence)
    return all(x in rest for x in pattern)


@pytest.mark.parametrize("seed", range(4))
def test_tree_supports(seed):
    rng = random.Random(seed)
    counts = Counter("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(60))
    tree = PatternTree(dict(counts))
    found = dict(tree.mine(lambda _, n: n > 0, 3, different=False))
    for n in (1, 2, 3):
        for p in map("".join, itertools.product("abcd", repeat=n)):
            assert found.get(p, 0) == sum(c for s, c in counts.items() if contains(s, p))


def test_frequent_patterns(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y"]), [rng.choice("abcdef") for _ in range(rng.randint(1, 9))]) for _ in range(150)]
    rows += [("hot", list("abc"))] * 200 + [("few", list("abc"))] * 4 + [(None, list("abc")), ("x", None), ("x", []), ("x", [None, "a"])]
    frame = spark.createDataFrame([(s, l, 1, 2) for s, l in rows], "scope string, labels array<string>, n int, support int")
    for size in (50_000, 20):
        found = {(r.scope, tuple(r.pattern)): (r.support, r.total) for r in frequent_patterns(frame.repartition(3), "scope", "labels", 5, (20, 100), tree=size).collect()}
        wanted = {}
        for scope in ("x", "y", "hot", "few"):
            own = [l for s, l in rows if s == scope and l]
            for n in (3, 4):
                for p in itertools.permutations("abcdef", n):
                    support = sum(contains(l, p) for l in own)
                    if support >= 5 and support * 100 >= 20 * len(own):
                        wanted[scope, p] = (support, len(own))
        assert found == wanted
    assert frequent_patterns(frame.limit(0), "scope", "labels").collect() == []
    assert frequent_patterns(frame.where("scope = 'few'"), "scope", "labels").collect() == []


@pytest.mark.parametrize("block", [4096, 2])
def test_runs_of_sequences(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(runs, "BLOCK", block)
    t = datetime(2024, 1, 1)
    rows = [
        (1, t, "Type Check → type_check → → Scan Image;Sign Image -> sign image > Sign-Image", [1, None, 5, None, None, 2]), (2, t, "Scan Image", None), (3, t, " → ", []), (4, t, None, None),
        (5, t, "Scan Image → scan image → Type Check", [1, 2]), (6, t, "Scan Image → Sign Image", [None, 3]), (7, t, "Scan Image", [9]), (7, t + timedelta(1), "Sign Image → Sign Image", [None, None]),
    ]
    spark.createDataFrame([(*r, "Java", "extra") for r in rows], "workflow_id bigint, processed_at timestamp, sequence_id string, step_seconds array<int>, language string, label string").write.parquet(f"{tmp_path}/processed_workflows.parquet")
    spark.createDataFrame([(x,) for x in LABELS], "display_label string").write.parquet(f"{tmp_path}/step_labels.parquet")
    found = {}
    for r in p2_runs(spark, str(tmp_path)).orderBy("workflow_id", "first_pos").collect():
        found.setdefault(r.workflow_id, []).append((r.label, r.first_pos, r.last_pos, r.events, r.seconds))
    assert found == {
        1: [("Type Check", 1, 2, 2, 1), ("Scan Image", 3, 3, 1, 5), ("Sign Image", 4, 6, 3, 2)], 2: [("Scan Image", 1, 1, 1, None)],
        5: [("Scan Image", 1, 2, 2, 3), ("Type Check", 3, 3, 1, None)], 6: [("Scan Image", 1, 1, 1, None), ("Sign Image", 2, 2, 1, 3)], 7: [("Sign Image", 1, 2, 2, None)],
    }


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_collapse_events(spark, width):
    rng = random.Random(width)
    rows = [(k, i, rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, None]), "extra") for k in (1, 2, 3) for i in range(40)] + [(None, 1, "a", 1.0, "")]
    rows += [(9, i, "a", 1.0, "") for i in range(50)]
    frame = spark.createDataFrame(rows, "user int, t int, kind string, v double, events string")
    out = collapse_events(frame, "user", ["t"], "t", "kind", "v", (F.col("t") / width).cast("int"))
    found = [(r.user, r.first_at, r.last_at, r.label, r.events, r.total) for r in out.collect()]
    wanted = []
    for k in (1, 2, 3, 9):
        for label, group in itertools.groupby((r for r in rows if r[0] == k), key=lambda r: r[2]):
            group = list(group)
            known = [g[3] for g in group if g[3] is not None]
            wanted.append((k, group[0][1], group[-1][1], label, len(group), sum(known) if known else None))
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert collapse_events(frame.limit(0), "user", ["t"], "t", "kind", "v", F.lit(1)).collect() == []


@pytest.mark.parametrize("chunk", [256, 3, 1])
def test_cooccurrence(spark, chunk):
    rng = random.Random(1)
    baskets = [[rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))] for _ in range(80)] + [None, [None], [None, "a"]] + [list("ab")] * 40
    frame = spark.createDataFrame([(b, 1, 1) for b in baskets], "items array<string>, w int, pair int")
    sets = [set(b or []) - {None} for b in baskets]
    sets = [s for s in sets if s]
    c = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    single = Counter(x for s in sets for x in s)
    out = cooccurrence(frame, "items", chunk).collect()
    assert {(r.item_a, r.item_b): (r.c, r.a, r.b, r.n) for r in out} == {(a, b): (n, single[a], single[b], len(sets)) for (a, b), n in c.items()}
    few = {(r.item_a, r.item_b) for r in cooccurrence(frame, "items", chunk, 5, (20, 100)).collect()}
    assert few == {p for p, n in c.items() if n >= 5 and n * 100 >= 20 * len(sets)}
    assert all(r.lift == pytest.approx(r.c * r.n / (r.a * r.b)) for r in out)
    assert cooccurrence(frame.limit(0), "items", chunk).collect() == []
