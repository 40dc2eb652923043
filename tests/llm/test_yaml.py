"""Well-formed and broken YAML streams, the derivatives, and the queries' operator."""

import time

import pytest
from pyspark.sql import functions as F

from weftline.llm import derivatives
from weftline.llm.derivatives import Language
from weftline.llm.yaml_check import failure, p4_rates, yaml_failure

GOOD = [
    None, "", "\n", "# only a comment", "---", "---\n...\n", "a: 1\nb: 2\n", "a:\n- 1\n- 2\nb: x", "a:\n  - b: 1\n    c: 2\n  - - 1\n    - 2\n", "--- text\n--- {a: 1}\n",
    "a: 1\n...\n%YAML 1.2\n---\nb: 2\n", "a: 1\na: 2\n", "? a\n: b\n? [c]\n", "a: &x 1\nb: *x\n", "a: &x.y [1]\nb: *x.y\n", "&k a: 1\n? *k\n: 2\n", "[a, b: c, {d: e, f}, ]", '{"a":1, "b":[2]}',
    "{a\n : b}", "a: [\n  b,\n  c\n  ]\n", "a: |\n  x: [\n   - }\n\n  #y\nb: 1", "a: |2-\n    x\n  y\n", "a: >+ # c\n\n  x\n", "- |\n x\n-\n y\n", "a: 'it''s'\n", 'a: "x\\n\\u00e9\\\n  y"\n', "a: x # c\nb: y#z\n", "a: http://x/y:z\n",
    "a: b\n  c\n   d\n", "a: - b".replace("- ", "-"), "a:\tb\n", "\t# comment\na: 1\n", "a: 1\n \t\nb: 2\n", "a: !!str 1\nb: !local x\nc: !<tag:x> y\n", "%TAG !e! tag:e:\n---\na: !e!x 1\n", "\ufeffa: 1\n",
    "a: \x85b\n", "a: '\x7f'\n", "a: \U0001f600\n", "a: 1\r\nb: 2\r\n", "a: 1\rb: 2\r", "- a\n-\n- c\n", "key with spaces: 1\n", "a: [x, 'y', \"z\"] # c\n", "a: {}\n", "- &a a\n- !!int 3\n", "a:\n  b\n", "a: \"multi\n  line\"\n", "%:\n".replace("%", "x"),
    "- ? a\n  : b\n", "a: |\n\n\nb: 1\n", "a: -1\nb: ?x\nc: :y\n", "a: 'x': ".replace("': ", "'"), "<<: {a: b}\n", "'a': 1\n\"b\" : 2\n", "!docs/** \n", "- !docs/**\n", "--- |\n a\n", "a: >\n  x\n\n   y\n  z\n", "a: b: ".replace("b: ", "b:c"), "[[a, b], {c: [d]}]: e\n",
]
BAD = [
    "a: b: c\n", "a:\n  b: 1\n c: 2\n", "a: [1, 2\nb: 3\n", "a: {x: 1\nb: 3\n", "a: 'x\n", 'a: "x\n', "a: \"\\q\"\n", "a: 'b' c\n", "\ta: 1\n", "a:\n\tb: 1\n", "a: *x\n", "- *.py\n", "- *\n", "a: &x 1\n---\nb: *x\n", "b: *x\na: &x 1\n", "a: `b`\n", "a: @b\n", "a: %b\n",
    "a\nb: 1\n", "a: 1\nb\n", "a: 1\n- b\n", "- a\nb: 1\n", "a: - b\n", "a: \x07\n", "a: \x00\n", "a: x\x1b[0m\n", "a: \x7f\n", "a: b\ufeffc\n", "a: |x\n  y\n", "a: |\n    \n  x\n", "a: |0\n x\n", "<<<<<<< HEAD\na: 1\n=======\nb: 2\n>>>>>>> x\n", "a: [,]\n", "a: [1,,2]\n", "{a: b: c}\n",
    "a: [x]y\n", 'a: "x"#c\n', "a: [x]#c\n", "%YAML 2.0\n---\na\n", "%YAML 1.2\n%YAML 1.2\n---\na\n", "%YAML 1.2\na: 1\n", "a: 1\n%YAML 1.2\n---\nb\n", "a: !x!y z\n", "a: &x &y b\n", "a: &x *y\n", "--- a: b\n", "--- - a\n", "a: [\nb\n]\n", 'a: "x\ny"\n', "a: \"x\n---\ny\"\n", "a: [x\n---\n", "... x\n", "]\n", "}\n", "a: ]\n", "[a\n]: b\nc\n", "-\t- a\n", "a: 'b': c\n", "'a\n b': c\n", "a: 1\n  b: 2\n", "[-]\n", "- [a, b\n", "[a]]\n", "a: !<x\n", "x: |\n  a\n b\n",
]


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    assert failure(text) is None


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    assert failure(text) is not None


def test_place_and_cause():
    assert failure("a: 1\nb: [1,\n") == (2, "end")
    assert failure("a: 1\nb: 'x") == (2, "end")
    assert failure("a: 1\nb: 2\n c: 3\nd: 4\n")[0] == 3
    assert failure("a: 1\nb: \x01\n") == (2, "character")
    assert failure("a: 1\nb: c: d\n") == (2, "token")
    assert failure("a: 1\n" * 50_000) is None
    assert failure("[" * 500 + "]" * 500) is None
    assert failure("[" * 500 + "]" * 499)[1] == "end"


def test_deep_nesting_is_linear(monkeypatch):
    deep = 100_000
    began = time.perf_counter()
    assert failure("[" * deep + "]" * deep) is None
    assert failure("[" * deep + "]" * (deep - 1))[1] == "end"
    assert failure("{a: " * 20_000 + "}" * 20_001) is not None
    assert failure("- " * 5_000 + "x") is None
    assert time.perf_counter() - began < 8
    monkeypatch.setattr(derivatives, "MOST", 500)  # the memory starts afresh many times inside a stream
    assert failure("[" * 3_000 + "]" * 3_000) is None and failure("[" * 3_000 + "]" * 3_001)[1] == "token"


def test_many_signs_in_quotes():
    assert failure("- '\x7f'\n" * 20_000) is None and failure("- '\x7f'\n" * 20_000 + "- \x7f\n") == (20_001, "token")


def test_rates(spark, tmp_path):
    rows = [(1, "p/a", "java", "a: ["), (1, "p/a", "java", "a: 1"), (2, "p/a", " JAVA", "a: 1"), (3, "p/a", None, None), (4, None, "cpp", ""), (5, None, "cpp", "a: 'x")]
    spark.createDataFrame(rows, "workflow_id bigint, project_id string, language string, full_workflow_yaml string").write.parquet(f"{tmp_path}/yaml_reference.parquet")
    out = {(r.level, r.project_id, r.language): (r.files, r.broken, r.rate) for r in p4_rates(spark, str(tmp_path)).collect()}
    assert out == {
        (0, "p/a", "Java"): (2, 1, 0.5), (0, "p/a", None): (1, 0, 0.0), (0, None, "C++"): (2, 1, 0.5), (1, "p/a", None): (3, 1, 0.333333), (1, None, None): (2, 1, 0.5),
        (2, None, "Java"): (2, 1, 0.5), (2, None, None): (1, 0, 0.0), (2, None, "C++"): (2, 1, 0.5), (3, None, None): (5, 2, 0.4),
    }


def test_derivatives():
    g = Language("s")
    g.rules = {"s": g.alt(g.EMPTY, g.seq(g.token("("), g.name("s"), g.token(")"), g.name("s")))}
    assert g.failure("(()())()") is None
    assert g.failure("") is None
    assert g.failure("(()") == 3
    assert g.failure("())(") == 2


def test_column(spark):
    rows = spark.createDataFrame([(1, "a: 1"), (2, "a: [") , (3, None), (4, ""), (2, "a: [")], "id int, text string")
    out = rows.select("id", yaml_failure(F.col("text")).alias("f")).collect()
    assert sorted(r.id for r in out if r.f.line is not None) == [2, 2]
    assert rows.limit(0).select(yaml_failure(F.col("text"))).collect() == []


@pytest.mark.parametrize("first", ["\x7f", "\x80", "\x9f", "\ufffe", "\uffff"])
def test_first_character(first):
    assert failure(first + "a: 1\n") == (1, "token")
    assert failure("\ufeff" + first + "a: 1\n") is not None
    assert failure("\x85a: 1\n") is None and failure("\ufeffa: 1\n") is None
