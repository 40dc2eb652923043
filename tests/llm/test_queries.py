"""Every registered query of the subpackage on small tables: against its SQL, or whole and within its bounds."""

import glob
import math
import os

import duckdb
import pytest

from weftline.llm import queries
from weftline.session import ship

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if type(value).__name__ == "Decimal":
        value = float(value)
    return round(value, 6) + 0.0 if isinstance(value, float) else value if isinstance(value, (int, bool)) else str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sql, name):
    found = queries.QUERIES[name](ship(spark), FOLDER)
    rows = found.collect()
    wanted = sql.execute(queries.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert bag(found.columns, rows) == bag(columns, wanted.fetchall())


def test_whole_tables(spark, sql):
    run = {n: queries.QUERIES[n](ship(spark), FOLDER).collect() for n in ("p4_found", "p4_files", "p4_rates", "p5_digests", "p7_found", "p7_places", "p7_masked", "p8_ids", "p9_bins", "p10_pieces")}
    count = lambda q: sql.execute(q).fetchone()[0]
    texts, files = count("SELECT count(*) FROM documents"), count("SELECT count(*) FROM yaml_reference")
    assert len(run["p8_ids"]) == texts and len(run["p7_masked"]) == files and {r.workflow_id for r in run["p4_files"]} == {r.workflow_id for r in run["p4_found"]}
    assert {(r.workflow_id, r.line_no) for r in run["p7_places"]} == {(r.workflow_id, r.line_no) for r in run["p7_found"]}
    whole = [r for r in run["p4_rates"] if r.level == 3]
    # a file is a workflow of a project; a null one is a file too
    assert len(whole) == 1 and whole[0].files == count("SELECT count(*) FROM (SELECT project_id, workflow_id, CASE lower(trim(language, E' \\t\\n\\r')) WHEN 'python' THEN 'p' WHEN 'java' THEN 'j' WHEN 'c++' THEN 'c' WHEN 'cpp' THEN 'c' END FROM yaml_reference GROUP BY ALL)")
    sizes = {r.doc_id: len(r.ids) for r in run["p8_ids"]}
    for capacity in {r.max_tokens for r in run["p9_bins"]}:
        bins, held = {}, {}
        for r in run["p9_bins"]:
            if r.max_tokens == capacity:
                bins[r.bin_id] = bins.get(r.bin_id, 0) + r.tokens
                held[r.doc_id] = held.get(r.doc_id, 0) + r.tokens
        assert held == sizes and max(bins.values()) <= capacity and sum(bins.values()) >= 0.9 * capacity * (len(bins) - 1)
    for r in run["p10_pieces"]:
        assert 0 < r.tokens <= r.max_tokens < sizes[r.doc_id]
    assert {(r.max_tokens, r.doc_id) for r in run["p10_pieces"]} == {(m, d) for m in {r.max_tokens for r in run["p10_pieces"]} for d, n in sizes.items() if n > m}
