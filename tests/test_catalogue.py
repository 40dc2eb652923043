"""Every registered query with a check in SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalogue, reports

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
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if type(value).__name__ == "Decimal":
        value = float(value)
    return round(value, 6) + 0.0 if isinstance(value, float) else value if isinstance(value, (int, bool)) else str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    found = entry.queries()[name](spark, FOLDER)
    rows = found.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    wanted = sql.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert bag(found.columns, rows) == bag(columns, wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lines_of_all_documents(spark, sql):
    lines = sum(r.lines for r in entry.queries()["classify_lines"](spark, FOLDER).collect())
    assert lines == sql.execute("SELECT sum(len(string_split(text, chr(10)))) FROM documents").fetchone()[0]


@pytest.mark.parametrize("name, heads", [("metrics_report", 5), ("patterns_report", 6), ("sample_report", 2), ("compliance_report", 2)])
def test_reports(spark, name, heads):
    text = getattr(reports, name)(entry.ship(spark), FOLDER)
    assert sum(set(line) == {"="} for line in text.splitlines()) == 2 * heads and len(text) > 500
