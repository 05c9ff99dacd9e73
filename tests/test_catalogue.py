"""Every registered query runs on the smallest tables; those with SQL equal DuckDB's result."""

import math
import os

import duckdb
import pytest

from lodestone import catalogue

FOLDER = "/root/testdata/sf0.001"
NAMES, ORACLES = sorted(catalogue.queries()), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.4f}"
    return None if value is None else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert names
        return
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_oracles_have_queries():
    assert set(ORACLES) <= set(NAMES) and len(ORACLES) > 100


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_llm():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "lodestone")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "lodestone.llm" not in text.read(), f
