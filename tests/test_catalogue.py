"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os
import re

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not re.match(r"op\d+_", n)])
def test_same_rows(spark, duck, name):
    mine = entry.queries()[name](spark, SF)
    theirs = duck.sql(entry.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in mine.collect())
    place = [theirs.columns.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[k]) for k in place) for r in theirs.fetchall())


def test_all_search_paths_are_allowed(spark):
    assert entry.queries()["beam_subjectivity"](spark, SF).first()["n_foreign"] == 0
