"""Every catalogue query against its SQL on the same tables, value by value."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from aforo.catalog.queries import QUERIES

SF = os.environ.get("AFORO_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return f"{type(v).__name__} {v}"

    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = entry_module.queries()[name](spark, SF)
    sql = db.execute(entry_module.oracle_sql()[name])
    expected = comparable([d[0] for d in sql.description], sql.fetchall())
    got = comparable(df.columns, df.collect())
    assert got[0] == expected[0]
    assert got[1] == expected[1]


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(entry_module.queries()) & set(entry_module.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "periodo" and df.count() == 4
