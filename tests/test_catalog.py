"""Every join query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from deltaloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    found = con.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert normal(map(tuple, df.select(*(f"`{c}`" for c in columns)).collect())) == normal([tuple(r[i] for i in at) for r in found.fetchall()])


def test_contract(spark):
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["n", "p"]
