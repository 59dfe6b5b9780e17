"""Every query with a SQL twin gives the same rows in Spark and DuckDB (sf0.001)."""
import math

import duckdb
import pytest

import __spark_entry__ as E

TABLES = ["lineitem", "events"]
CORPUS = {n for n in E.queries() if n.startswith("op") and n[2:3].isdigit()} | {"pipeline"}     # tested with their operators


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - CORPUS))
def test_query_matches_sql(spark, duck, sf_small, name):
    sdf = E.queries()[name](spark, sf_small)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order_s = sorted(range(len(sdf.columns)), key=lambda i: sdf.columns[i])
    order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
    srows = sorted((tuple(_norm(r[i]) for i in order_s) for r in sdf.collect()), key=repr)
    drows = sorted((tuple(_norm(r[i]) for i in order_d) for r in res.fetchall()), key=repr)
    assert srows == drows


def test_every_query_registered_has_sql():
    assert set(E.queries()) - CORPUS == set(E.oracle_sql()) - CORPUS


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["ado_id", "label", "n"]
