"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from sifter.plans.tables import TABLES

QUERIES = E.queries()
SQL = E.oracle_sql()
# Spark simple type -> DuckDB type name (schemas must agree, not only names).
DUCK_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "doc_id" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    got = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got, "no rows"
        return
    rel = duck.sql(f"SELECT * FROM ({SQL[name]}) LIMIT 0")
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for c, t in df.dtypes:
        assert DUCK_TYPE.get(t, t) == dtypes.get(c), (c, t, dtypes.get(c))
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == sorted(cols)
    idx = {c: i for i, c in enumerate(dcols)}
    want = sorted((tuple(_norm(r[idx[c]]) for c in sorted(cols)) for r in res.fetchall()), key=repr)
    assert got == want
