"""Queries against their SQL over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from sievecraft.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"neardup_components_family"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - SLOW))
def test_query_equals_sql(spark, small, sql, name):
    df = catalogue.QUERIES[name](spark, small)
    got = sql.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in df.columns) for r in df.collect()) == want
