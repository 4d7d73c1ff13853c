"""Every registered query against its SQL, at the smallest scale."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from contract import load_all
from contract.fixtures import TABLES
from contract.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    return None if x is None else str(x)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(value(r[i]) for i in at) for r in res.fetchall())
    assert got == want
    assert got, "no rows"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
