"""Every registered query of the subpackage, against its SQL where it has any."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from jobloom.llm import queries as _  # noqa: F401  (registers them)
from jobloom.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(str(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(str(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want and got
