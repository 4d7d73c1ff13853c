"""Extendible hashing: every shard fits, buckets split only where needed, SQL agrees."""

from collections import Counter, defaultdict

import duckdb
import pytest

from jobloom.llm import sharding, sql


@pytest.mark.parametrize("limit", [2_000_000, 100_000, 9_000])
def test_equals_sql(spark, limit):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    got = Counter(map(tuple, sharding.shards(docs, limit=limit).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert got == Counter(con.execute(sql.shards(limit, sharding.HASH_BITS)).fetchall())


def held(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.n_bytes
    return sizes


def test_fits_and_splits_only_what_is_too_large(spark, documents):
    docs = documents([(i, "x" * (i % 50)) for i in range(800)], clash=True)
    rows = sharding.shards(docs, limit=900).collect()
    sizes = held(rows)
    assert len(rows) == 800 and all(r.shard_bytes == sizes[r.shard] <= 900 for r in rows)
    names = sorted(sizes)
    for a in names:  # no shard's prefix is another's, and each parent would be too large
        assert not any(b != a and b.startswith(a) for b in names)
        assert sum(s for b, s in sizes.items() if b.startswith(a[:-1])) > 900


def test_repeated_rows_fill_overflow_shards(spark, documents):
    docs = documents([(7, "y" * 100)] * 300 + [(i, "z" * 10) for i in range(20)])
    rows = sharding.shards(docs, limit=1000).collect()
    sizes = held(rows)
    assert len(rows) == 320 and max(sizes.values()) <= 1000
    assert sum(s.count("+") for s in sizes) == 30 and all(r.shard_bytes == sizes[r.shard] for r in rows)


def test_one_key_with_many_texts_still_splits(spark, documents):
    docs = documents([(1, f"text {i} " * 5) for i in range(200)])
    assert max(held(sharding.shards(docs, limit=800).collect()).values()) <= 800


def test_awkward_rows(spark, documents):
    docs = documents([(None, "a"), (None, None), (1, None), (2, ""), (3, "w" * 5000), (4, "é")])
    rows = sharding.shards(docs, limit=1000).collect()
    assert sorted(r.n_bytes for r in rows) == [0, 0, 0, 1, 2, 5000]
    large = [r for r in rows if r.shard_bytes > 1000]
    assert [r.doc_id for r in large] == [3] and sum(r.shard_bytes > 1000 for r in rows) == 1
    assert sharding.shards(docs.limit(0)).count() == 0
    same = documents([(None, None)] * 3)
    assert {r.shard for r in sharding.shards(same, limit=10).collect()} == {"all"}
