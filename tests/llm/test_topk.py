"""Branch and bound against sorting all scores."""

import math
import random

import duckdb
import numpy as np
import pytest

from jobloom.llm import sql, topk

KIND = "vec_id long, embedding array<float>, label int, id long, v string, ids binary, rank int, g int"


def brute(rows, queries, k, scale=64):
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(scale * float(np.float32(x))) for x in v):
            continue
        w = [math.floor(scale * float(np.float32(x))) for x in v]
        whole[i] = min(whole[i], w) if i in whole else w
    out = []
    for q in sorted({i for i in queries if i in whole}):
        score = lambda w: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], w))))  # noqa: E731, B023
        scores = sorted((-score(w), i) for i, w in whole.items() if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return out


def run(spark, rows, queries, k):
    df = spark.createDataFrame([(i, v, 0, 1, "x", b"", 2, 3) for i, v in rows], KIND)
    wanted = df.where(df.vec_id.isin(list(queries))) if queries else df.limit(0)
    got = topk.top_k(df, wanted, k)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("dims", [1, 5, 16, 17, 40])
def test_equals_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "BLOCKS_PER_TASK", 2)
    rnd = random.Random(dims)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(dims)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [rows[0], rows[0], (5, [9.0] * dims)]  # repeated rows, and an id with two vectors
    rows += [(300, None), (301, [None] * dims), (302, [float("nan")] * dims), (303, [float("inf")] * dims), (None, [1.0] * dims)]
    queries = [0, 20, 40, 60, 80, 200, 300, 301]
    assert run(spark, rows, queries, 7) == brute(rows, queries, 7)


def test_fewer_candidates_than_k_and_uneven_lengths(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5]), (2, []), (3, [0.5, 0.5, 0.5])]
    assert run(spark, rows, [0, 2], 20) == brute(rows, [0, 2], 20)
    assert run(spark, rows[:1], [0], 20) == []
    assert run(spark, rows, [], 20) == []
    assert run(spark, [], [], 20) == []


def test_numbers_beyond_float64_sums(spark):
    rows = [(0, [2.0**40, 3.0, -(2.0**41)]), (1, [1.0, 2.0, 2.0**30]), (2, [2.0**38, 0.5, 1.0]), (3, [1e30, 1e30, 0.0])]
    assert run(spark, rows, [0], 3) == brute(rows, [0], 3)


def test_repeated_ids_and_huge_components(spark):
    """The smallest whole vector of an id counts; 64 times 1e308 is no number."""
    kind = "vec_id long, embedding array<double>"
    rows = [(1, [0.001, 5.0]), (1, [0.002, 1.0]), (20, [1.0, 1.0]), (2, [1e308, 1.0]), (3, [-1e308, 0.0]), (4, [1e300, 0.0])]
    df = spark.createDataFrame(rows, kind)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id = 20"), 5).collect())
    assert got == [(20, 1, 4, (1 << 63) - 1), (20, 2, 1, 64 * 64)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r for r in rows if r[0] != 4])
    small = df.where("vec_id <> 4")
    assert sorted(tuple(r) for r in topk.top_k(small, small.where("vec_id = 20"), 20).collect()) == sorted(con.execute(sql.OP5).fetchall())


def test_candidate_blocks_move_once_per_group_of_query_blocks():
    """Copies of candidate blocks grow with the groups, not with the query blocks."""
    copies = [topk.groups(n, topk.QUERY_BLOCKS_PER_TASK) for n in (1, 16, 17, 160)]
    assert copies == [1, 1, 2, 10]


def test_pruning_drops_most_candidates():
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.normal(0, 0.01, (64, 500)))
    x[:, :20] = np.floor(64 * rng.normal(1, 0.1, (64, 20)))
    search = topk.Search(np.array([-1]), np.full((64, 1), 64.0), 5)
    search.add(np.arange(500), x)
    scores = np.full(64, 64.0) @ x
    assert search.top[0][1].tolist() == topk.best(scores, np.arange(500), 5).tolist()
