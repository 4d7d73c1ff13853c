"""Dedupe, ranking and skew joins against plain loops."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from jobloom.operators import dedupe, ranking, skew
from jobloom.schemas import POSTING


def batch(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        company = rnd.choice(["Acme", "Acme Inc", "Beta LLC", "Inc", "Gamma"])
        title = rnd.choice(["Intern", "intern!", "Engineer II", "  ", "Staff Engineer"])
        rows.append((
            seq, f"id{rnd.randrange(120)}", company, title, f"u{seq}",
            rnd.choice(["NYC, NY", "nyc", None, ""]), "", rnd.choice(["workday", "lever", "indeed"]),
            "",
        ))
    return rows


def loop_key(company, title, location):
    import re

    def words(s):
        return re.sub("[^a-z0-9]+", " ", (s or "").lower()).split()

    c = words(company)
    while c and c[-1] in {"inc", "llc"}:
        c = c[:-1]
    t = sorted(words(title))
    if c and t:
        return (tuple(c), tuple(t), tuple(words((location or "").split(",")[0])))
    return None


def loop_dropped(rows):
    owner, dropped = {}, set()
    for r in sorted(rows):
        key = loop_key(r[2], r[3], r[5])
        if key is None:
            continue
        if owner.setdefault(key, r[7]) != r[7]:
            dropped.add(r[0])
    return dropped


@pytest.mark.parametrize("hot_rows", [1, 20, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_cross_source(spark, seed, hot_rows):
    rows = batch(seed)
    df = spark.createDataFrame(rows, POSTING).repartition(5, F.rand(seed))
    marked = dedupe.cross_source_marked(df, hot_rows=hot_rows).collect()
    assert len(marked) == len(rows)
    assert {r.seq for r in marked if r.dropped} == loop_dropped(rows)
    kept = dedupe.cross_source_dedupe(df, hot_rows=hot_rows)
    assert kept.columns == df.columns
    assert kept.count() == len(rows) - len(loop_dropped(rows))


def test_missing_source_counts_as_workday(spark):
    rows = [
        (1, "a", "Acme", "Intern", "", "", "", None, ""),
        (2, "b", "Acme", "Intern", "", "", "", "workday", ""),
        (3, "c", "Acme", "Intern", "", "", "", "lever", ""),
    ]
    kept = dedupe.cross_source_dedupe(spark.createDataFrame(rows, POSTING))
    assert sorted(r.seq for r in kept.collect()) == [1, 2]


def test_first_per_key(spark):
    rows = batch(3)
    df = spark.createDataFrame(rows, POSTING).repartition(7)
    got = {r.job_id: tuple(r) for r in dedupe.first_per_key(df, ["job_id"]).collect()}
    want = {}
    for r in rows:
        want.setdefault(r[1], r)
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [1, 3, 10**6])
def test_join_unique_equals_join(spark, how, hot_rows):
    rnd = random.Random(5)
    facts = [(i, rnd.choice(["hot"] * 5 + ["a", "b", "c", None])) for i in range(300)]
    fact = spark.createDataFrame(facts, "i int, k string")
    unique = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, v int")
    got = skew.join_unique(fact, unique, ["k"], how, "i", hot_rows=hot_rows)
    want = fact.join(unique, "k", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_hot_rows_are_spread(spark):
    fact = spark.range(4000).select("id", F.lit("hot").alias("k"))
    unique = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.join_unique(fact, unique, ["k"], "left", "id", hot_rows=100)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2000


def test_sub_keys_grow_with_the_key(spark):
    df = spark.range(1000).select((F.col("id") % 10 == 0).alias("k"))
    hot = skew.hot_hashes(df, ["k"], hot_rows=90)
    assert sorted(r._salts for r in hot.collect()) == [2, 10]


def test_keys_that_share_a_hash_give_one_row(spark):
    counts = spark.createDataFrame([(7, 5), (7, 6), (8, 5), (9, 1)], "_h bigint, _n bigint")
    assert sorted(map(tuple, skew.largest(counts, 5).collect())) == [(7, 3), (8, 1)]


def test_reduce_makes_the_other_side_unique(spark):
    fact = spark.createDataFrame([(i, "hot" if i < 50 else "a") for i in range(60)], "i int, k string")
    many = spark.createDataFrame([("hot", 3), ("hot", 2), ("a", 1), ("a", 1), ("z", 9)], "k string, v int")
    for hot_rows in (1, 20, 10**6):
        got = skew.join_unique(fact, many, ["k"], "left", "i", hot_rows, reduce=[F.min("v").alias("v")])
        assert sorted((r.i, r.v) for r in got.collect()) == [(i, 2 if i < 50 else 1) for i in range(60)]
        semi = skew.join_unique(fact, many.where("k = 'a'"), ["k"], "left_anti", "i", hot_rows, reduce=[])
        assert sorted(r.i for r in semi.collect()) == list(range(50))


def test_every_hot_key_is_listed(spark):
    df = spark.range(30000).select((F.col("id") % 15000).alias("k"))
    hot = skew.hot_hashes(df, ["k"], hot_rows=2)
    assert hot.count() == 15000 and hot.columns == ["_h", "_salts"]


def test_global_row_number(spark):
    rnd = random.Random(7)
    seqs = rnd.sample(range(1 << 62), 500) + list(range(200)) + [(1 << 63) - 1]
    df = spark.createDataFrame([(s,) for s in seqs], "seq bigint").repartition(6)
    rows = ranking.global_row_number(df, "seq", "pos").collect()
    assert [r.pos for r in sorted(rows, key=lambda r: r.seq)] == list(range(1, len(seqs) + 1))


def test_global_row_number_by_wide_and_several_columns(spark):
    rows = [("b", Decimal(10**37 + i)) for i in range(50)] + [("a", Decimal(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, seq decimal(38,0)").repartition(5)
    got = ranking.global_row_number(df, ["k", "seq"], "pos").orderBy("pos").collect()
    assert [(r.k, r.seq) for r in got] == sorted(rows) and [r.pos for r in got] == list(range(1, 101))
    assert ranking.global_row_number(df.limit(0), "seq", "pos").count() == 0


def test_rows_whose_key_has_one_source_are_not_shuffled(spark):
    """Stored keys tell them apart; before, all rows were shuffled for the hot keys and again for the mixed ones."""
    from jobloom.session import stored

    rows = [(n, f"j{n}", f"Company {n // 2}", "Engineer", "", "Austin", "", "lever" if n % 20 == 1 else "ashby") for n in range(400)]
    rows += [(400, "x", "", "", "", None, "", None), (401, "y", "", "", "", None, "", "lever")]
    df = spark.createDataFrame(rows, "seq LONG, job_id STRING, company STRING, title STRING, apply_url STRING, location STRING, posted_on STRING, source STRING")
    names = []
    marked = dedupe.cross_source_marked(df, keep=lambda t, name: names.append(name) or stored(t, name))
    plain = dedupe.cross_source_marked(df)
    assert names == ["repeated-keys", "hot-keys"] and marked.columns == plain.columns
    assert sorted(marked.collect()) == sorted(plain.collect()) and marked.where("dropped").count() == 20
    near = dedupe._may_be_in(spark.range(400).selectExpr("CAST(id AS STRING) AS _key"), spark.range(0, 400, 40).selectExpr("CAST(id AS STRING) AS _key"))
    assert sorted(int(r._key) for r in near.where("_near").collect()) == list(range(0, 400, 40))
