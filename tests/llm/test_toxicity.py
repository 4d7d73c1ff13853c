"""Held-out accuracy, interactions, and scores of awkward texts."""

import numpy as np
from pyspark.sql import functions as F

from jobloom.llm import queries, toxicity

SF = "/root/testdata/sf0.1"
KIND = "doc_id long, quality int, toxic int"


def auc(y, s):
    order = np.argsort(np.argsort(s))
    bad = (y == 1).sum()
    return (order[y == 1].sum() - bad * (bad - 1) / 2) / (bad * (y == 0).sum())


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op12(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    y = rows.toxic.to_numpy()
    assert len(rows) > 1000 and auc(y, rows.score.to_numpy()) > 0.97
    assert rows.predicted[y == 1].mean() > 0.85 and rows.predicted[y == 0].mean() < 0.01
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_held_out_rows_do_not_teach(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(queries.held_out_of_toxic(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(toxicity.labelled(docs, x.filter(~queries.held_out_of_toxic(F.col("doc_id"))))) for x in (labels, turned))
    assert a.cut == b.cut and (a.buckets == b.buckets).all() and (a.machine.factors == b.machine.factors).all()


def test_pairs_of_terms_are_learned(spark, documents):
    """Only an insult with a group is toxic; either alone is as frequent elsewhere."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        insult, group = rng.integers(0, 2, 2)
        words = [*rng.choice([f"word{j}" for j in "abcdefgh"], 6), *(["fools"] * insult), *(["them"] * group)]
        rows.append((i, " ".join(words), int(insult and group)))
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], KIND)
    model = toxicity.fit(toxicity.labelled(docs, labels))
    trial = documents([(0, "fools"), (1, "them"), (2, "them fools"), (3, "worda wordb")])
    got = {r.doc_id: r.score for r in toxicity.scored(trial, model).collect()}
    assert got[2] >= toxicity.THRESHOLD > max(got[0], got[1], got[3])


def test_value_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(0.3, rng.normal(0, 1, 6), rng.normal(0, 1, (6, toxicity.FACTORS)))
    model = toxicity.Model(machine, np.array([2, 3, 5, 8, 13, 21], np.int32), 0.0)
    found = [np.array(x, np.int32) for x in ([2, 5, 21], [], [1, 4, 99], [3], [2, 3, 5, 8, 13, 21])]
    for value, x in zip(machine.values(model.rows(found))[0], found):
        at = [i for i, b in enumerate(model.buckets) if b in x]
        want = 0.3 + sum(machine.weights[i] for i in at) + sum(machine.factors[i] @ machine.factors[j] for i in at for j in at if i < j)
        assert abs(value - want) < 1e-9


def test_awkward_texts_have_scores(spark, documents):
    texts = [None, "", " ", "a", "é😀", "word " * 200_000, "x" * 300_000, "same", "same"]
    docs = documents(list(enumerate(texts)) + [(None, "no id")], clash=True)
    model = toxicity.fit(toxicity.labelled(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))))
    out = toxicity.scored(docs, model)
    by = {r.doc_id: r.score for r in out.collect()}
    assert out.columns == [*docs.drop("score").columns, "score"] and len(by) == len(texts) + 1
    assert all(0 <= s <= 1 for s in by.values()) and by[7] == by[8] and by[0] == by[1] == by[2]
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_few_or_odd_labels(spark, documents):
    docs = documents([(1, "a b c"), (1, "other text"), (2, "x y")])
    for rows in ([], [(1, 0, 1)], [(1, 0, None), (None, 0, 1), (2, 0, 7)], [(9, 0, 0), (8, 0, 1)]):
        model = toxicity.fit(toxicity.labelled(docs, spark.createDataFrame(rows, KIND)))
        assert model is None and {r.score for r in toxicity.scored(docs, model).collect()} == {0.5}
    both = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, 0), (2, 0, 0)], KIND)
    assert {r.doc_id: r.y for r in toxicity.labelled(docs, both).collect()} == {1: 1, 2: 0}
    model = toxicity.fit(toxicity.labelled(docs, both))
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, model).collect())


def test_labelled_rows_are_bounded(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.labelled(docs, labels, 50).count() == 50
