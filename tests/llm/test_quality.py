"""Held-out accuracy, and scores of awkward texts."""

import numpy as np
from pyspark.sql import functions as F

from jobloom.llm import quality, queries

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(np.argsort(s))
    good = (y == 1).sum()
    return (order[y == 1].sum() - good * (good - 1) / 2) / (good * (y == 0).sum())


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op6(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    y = rows.quality.to_numpy()
    assert len(rows) > 50 and auc(y, rows.score.to_numpy()) > 0.97
    assert (rows.predicted.to_numpy() == y).mean() > 0.95
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_held_out_rows_do_not_teach(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(queries.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    fits = [quality.fit(quality.labelled(docs, x.filter(~queries.held_out(F.col("doc_id")))), pairs=5000) for x in (labels, turned)]
    assert fits[0] == fits[1]


def test_pairs_teach_the_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, len(quality.NAMES)))
    rows = [(i, int(v[0] - v[1] > 0), [float(abs(c)) if j > 1 else float(c + 5) for j, c in enumerate(v)]) for i, v in enumerate(x)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, y int, x array<double>"), pairs=20_000)
    df = spark.createDataFrame(rows, "doc_id long, y int, x array<double>")
    got = df.select("y", model.score(F.col("x")).alias("s")).toPandas()
    assert auc(got.y.to_numpy(), got.s.to_numpy()) > 0.97


def test_awkward_texts_have_scores(spark, documents):
    texts = [None, "", " ", "a", "é😀", "word " * 200_000, "\n" * 1000, "same", "same"]
    docs = documents(list(enumerate(texts)) + [(None, "no id")], clash=True)
    model = quality.fit(quality.labelled(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")), pairs=5000)
    out = quality.scored(docs, model)
    rows = out.collect()
    assert out.columns == [*docs.drop("score").columns, "score"] and len(rows) == len(texts) + 1
    by = {r.doc_id: r.score for r in rows}
    assert all(0 <= s <= 1 for s in by.values()) and by[7] == by[8] and by[0] == by[1]


def test_few_or_odd_labels(spark, documents):
    docs = documents([(1, "a b c"), (1, "other text"), (2, "x y")])
    kind = "doc_id long, quality int, toxic int"
    for rows in ([], [(1, 1, 0)], [(1, None, 0), (None, 1, 0), (2, 7, 0)], [(9, 0, 0), (8, 1, 0)]):
        model = quality.fit(quality.labelled(docs, spark.createDataFrame(rows, kind)), pairs=100)
        assert model.weights == () and {r.score for r in quality.scored(docs, model).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 0)], kind)
    assert {r.doc_id: r.y for r in quality.labelled(docs, both).collect()} == {1: 0, 2: 1}
    assert quality.scored(docs.limit(0), quality.fit(quality.labelled(docs, both), pairs=100)).count() == 0


def test_labelled_rows_are_bounded(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.labelled(docs, labels, 50).count() == 50
