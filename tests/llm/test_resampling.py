"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib

import pytest

from jobloom.llm import resampling

ASCII = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(ASCII.get(c, c) for c in text or ""))


def runs(text, run):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, run, buckets, least, percent, seed):
    s, t = [0] * buckets, [0] * buckets
    for rows, sums in ((docs, s), (target, t)):
        for _, text in rows:
            for h in runs(text, run):
                sums[h % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found = runs(text, run)
        weight = sum(gain[x % buckets] for x in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


DOCS = [
    (0, None), (1, ""), (2, "..."), (3, "One two THREE"), (4, "ÄÖ ÉCOLE école 日本 x9y  a--b\u0080c d"), (5, "the cat sat on the mat " * 5),
    (6, "the cat sat on the mat " * 5), (7, "The Cat"), (8, "a" * 5000), (9, "long text " * 30_000), (9, "again the same id"), (None, "no id at all"), (None, "no id at all"),
]


@pytest.mark.parametrize(("run", "buckets", "least", "percent"), [(1, 10_000, 2, 50), (3, 97, 3, 34), (2, 70_000, 0, 100), (1, 10_000, 20, 10)])
def test_equals_brute_force(spark, documents, run, buckets, least, percent):
    target = [(1, "The cat sat"), (2, None), (3, "école 日本"), (None, "three mats")]
    bench = spark.createDataFrame(target, "item_id long, text string")
    docs = documents(DOCS, clash=True).repartition(3)
    out = resampling.resampled(docs, bench, run, buckets, least, percent, 7)
    assert out.columns == COLUMNS and rows_of(out) == brute(DOCS, target, run, buckets, least, percent, 7)


def test_long_texts_are_cut_at_gaps(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500)) + "  " + "ü" * 300
    whole = resampling.words_of(text), resampling.hashes(text, 3)
    monkeypatch.setattr(resampling, "SLICE", 7)
    assert (resampling.words_of(text), resampling.hashes(text, 3)) == whole
    assert all(text[a:b] == w for w, (a, b) in whole[0]) and [w for w, _ in whole[0]] == words(text)


def test_empty_tables(spark, documents):
    docs, bench = documents(DOCS), spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert resampling.resampled(docs.limit(0), bench).count() == 0
    out = rows_of(resampling.resampled(docs, bench.limit(0), least_words=1, percent=100))
    assert out == brute(DOCS, [], 1, 10_000, 1, 100, 2024)
    assert resampling.resampled(docs.limit(0), bench.limit(0)).count() == 0


def test_draw_looks_like_the_target(spark):
    """Among the drawn the target's words are more frequent than among all."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    out = resampling.resampled(docs, bench).toPandas()
    drawn = out[out["rank"].notna()]
    rate = lambda rows: rows.weight.sum() / rows.n_features.sum()
    assert rate(drawn) > rate(out) and sorted(drawn["rank"]) == list(range(1, len(drawn) + 1))
