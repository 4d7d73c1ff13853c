"""Links and groups against comparing all pairs of n-gram sets."""

import collections
import random

import pyarrow as pa
import pytest
import regex

from jobloom.llm import components as cc
from jobloom.llm import ngram_join as nj


def ngrams(text, size=5):
    words = regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower())
    if len(words) >= size:
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows, threshold=0.8):
    sets = [(d, ngrams(t)) for d, t in rows]
    links, root = collections.Counter(), list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and len(a & b) / len(a | b) >= threshold:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, low[top(i)], links[i]) for i, (d, _) in enumerate(sets))


def run(df, **kw):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in nj.similar(df, **kw).collect())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == brute(rows)


def test_large_group_of_near_copies(spark, documents):
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(300):  # more members than a block holds
        copy = list(words)
        for _ in range(rnd.randrange(4)):
            copy[rnd.randrange(120)] = f"x{rnd.randrange(50)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, f"unlike text number {i} of {i * 7} words that {i} nobody {i * 3} shares") for i in range(40)]
    assert run(documents(rows)) == brute(rows)


def near_copies(n, edits, seed=4):
    """Copies of a text of 120 words with up to ``edits`` words changed, and unlike texts."""
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(n):
        copy = list(words)
        for _ in range(rnd.randrange(edits + 1)):
            copy[rnd.randrange(120)] = f"x{rnd.randrange(50)}"
        rows.append((i, " ".join(copy)))
    return rows + [(100_000 + i, f"unlike text number {i} of {i * 7} words that {i} nobody {i * 3} shares") for i in range(20)]


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_blocks_of_one_bucket(spark, documents, monkeypatch, edits):
    """Cores, rings, and blocks of few members; copies of other texts beside them."""
    monkeypatch.setattr(nj, "MOST_MEMBERS", 16)
    rows = near_copies(150, edits) + [(200_000 + i, t) for i, t in near_copies(60, edits, 9)]
    assert run(documents(rows + [(7, rows[3][1]), (8, rows[3][1])])) == brute(rows + [(7, rows[3][1]), (8, rows[3][1])])


def test_blocks_by_ngrams(spark, documents, monkeypatch):
    monkeypatch.setattr(nj, "MOST_NGRAMS", 500)
    rows = near_copies(40, 3)
    assert run(documents(rows)) == brute(rows)


def test_rows_grow_with_the_group(spark, documents, monkeypatch):
    """Blocks, and the pairs of blocks that meet, of 500, 1,000 and 2,000 near copies of one text."""
    monkeypatch.setattr(nj, "MOST_MEMBERS", 64)
    made = collections.defaultdict(list)
    for name in ("blocks", "block_pairs", "verified"):
        def watched(rows, *more, name=name, build=getattr(nj, name)):
            made[name].append(rows.count())
            return build(rows, *more)
        monkeypatch.setattr(nj, name, watched)
    for n in (500, 1000, 2000):
        words = [f"w{i}" for i in range(600)]
        rows = []
        for i in range(n):
            copy = list(words)
            copy[(i * 37) % 300] = f"x{i}"
            rows.append((i, " ".join(copy)))
        out = nj.similar(documents(rows)).collect()
        assert {(r.class_id, r.n_links) for r in out} == {(0, n - 1)}
    for name in ("blocks", "verified"):
        a, b, c = made[name]
        assert b <= 2.5 * a + 10 and c <= 2.5 * b + 10, made


def test_awkward_rows(spark, documents):
    long = "tok " + " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "?!"), (4, "one two"), (5, "One, two!"), (6, "one two three four five"),
            (7, "ONE two three four five"), (8, long), (9, long + " end"), (10, long), (10, long)]
    df = documents([*rows, (None, "one two")], clash=True)
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []
    by = {r.doc_id: r for r in nj.similar(df).collect()}
    assert by[5].copy_of == 4 and by[1].n_links == 0 and by[2].class_id == 2 and by[7].copy_of == 6


def test_one_id_with_two_texts(spark, documents):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g"), (3, "h i j k l m n")]
    out = run(documents(rows))
    assert len(out) == 4 and all(c == 1 for d, c, _ in out)


def test_unlike_texts_of_one_id_are_all_compared(spark, documents):
    rnd = random.Random(6)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    near = [t + " end" for t in texts]
    rows = [(7, t) for t in texts] + [(-9, t) for t in near[:3]] + [(2**62, t) for t in near[3:]] + [(7, texts[0])]
    assert run(documents(rows)) == brute(rows)
    rows = [(7, texts[0]), (7, texts[1]), (9, near[1]), (-(2**63), "one two"), (2**63 - 1, "one two")]
    assert run(documents(rows)) == brute(rows)


@pytest.mark.parametrize("threshold,recall", [(0.8, 0.99999), (0.5, 0.99), (0.9, 0.999), (1.0, 0.99)])
def test_bands_reach_the_recall(threshold, recall):
    bands, rows = nj.bands_and_rows(threshold, recall)
    assert bands * rows <= nj.MOST_HASHES and 1 - (1 - threshold**rows) ** bands >= recall


def test_components(spark):
    rnd = random.Random(2)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1400)]
    some = [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)]
    links = [*chain, *star, *some, (5, 5), (None, 3)]
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    assert got == {x: top(x) for x in root}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_sets_of_large_buckets_are_built_for_cores(spark, documents, monkeypatch):
    monkeypatch.setattr(nj, "MOST_MEMBERS", 16)
    small = [(i, f"{i // 2} alike in twos " + " ".join(f"p{i // 2}n{k}" for k in range(60)) + (" end" if i % 2 else "")) for i in range(300_000, 300_040)]
    seen = {}

    def watched(members, sets, *more, build=nj.cores):
        seen["sets"], seen["members"] = sets.count(), members.filter("parts > 1").select("node").distinct().count()
        return build(members, sets, *more)

    def linked(members, sets, *more, build=nj.links_of):
        seen["plan"] = sets._jdf.queryExecution().executedPlan().toString()
        return build(members, sets, *more)

    monkeypatch.setattr(nj, "cores", watched)
    monkeypatch.setattr(nj, "links_of", linked)
    rows = near_copies(60, 2) + small
    assert run(documents(rows)) == brute(rows)
    assert 0 < seen["sets"] == seen["members"] <= 60
    assert "hashpartitioning(doc_id" not in seen["plan"]  # the sets are dealt by node, once


def test_words_are_taken_in_slices(spark, documents, monkeypatch):
    rows = near_copies(60, 3) + [(400_000, None), (400_001, ""), (400_002, "one " * 700)]
    whole = run(documents(rows))
    taken = []
    words = pa.array([[1] * 700, [], [2] * 30, [3] * 5, [4] * 600], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), words], ["doc_id", "words"])
    monkeypatch.setattr(nj, "MOST_WORDS", 500)
    taken = [b.column(0).to_pylist() for b in nj.slices([batch, batch.slice(1, 2), batch.slice(0, 0)])]
    assert taken == [[0], [1, 2, 3, 4], [1, 2]]
    for part in nj.slices([batch]):
        alone = [nj.ngram_sets(batch.slice(i, 1).column(1), 5)[0].tolist() for i in part.column(0).to_pylist()]
        assert [s.tolist() for s in nj.ngram_sets(part.column(1), 5)] == alone
    assert run(documents(rows)) == whole == brute(rows)
