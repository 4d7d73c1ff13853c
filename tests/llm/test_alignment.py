"""Token alignment against a plain version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from jobloom.llm import alignment, queries, spread

A, B = queries.BYTE_LEVEL, queries.PIECES
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]

TEXTS = [
    None, "", " ", "a", "The cat sat.", "The cat sat.", "the the the the", "  two  spaces\n\n\tand more  ", "naïve café — déjà vu",
    "日本語のテキスト 😀😀 ａｂｃ", "under▁score", "<|endoftext|> <s> <unk> <0x41>", "x" * 500, "=" * 333, "ab" * 400 + " " * 70,
    "\u0000nul", "ﬁ ligature ½ ́ é é", "long word " * 3000, "1234567890 3.14159 100%",
]


def brute(texts):
    """The same by nested loops over tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in visible}
    for x in range(256):
        if x not in visible:
            letter[chr(256 + len(letter) - len(visible))] = x
    rows, docs = [], defaultdict(set)
    for i, text in enumerate(texts):
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letter[c] for c in a.id_to_token(x)) if x < 50256 else b"<|endoftext|>" for x in ids_a]
        pieces = [b.id_to_piece(x) for x in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            rows.append(([], []))
            continue
        groups, part, i_a, i_b, end_a, end_b = [], ([], []), 0, 0, 0, 0
        while i_a < len(ids_a) or i_b < len(ids_b):
            if end_a <= end_b and i_a < len(ids_a):
                end_a += len(bytes_a[i_a])
                part[0].append(ids_a[i_a])
                i_a += 1
            else:
                end_b += len(bytes_b[i_b])
                part[1].append(ids_b[i_b])
                i_b += 1
            if end_a == end_b:
                groups.append(part)
                part = ([], [])
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        rows.append((groups, links))
        for pair in links:
            docs[pair].add(i)
    count = {p: len(s) for p, s in docs.items()}
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, (groups, links) in enumerate(rows):
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((
            i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()) if groups else 0, text,
            sum(m for p, m in links.items() if count[p] == best[p[0]]) if groups else 0, sum(m * count[p] for p, m in links.items()) if groups else 0))
    return out


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_equals_brute_force(spark, documents):
    docs = documents(list(enumerate(TEXTS)), clash=True).repartition(3)
    out = alignment.scored(docs, A, B)
    assert out.columns == COLUMNS and rows_of(out) == brute(TEXTS)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    ids = sorted(texts)
    want = [(ids[r[0]], *r[1:]) for r in brute([texts[i] for i in ids])]
    assert rows_of(alignment.scored(docs, A, B)) == want
    digests = {r.doc_id: r.groups_sha256 for r in queries.op13(spark, "/root/testdata/sf0.001").collect()}
    assert digests == {r[0]: hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "" for r in want}


def test_small_blocks_and_no_broadcast(spark, documents, monkeypatch):
    """Blocks of eight documents, and pair counts that are joined by a shuffle."""
    monkeypatch.setattr(spread, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(alignment, "SLICE_DOCS", 3)
    monkeypatch.setattr(alignment.Block, "takes", lambda self, n: self.documents + n <= 8)
    docs = documents(list(enumerate(TEXTS * 3))).coalesce(1)
    assert rows_of(alignment.scored(docs, A, B)) == brute(TEXTS * 3)


def test_rows_without_or_with_one_id(spark, documents):
    docs = documents([(None, "a b"), (None, "a b"), (7, "a b"), (7, "c d")])
    got = alignment.scored(docs, A, B).collect()
    assert len(got) == 4 and {r.count_sum for r in got if r.doc_id is None} == {6}
    assert alignment.scored(docs.limit(0), A, B).count() == 0


def test_pair_counts(spark, documents):
    rows = alignment.aligned(documents([(1, "hello hello hello"), (2, "hello")]), A, B)
    got = alignment.pair_counts(rows).collect()
    assert sum(r.links for r in got) == sum(r.n_links or 0 for r in rows.collect())
    assert {(r.documents, r.best) for r in got} == {(2, True)}


@pytest.mark.parametrize("n", [1, 5, 170, 171, 4096])
def test_bitmaps(n):
    rng = np.random.default_rng(n)
    sets = [np.sort(rng.choice(alignment.BLOCK, n, replace=False)) for _ in range(3)]
    pair, place = np.repeat(np.array([3, 5, 9 << 40]), n), np.concatenate(sets)
    keys, count, bits = alignment.merged(pair, place)
    assert keys.tolist() == [3, 5, 9 << 40] and count.tolist() == [n] * 3
    row, at = alignment.places(bits)
    assert [sorted(at[row == i]) for i in range(3)] == [s.tolist() for s in sets]
    row, at = alignment.places(bits.slice(1, 1))
    assert sorted(at) == sets[1].tolist() and set(row) == {0}


def test_groups_of_many_tokens():
    g = alignment.Groups(np.array([1, 1, 2, 3]), np.array([7, 8, 8, 9]), np.array([0, 0, 0, 1]), np.array([0, 0, 0, 1]), np.array([0, 1, 2]))
    want = Counter({(1, 7, 0): 2, (1, 8, 0): 4, (2, 7, 0): 1, (2, 8, 0): 2, (3, 9, 1): 1})
    for most in (1, 2, 100):
        got = Counter()
        for pair, group, links in alignment.pairs_of(g, most):
            for p, k, n in zip(pair.tolist(), group.tolist(), links.tolist()):
                got[p >> alignment.ID_BITS, p & alignment.MOST_ID, k] += n
        assert got == want


def test_ranks_give_the_ids_of_the_file():
    own = alignment.Aligner(*(open(p, "rb").read() for p in (A, B)))
    texts = [t or "" for t in TEXTS] + ["don't we'll  \n\t x1y2 ²³ ªº ÀÿĀſ\u00ad", "a" * 5000 + " b", " " * 5000]
    assert own.ranked and [alignment.usual(t) for t in texts[-3:]] == [True, False, False]
    for text in texts:
        if alignment.usual(text):
            assert own.ranked.encode_ordinary(" " + text) == own.a.encode(" " + text, add_special_tokens=False).ids
