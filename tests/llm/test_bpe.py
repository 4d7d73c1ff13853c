"""Encoding against the tiktoken library, decoding as an exact round trip."""

import base64
import random
from array import array

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from jobloom.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    out = []
    bpe.encoder(PATH, P.PATTERN).extend(text, out)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(reference, text):
    assert ids_of(text) == reference.encode_ordinary(text)


def test_awkward_texts(reference):
    rnd = random.Random(3)
    texts = ["", " ", "\x1c\x1d a\x1e", "\x85᠎ x", "ſ's 'S I'LL", "a" * 5000, "é" * 500 + " " * 300 + "!" * 700]
    texts += ["".join(rnd.choice("abcé ü\n\t12$%'st😀中 '\x1c　") for _ in range(60)) for _ in range(300)]
    texts += [chr(c) + "a1 " + chr(c) for c in range(0x110000) if c % 11 == 0 and not 0xD800 <= c < 0xE000]
    texts += [chr(c) + "a " + chr(c) for c in (0x558, 0x88F, 0x3D067, 0x18EE7, 0x11DE0, 0x1246F)]
    for text in texts:
        assert ids_of(text) == reference.encode_ordinary(text)


def test_merges_equal_a_plain_loop():
    ranks = bpe.load(PATH)

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(1)
    for _ in range(500):
        piece = bytes(rnd.choice(b"aabcdeth \xc3\xa9") for _ in range(rnd.randrange(1, 40)))
        assert bpe.merged(piece, ranks) == ([ranks[piece]] if piece in ranks else plain(piece))


def test_remembered_pieces_are_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.Encoder(PATH, P.PATTERN)
    text, out = " ".join(f"wörd{i % 23}x" for i in range(200)), []
    own.extend(text, out)
    assert out == reference.encode_ordinary(text) and len(own.known) <= 5 and len(own.older) <= 5


def test_columns(spark, documents, reference):
    texts = [None, "", "Ünï cödé 😀", "x " * 60_000, "same", "same"]
    df = documents(list(enumerate(texts)), clash=True)
    coded = df.select("doc_id", bpe.encode(PATH, P.PATTERN)("text").alias("t"))
    rows = coded.select("doc_id", "t", bpe.decode(PATH)("t").alias("d")).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.t == reference.encode_ordinary(text) and bytes(r.d) == text.encode()
    none = df.limit(0).select(bpe.encode(PATH, P.PATTERN)("text").alias("t"))
    assert none.select(bpe.decode(PATH)("t")).count() == 0
    gone = spark.createDataFrame([(None,)], "t array<int>").select(bpe.decode(PATH)("t").alias("d"))
    assert gone.first().d is None


def test_query_digests(spark, reference):
    import hashlib

    rows = queries.op4(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        ids = reference.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_ids_are_made_once(spark):
    plan = queries.op4(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_ids_go_back_in_bounded_batches(monkeypatch, reference):
    """One batch of texts was one batch of ids before, whatever its size."""
    monkeypatch.setattr(bpe, "BATCH_IDS", 100)
    texts = [None, "", "word " * 40, "a b c", "lang " * 300, "", "x" * 50]
    own = bpe.Encoder(PATH, P.PATTERN)
    parts = list(bpe.encoded(own, pa.array(texts)))
    assert [i for p in parts for i in p.to_pylist()] == [reference.encode_ordinary(t or "") for t in texts]
    assert len(parts) > 1 and all(len(p.values) < 100 + 310 for p in parts)
    assert [len(p) for p in bpe.encoded(own, pa.array([], pa.string()))] == [0]


def test_short_pieces_equal_the_tree(monkeypatch):
    ranks, rnd = bpe.load(PATH), random.Random(8)
    pieces = [bytes(rnd.choice(b"aabcdeth \xc3\xa9\xff07") for _ in range(rnd.randrange(1, 40))) for _ in range(2000)]
    short = [[ranks[p]] if p in ranks else bpe.merged_short(p, ranks) for p in pieces]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert short == [bpe.merged(p, ranks) for p in pieces]


def test_remembered_ids_take_four_bytes():
    """What a worker keeps after many pieces: two generations of 1 << 16 at most, once 1 << 18 with ids as tuples."""
    own = bpe.Encoder(PATH, P.PATTERN)
    out = array("i")
    own.extend(" ".join(f"k{i * 7919 % 1000003}z" for i in range(300_000)), out)
    kept = [*own.known.values(), *own.older.values()]
    assert len(kept) <= 2 * bpe.REMEMBERED <= 1 << 17 and all(type(ids) is bytes and len(ids) % 4 == 0 for ids in kept)
