"""How the tokens of two tokenizers line up, scored by how many documents link the same ids."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from jobloom.llm.spread import join_per_key, small
from jobloom.session import written

#: Documents in a block at most; a bit of a bitmap is a document of its block.
PLACE_BITS = 12
BLOCK = 1 << PLACE_BITS
#: Bits of an id; a pair is A's id and B's id, in so many bits.
ID_BITS = 20
MOST_ID = (1 << ID_BITS) - 1
#: A block also ends when it holds so many (pair, document) entries.
ENTRIES = 1 << 21
#: Characters and documents that are tokenized at once.
SLICE, SLICE_DOCS = 1 << 20, 1 << 9
#: Bytes of a bitmap that is kept whole; others list their bytes that are not zero.
WHOLE = BLOCK // 8
#: The plane of a bitmap that says which documents hold a pair at all.
HELD = -1

#: Characters about which libraries may differ, whether they are letters, numbers or blanks.
UNSURE = re.compile("[^\\t\\n\\r -~\u00a1-\u017f]").search
#: Characters of a run, with or without blanks, from which a text is left to a library that takes any run.
LONG_RUN = 1 << 12
GAPS = re.compile(r"\S+").split

DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
#: Rows of documents have no pair; rows of bitmaps have neither place nor document.
ALIGNED = f"block long, place int, {DOCUMENT}, pair long, plane int, n long, bits binary"

POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.int64)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def bytes_of_a(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer. Entries with other letters stand for themselves."""
    letters = byte_letters()
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(map(letters.__getitem__, t)) if set(t) <= letters.keys() else t.encode() for t in names]


def usual(text: str) -> bool:
    """Whether a text has Latin letters and runs of usual length only."""
    if UNSURE(text):
        return False
    return len(text) < LONG_RUN or max(map(len, [*text.split(), *GAPS(text)])) < LONG_RUN


def ranked(file_a: bytes, tokens: list[bytes]) -> tiktoken.Encoding | None:
    """The tokenizer of ``file_a`` as an encoding by ranks, which is faster.

    The two agree if the file only splits texts as byte-level files do, and merges in the order of
    the ids; else None. Two tokens that join to a third one always do so in one way: what they
    cover has no other cut by the merges before.
    """
    spec = json.loads(file_a)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    ids = [model["vocab"][m] for m in merges] if model["type"] == "BPE" else []
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec["normalizer"]
    if not plain or not ids or ids != sorted(ids) or model.get("ignore_merges") or len(ids) + 256 != len(set(model["vocab"]) - {t["content"] for t in spec["added_tokens"]}):
        return None
    special = {t["id"] for t in spec["added_tokens"]}
    ranks = {t: i for i, t in enumerate(tokens) if i not in special}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bytes_of_b(tokenizer: SentencePieceProcessor) -> list[bytes]:
    """The bytes of each id of a sentence-piece tokenizer."""
    ids = range(tokenizer.get_piece_size())
    return [
        bytes([int(p[3:5], 16)]) if tokenizer.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in ((i, tokenizer.id_to_piece(i)) for i in ids)
    ]


class Groups(NamedTuple):
    """Tokens of some texts, one after the other, and the group that each belongs to.

    ``starts`` has the first group of each text, and the number of groups.
    """

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    starts: np.ndarray

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.group_a, minlength=self.starts[-1]), np.bincount(self.group_b, minlength=self.starts[-1])


def flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))


class Aligner:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, file_a: bytes, file_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(file_a.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=file_b)
        self.bytes_a, self.bytes_b = bytes_of_a(self.a), bytes_of_b(self.b)
        if max(len(self.bytes_a), len(self.bytes_b)) > MOST_ID:
            raise ValueError("a vocabulary has too many ids")
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        both = [range(len(self.bytes_a)), range(len(self.bytes_b))]
        self.ranked = ranked(file_a, self.bytes_a)
        # twice the id, and one more for the last token of its side of a group
        self.written = [f"{i}{mark}" for ids, last in zip(both, "|;", strict=True) for i in ids for mark in (",", last)]

    def coded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both for space + text; none for an empty text, or one that either does not give back."""
        whole = [" " + t for t in texts]
        quick = [self.ranked is not None and usual(t) for t in whole]
        others = iter(self.a.encode_batch_fast([t for t, q in zip(whole, quick, strict=True) if not q], add_special_tokens=False))
        coded_a = [self.ranked.encode_ordinary(t) if q else next(others).ids for t, q in zip(whole, quick, strict=True)]
        coded_b = self.b.encode(texts, num_threads=1)
        for i, text in enumerate(whole):
            data = text.encode()
            # ranks give back every text
            same = quick[i] or b"".join(map(self.bytes_a.__getitem__, coded_a[i])) == data
            if not (texts[i] and same and b"".join(map(self.bytes_b.__getitem__, coded_b[i])) == data):
                coded_a[i], coded_b[i] = [], []
        return coded_a, coded_b

    def groups(self, coded_a: list[list[int]], coded_b: list[list[int]]) -> Groups:
        """The tokens of texts, cut where tokens of both end; each text ends in a cut."""
        a, b = flat(coded_a), flat(coded_b)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.zeros((2, int(end_a[-1]) + 1 if len(a) else 1), bool)
        ends[0, end_a], ends[1, end_b] = True, True
        cut_a, cut_b = ends[1, end_a], ends[0, end_b]
        cuts = np.concatenate(([0], np.cumsum(cut_a)))
        starts = cuts[np.concatenate(([0], np.cumsum([len(x) for x in coded_a]))).astype(np.int64)]
        return Groups(a, b, cuts[:-1], np.cumsum(cut_b) - cut_b, starts)

    def texts_of(self, g: Groups) -> list[str]:
        """The groups of each text in order, as in ``a1,a2|b1;a3|b2,b3``."""
        before_a, before_b = (np.concatenate(([0], np.cumsum(n))) for n in g.sizes())
        last_a, last_b = np.diff(g.group_a, append=-1) != 0, np.diff(g.group_b, append=-1) != 0
        codes = np.empty(len(g.a) + len(g.b), np.int64)
        codes[np.arange(len(g.a)) + before_b[g.group_a]] = 2 * g.a + last_a
        codes[np.arange(len(g.b)) + before_a[g.group_b + 1]] = 2 * (len(self.bytes_a) + g.b) + last_b
        bounds = (before_a + before_b)[g.starts].tolist()
        parts = list(map(self.written.__getitem__, codes.tolist()))
        return ["".join(parts[x:y])[:-1] for x, y in zip(bounds, bounds[1:])]  # noqa: B905


@functools.lru_cache(maxsize=1)
def aligner(file_a: bytes, file_b: bytes) -> Aligner:
    return Aligner(file_a, file_b)


def each_once(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (group, id) in order, and how often each occurs."""
    both, times = np.unique(group << ID_BITS | ids, return_counts=True)
    return both >> ID_BITS, both & MOST_ID, times


def pairs_of(g: Groups, most: int = ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, group, links): the linked id pairs, about ``most`` at a time; a pair may come again.

    Groups of one token on either side are one link each; in others ids that occur several times
    are multiplied instead of paired one by one.
    """
    size_a, size_b = g.sizes()
    single = (size_a == 1) & (size_b == 1)
    of_a, of_b = single[g.group_a], single[g.group_b]
    pair = g.a[of_a] << ID_BITS | g.b[of_b]
    yield pair, g.group_a[of_a], np.ones(len(pair), np.int64)
    if single.all():
        return
    group_a, a, times_a = each_once(g.group_a[~of_a], g.a[~of_a])
    group_b, b, times_b = each_once(g.group_b[~of_b], g.b[~of_b])
    first, beyond = np.searchsorted(group_b, group_a), np.searchsorted(group_b, group_a, "right")
    made = np.cumsum(beyond - first)
    start = 0
    while start < len(a):
        done = made[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(made, done + most, "right")))
        n = (beyond - first)[start:stop]
        row = np.repeat(np.arange(start, stop), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:stop], n)
        yield a[row] << ID_BITS | b[at], group_a[row], times_a[row] * times_b[at]
        start = stop


def merged(pair: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pair, n, bits): the documents of each pair, sorted by (pair, place), OR-merged into one bitmap.

    ``n`` is the bitmap's popcount. A bitmap is compressed to (index, byte) of its bytes that are
    not zero, in three bytes each, or kept whole where that is shorter.
    """
    index = place >> 3
    new = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(index, prepend=-1) != 0))
    byte = np.bitwise_or.reduceat((1 << (place & 7)).astype(np.uint8), new)
    pair, index = pair[new], index[new]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    listed = np.diff(starts, append=len(pair))
    n = np.add.reduceat(POPCOUNT[byte], starts)
    whole = 3 * listed > WHOLE
    ends = np.cumsum(np.where(whole, WHOLE, 3 * listed))
    begins = np.concatenate(([0], ends[:-1]))
    out = np.zeros(int(ends[-1]), np.uint8)
    in_whole = np.repeat(whole, listed)
    at = np.repeat(begins, listed)
    out[(at + index)[in_whole]] = byte[in_whole]
    at = (at + 3 * (np.arange(len(pair)) - np.repeat(starts, listed)))[~in_whole]
    out[at], out[at + 1], out[at + 2] = index[~in_whole] & 255, index[~in_whole] >> 8, byte[~in_whole]
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    bits = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return pair[starts], n, bits


def places(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each bit that is set in bitmaps made by ``merged``."""
    offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
    data = np.frombuffer(bits.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    whole = sizes == WHOLE
    rows = np.arange(len(bits))
    of_whole = np.repeat(whole, sizes)
    lists = data[~of_whole].reshape(-1, 3).astype(np.int64)
    row = np.concatenate((np.repeat(rows[~whole], sizes[~whole] // 3), np.repeat(rows[whole], WHOLE)))
    index = np.concatenate((lists[:, 0] | lists[:, 1] << 8, np.tile(np.arange(WHOLE), int(whole.sum()))))
    byte = np.concatenate((lists[:, 2].astype(np.uint8), data[of_whole]))
    at, bit = np.nonzero(np.unpackbits(byte[:, None], axis=1, bitorder="little"))
    return row[at], index[at] * 8 + bit


class Block:
    """Documents that share bitmaps."""

    def __init__(self, number: int):
        self.number, self.documents = number, 0
        self.codes: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.entries = 0

    def add(self, g: Groups) -> None:
        """The next documents. A code is a pair and the place of a document."""
        place = self.documents + np.repeat(np.arange(len(g.starts) - 1), np.diff(g.starts))
        for pair, group, links in pairs_of(g):
            if len(pair):
                self.codes.append(pair << PLACE_BITS | place[group])
                self.links.append(links)
                self.entries += len(pair)
            if self.entries > 2 * ENTRIES:
                self.fold()
        self.documents += len(g.starts) - 1

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct (pair, place), sorted, and the links of each."""
        codes, links = np.concatenate(self.codes), np.concatenate(self.links)
        order = np.argsort(codes)
        codes = codes[order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        codes, links = codes[starts], np.add.reduceat(links[order], starts)
        self.codes, self.links, self.entries = [codes], [links], len(codes)
        return codes >> PLACE_BITS, codes & (BLOCK - 1), links

    def takes(self, documents: int) -> bool:
        return self.documents + documents <= BLOCK and self.entries < ENTRIES

    def bitmaps(self) -> Iterator[pa.RecordBatch]:
        """A bitmap for each pair, and one for each binary digit of its links beyond the first."""
        if not self.entries:
            return
        pair, place, links = self.fold()
        yield self.plane(HELD, pair, place)
        rest, digit = links - 1, 0
        while rest.any():
            odd = rest & 1 == 1
            if odd.any():
                yield self.plane(digit, pair[odd], place[odd])
            left = rest > 1
            pair, place, rest, digit = pair[left], place[left], rest[left] >> 1, digit + 1

    def plane(self, plane: int, pair: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        keys, n, bits = merged(pair, place)
        return batch_of(len(keys), block=np.full(len(keys), self.number), pair=keys, plane=np.full(len(keys), plane, np.int32), n=n, bits=bits)


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
COLUMNS = {name: KINDS[kind] for name, kind in (c.split() for c in ALIGNED.split(", "))}


def batch_of(rows: int, **columns) -> pa.RecordBatch:
    """A batch with all columns of ALIGNED; those not given are null."""
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in COLUMNS.items()]
    return pa.RecordBatch.from_arrays(arrays, list(COLUMNS))


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold about SLICE characters, and SLICE_DOCS texts at most."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE or i + 1 - start >= SLICE_DOCS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """Rows of ALIGNED, stored: one for each row of ``docs``, and bitmaps of the pairs it links.

    ``digest`` keeps the SHA-256 of the groups' text in its place. ``path_a`` is the JSON file of a byte-level tokenizer, ``path_b`` the model of a sentence-piece
    one; both are read here and sent to the tasks.
    """
    files = docs.sparkSession.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (path_a, path_b)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*files.value)
        block = Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in slices(texts):
                n = stop - start
                coded = own.coded(texts[start:stop])
                g = own.groups(*coded)
                size_a, size_b = g.sizes()
                links = np.concatenate(([0], np.cumsum(size_a * size_b)))[g.starts]
                lines = own.texts_of(g)
                if digest:
                    lines = [hashlib.sha256(x.encode()).hexdigest() if x else x for x in lines]
                if not block.takes(n):
                    yield from block.bitmaps()
                    block = Block(block.number + 1)
                place = np.arange(block.documents, block.documents + n, dtype=np.int32)
                block.add(g)
                yield batch_of(
                    n, block=np.full(n, block.number), place=place, doc_id=ids.slice(start, n), n_a=[len(x) for x in coded[0]],
                    n_b=[len(x) for x in coded[1]], n_groups=np.diff(g.starts), n_links=np.diff(links), groups=lines)
        yield from block.bitmaps()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, ALIGNED), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, b, documents, links, best) of ``aligned`` rows, one for each linked id pair.

    ``documents`` and ``links`` are sums of popcounts; a plane's count weighs as its binary digit.
    ``best`` says whether no other pair of the same ``a`` is in more documents.
    """
    held = F.when(F.col("plane") == HELD, F.col("n")).otherwise(0)
    weight = F.expr("shiftleft(1L, greatest(plane, 0))")
    pairs = rows.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum(held).alias("documents"), F.sum(F.col("n") * weight).alias("links"))
    pairs = pairs.withColumns({"a": F.shiftright("pair", ID_BITS).cast("int"), "b": F.col("pair").bitwiseAND(F.lit(MOST_ID)).cast("int")})
    most = F.max("documents").over(Window.partitionBy("a"))  # an id meets the ids of one vocabulary at most
    return pairs.select("pair", "a", "b", "documents", "links", (F.col("documents") == most).alias("best"))


def returned(rows: DataFrame) -> DataFrame:
    """(block, place, n_best, count_sum) of bitmaps with the ``documents`` and ``best`` of their pair.

    Each bit takes its pair's scores back to a document. Rows of a block that stand together are
    added up first.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros((2, BLOCK), np.int64)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(sums[1])
            arrays = [pa.array(np.full(len(at), block, np.int64)), pa.array(at.astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at])]
            return pa.RecordBatch.from_arrays(arrays, ["block", "place", "n_best", "count_sum"])

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, plane, documents = (batch.column(i).to_numpy() for i in (0, 1, 3))
            best = batch.column(4).to_numpy(zero_copy_only=False)
            weight = np.left_shift(1, np.maximum(plane, 0).astype(np.int64))
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if blocks[start] != block:
                    if block is not None:
                        yield out()
                    block, sums = int(blocks[start]), np.zeros((2, BLOCK), np.int64)
                row, place = places(batch.column(2).slice(start, stop - start))
                row += start
                np.add.at(sums[0], place, (weight * best)[row])
                np.add.at(sums[1], place, (weight * documents)[row])
        if block is not None:
            yield out()

    return rows.select("block", "plane", "bits", "documents", "best").mapInArrow(add_up, "block long, place int, n_best long, count_sum long")


def scored(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """DOCUMENT, n_best and count_sum for every row of ``docs``.

    Tokens of A and B, those of space + text, are cut into groups at the byte offsets where tokens
    of both end; all pairs of a group's A and B tokens are links. ``groups`` holds their ids, or
    with ``digest`` its SHA-256. A pair of ids counts as often as there are rows of ``docs`` that link it:
    ``count_sum`` adds the counts of a row's links, ``n_best`` is the number of those whose count is
    the highest that their A id has.

    Null and empty texts, and texts that either tokenizer changes, have no tokens: zeros, and
    empty ``groups``. Rows without a doc_id, and rows that share one, are documents of their own.
    Ties for the highest count are all best. An empty table gives no rows. Other columns are left out.
    """
    rows = aligned(docs, path_a, path_b, digest)
    scores, few = small(pair_counts(rows).select("pair", "documents", "best"), "pair-counts", 24)
    bitmaps = rows.filter("pair IS NOT NULL").select("block", "pair", "plane", "bits")
    if few:
        found = bitmaps.join(scores, "pair")
    else:
        found = join_per_key(bitmaps, "pair", ["block"], scores, "inner").repartition("block").sortWithinPartitions("block")
    sums = returned(found).groupBy("block", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    names = [c.split()[0] for c in DOCUMENT.split(", ")]
    out = rows.filter("pair IS NULL").select("block", "place", *names).join(sums, ["block", "place"], "left")
    return out.select(*names, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")])
