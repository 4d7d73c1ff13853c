"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and numbers that Unicode got after version 16, on which rank files of
# this kind are split; newer versions of the pattern library know them.
NEWER = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 "
    "\ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d \U000107bb-\U000107bf \U00010940-\U00010959 "
    "\U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb \U00011de0-\U00011de9 "
    "\U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 "
    "\U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda "
    "\U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 "
    "\U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 "
    "\U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 "
    "\U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff "
    "\U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
).replace(" ", "")

#: Distinct pieces in a generation of those whose ids a worker remembers.
REMEMBERED = 1 << 16
#: Characters of the longest piece that is remembered.
LONGEST = 64
#: Bytes of the longest piece whose pairs are searched one by one.
SHORT = 24
#: Ids in a batch that is handed back; a text with more has a batch of its own.
BATCH_IDS = 1 << 18


@functools.lru_cache(maxsize=2)
def load(path: str) -> dict[bytes, int]:
    """Ranks by byte string, from lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


@functools.lru_cache(maxsize=2)
def load_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load(path).items()}


def merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merged``, for a piece of few bytes: the next pair is searched among all."""
    rank_of, never = ranks.get, 1 << 62
    n = len(piece)
    cuts = list(range(n + 1))  # bounds of the tokens
    pairs = [rank_of(piece[i : i + 2], never) for i in range(n - 1)]
    while pairs and (least := min(pairs)) < never:
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = rank_of(piece[cuts[i] : cuts[i + 2]], never)
        if i:
            pairs[i - 1] = rank_of(piece[cuts[i - 1] : cuts[i + 1]], never)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: always the leftmost pair of the smallest rank merges next.

    A leaf holds rank * width + position for the pair that starts at a live byte position,
    so the root is the smallest rank and, among equals, the leftmost. A merge changes three
    leaves: the pair itself, the position it swallows, and the live neighbour on the left.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:
        return merged_short(piece, ranks)
    width = 1 << (n - 1).bit_length()
    rank_of, never = ranks.get, 1 << 62
    ends = list(range(1, n + 1))  # of the token that starts at a live position
    starts = list(range(-1, n))  # of the token before a live position
    tree = [never] * (2 * width)
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(at: int, value: int) -> None:
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            if other < value:
                value = other
            at >>= 1
            if tree[at] == value:
                return
            tree[at] = value

    while (root := tree[1]) < never:
        i = root & (width - 1)
        j = ends[i]
        end = ends[i] = ends[j]
        starts[end] = i
        if tree[width + j] < never:
            put(width + j, never)
        rank = rank_of(piece[i : ends[end]]) if end < n else None
        put(width + i, never if rank is None else rank * width + i)
        left = starts[i]
        if left >= 0:
            rank = rank_of(piece[left:end])
            value = never if rank is None else rank * width + left
            if tree[width + left] != value:
                put(width + left, value)

    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


def splitter(pattern: str) -> regex.Pattern:
    """``pattern`` with the letters and numbers of Unicode 16."""
    for kind in ("L", "N"):
        pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{NEWER}]]")
    return regex.compile(pattern, regex.VERSION1)


class Encoder:
    """Ids of whole texts. Pieces are remembered in two generations of a fixed size, ids as four bytes each."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.exact = load(path), splitter(pattern).findall
        self.plain, self.newer = regex.compile(pattern).findall, regex.compile(f"[{NEWER}]").search
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        # all of NEWER lies above U+0557, whose bytes begin below 0xD5
        plain = text.isascii() or np.frombuffer(text.encode(), np.uint8).max() < 0xD5 or not self.newer(text)
        return self.plain(text) if plain else self.exact(text)

    def extend(self, text: str, out: array | list) -> None:
        pieces = self.pieces(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self.learn(p) if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        out.extend(array("i", b"".join(found)))

    def learn(self, piece: str) -> bytes:
        ids = self.known.get(piece) or self.older.get(piece) or array("i", merged(piece.encode(), self.ranks)).tobytes()
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        if len(piece) <= LONGEST:
            self.known[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def lists(offsets: list[int], values: array) -> pa.Array:
    flat = pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def encoded(own: Encoder, texts: pa.Array) -> Iterator[pa.Array]:
    """The ids of ``texts``, a list each, in batches that end with the first text to reach BATCH_IDS."""
    offsets, out = [0], array("i")  # four bytes an id
    for text in texts:
        own.extend(text.as_py() or "", out)
        offsets.append(len(out))
        if len(out) >= BATCH_IDS:
            yield lists(offsets, out)
            offsets, out = [0], array("i")
    if len(offsets) > 1 or not len(texts):
        yield lists(offsets, out)


def encode(path: str, pattern: str) -> Callable[[Column], Column]:
    """A column function from text to token ids.

    ``path`` is the rank file, at the same place on every machine. Null and empty texts
    have no ids. A text is split by ``pattern`` and never cut elsewhere. Ids go back in batches
    of about BATCH_IDS, however many texts a worker gets at once.
    """

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern)
        for texts in batches:
            yield from encoded(own, texts)

    # else a plan that reads the ids twice, as to decode them, may encode twice
    return ids.asNondeterministic()


def decode(path: str) -> Callable[[Column], Column]:
    """A column function from token ids to bytes; null ids give null. An unknown id fails the job."""

    @F.arrow_udf("binary")
    def data(ids: pa.Array) -> pa.Array:
        token = load_bytes(path).__getitem__
        ends, values, missing = ids.offsets.to_numpy(), ids.values.to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        return pa.array([
            None if gone else b"".join(map(token, values[a:b].tolist()))
            for gone, a, b in zip(missing, ends[:-1], ends[1:], strict=True)
        ], pa.binary())

    return data
