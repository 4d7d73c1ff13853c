"""Documents drawn to look like a target set: importance resampling over hashed word runs."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from jobloom.operators.ranking import global_row_number
from jobloom.session import written

BUCKETS = 10_000
#: Words of the longest run that is a feature.
RUN = 1
#: Words that a document must have to be drawn, and the share that is drawn, in percent.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024

#: Words are runs of digits, small letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Characters that are split at once; longer texts are cut at the next gap.
SLICE = 1 << 20

FEATURES = "row long, doc_id long, n_words long, n_features long, buckets binary"


@functools.lru_cache(maxsize=1)
def splitter() -> pre_tokenizers.PreTokenizer:
    """An untrained pre-tokenizer that keeps the words and drops the gaps."""
    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def lowered(text: str) -> str:
    """Only A to Z become small; other letters stay."""
    return text.encode().lower().decode()


def words_of(text: str) -> list[tuple[str, tuple[int, int]]]:
    """The words of a whole lower-cased text, each with its start and end in it."""
    split, out, start = splitter().pre_tokenize_str, [], 0
    while start < len(text):
        gap = GAP.search(text, start + SLICE)
        stop = gap.end() if gap else len(text)
        part = split(text[start:stop])
        out += [(w, (a + start, b + start)) for w, (a, b) in part] if start else part
        start = stop
    return out


def hashes(text: str, run: int) -> tuple[int, list[int]]:
    """The number of words, and the CRC of each run of 1 to ``run`` words.

    A run reaches from the start of its first word to the end of its last; the gaps in it count
    as one space.
    """
    text = lowered(text)
    words = words_of(text)
    out = [crc32(w.encode()) for w, _ in words]
    spans = [s for _, s in words] if run > 1 else []
    for k in range(2, run + 1):
        out += [crc32(GAP.sub(" ", text[a:b]).encode()) for (a, _), (_, b) in zip(spans, spans[k - 1 :])]  # noqa: B905
    return len(words), out


def kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def features(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """FEATURES of each row: its numbers of words and features, and the features' buckets, packed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            counts, packed = [], []
            for text in batch.column(1):
                n, found = hashes(text.as_py() or "", run)
                counts.append((n, len(found)))
                packed.append((np.array(found, np.uint32) % np.uint32(buckets)).astype(kind(buckets)).tobytes())
            n_words, n_features = zip(*counts, strict=True) if counts else ((), ())
            rows = pa.array(range(at, at + len(packed)), pa.int64())
            at += len(packed)
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(packed, pa.binary())],
                ["row", "doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(build, FEATURES)


def unpacked(packed: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, buckets) of packed features; row i has those from bounds[i] to bounds[i + 1]."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return (offsets - offsets[0]) // np.dtype(kind(buckets)).itemsize, data.view(kind(buckets))


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``rows`` fall into each bucket.

    A task adds up its own rows, so that at most ``buckets`` numbers a task are shuffled, and as
    many in all come here.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(unpacked(batch.column(0), buckets)[1], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["bucket", "n"])

    found = rows.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: the smoothed log ratio of its share of the target to that of the source, in thousandths."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weight(gain: np.ndarray, buckets: int):
    """A column function from packed features to the sum of their gains."""

    @F.arrow_udf("long")
    def add_up(packed: pa.Array) -> pa.Array:
        bounds, at = unpacked(packed, buckets)
        sums = np.concatenate(([0], np.cumsum(gain[at])))
        return pa.array(sums[bounds[1:]] - sums[bounds[:-1]])

    return add_up


def noise(doc_id: Column, seed: int) -> Column:
    """A fixed Gumbel draw for each doc_id, in thousandths. A null doc_id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(
    docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED, target_key: str = "item_id",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    Features are all runs of 1 to ``run`` words, in ``buckets`` by their CRC; ``weight`` is the sum
    of their gains towards ``target``, ``score`` that and the row's ``noise``. Of the rows with
    ``least_words`` words or more, ``percent`` per cent, rounded down, have a ``rank``: those of the
    highest scores, ties to the smaller doc_id; that is a draw without replacement by weight.

    Null and empty texts have no features and weight 0. Rows without a doc_id come last among
    ties; rows that share one are scored and ranked one by one. An empty ``docs`` gives no rows, an
    empty ``target`` the gains of a flat one. Other columns are left out.
    """
    rows = written(features(docs, run, buckets), "word-runs")
    gain = gains(histogram(rows, buckets), histogram(features(target, run, buckets, target_key), buckets))
    scored = rows.select(
        "row", "doc_id", "n_features", (F.col("n_words") >= least_words).alias("enough"), weight(gain, buckets)("buckets").alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    drawn = percent * rows.filter(F.col("n_words") >= least_words).count() // 100
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    placed = global_row_number(scored, order, "place")
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
