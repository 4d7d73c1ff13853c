"""Toxic documents by a factorization machine over hashed terms."""

from __future__ import annotations

import functools
import math
import re
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a fit takes at most, those of the smallest hashes.
MOST_LABELLED = 10_000
#: Score at which a document counts as toxic.
THRESHOLD = 0.7
SHIFT = math.log(THRESHOLD / (1 - THRESHOLD))
#: Terms are hashed to this many buckets.
BUCKETS = 1 << 20
#: Letters of the word beginnings that are terms beside whole words.
BEGINNINGS = (4, 6)
#: Numbers that stand for a term in interactions.
FACTORS = 8
#: Labelled documents that must hold a term for it to count.
LEAST_DOCUMENTS = 3
#: Terms that may count by chance.
CHANCE = 100
STEPS, RATE, PENALTY, FOLDS = 200, 0.1, 1.0, 3

WORD = re.compile(r"[^\W\d_]+").findall
#: Distinct words whose terms a worker remembers, and the longest word that has beginnings.
REMEMBERED, LONGEST = 1 << 17, 64


@functools.lru_cache(maxsize=REMEMBERED)
def buckets_of(word: str) -> tuple[int, ...]:
    """The buckets of a word and of its beginnings, which are marked, so that no beginning is a word."""
    parts = [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]
    return tuple(crc32(p.encode()) % BUCKETS for p in parts)


def terms(text: str) -> np.ndarray:
    """The distinct buckets of the terms of a whole text, sorted."""
    found: set[int] = set()
    for word in set(WORD(text.lower())):
        found.update(buckets_of(word) if len(word) <= LONGEST else (crc32(word.encode()) % BUCKETS,))
    return np.array(sorted(found), np.int32)


def packed(texts: pa.Array) -> pa.Array:
    return pa.array([terms(t.as_py() or "").tobytes() for t in texts], pa.binary())


class Rows(NamedTuple):
    """Terms of documents, one after the other: the document and the term's number of each."""

    doc: np.ndarray
    term: np.ndarray
    docs: int

    def only(self, of_doc: np.ndarray) -> Rows:
        """The documents for which ``of_doc`` holds, numbered anew."""
        kept = of_doc[self.doc]
        return Rows((np.cumsum(of_doc) - 1)[self.doc[kept]], self.term[kept], int(of_doc.sum()))


class Machine(NamedTuple):
    """A bias, and a weight and FACTORS numbers per term."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def values(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Per document bias + weights + the products of the factors of all pairs of its terms; and the sums of factors.

        The pairs are had from the square of the sum less the sum of squares.
        """
        of_term = self.factors[rows.term]
        sums, squares, linear = np.zeros((rows.docs, self.factors.shape[1])), np.zeros(rows.docs), np.zeros(rows.docs)
        if len(rows.doc):
            starts = np.flatnonzero(np.diff(rows.doc, prepend=-1))
            at = rows.doc[starts]
            sums[at] = np.add.reduceat(of_term, starts)
            squares[at] = np.add.reduceat(np.square(of_term).sum(axis=1), starts)
            linear[at] = np.add.reduceat(self.weights[rows.term], starts)
        return self.bias + linear + 0.5 * (np.square(sums).sum(axis=1) - squares), sums


def trained(rows: Rows, y: np.ndarray, terms_in_all: int, seed: int = 7) -> Machine:
    """A machine that minimises the logistic loss, by Adam over all rows at once."""
    n, m, k = rows.docs, terms_in_all, FACTORS
    p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    theta = np.concatenate(([math.log(p / (1 - p))], np.zeros(m), np.random.default_rng(seed).normal(0, 0.05, m * k)))
    order = np.argsort(rows.term, kind="stable")
    starts = np.flatnonzero(np.diff(rows.term[order], prepend=-1))
    used = rows.term[order][starts]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        now = Machine(theta[0], theta[1 : 1 + m], theta[1 + m :].reshape(m, k))
        values, sums = now.values(rows)
        off = (1 / (1 + np.exp(-np.clip(values, -30, 30))) - y) / n
        slope = np.concatenate(([off.sum()], PENALTY * theta[1:] / n))
        if len(used):
            slope[1 + used] += np.add.reduceat(off[rows.doc[order]], starts)
            each = off[rows.doc][:, None] * (sums[rows.doc] - now.factors[rows.term])
            slope[1 + m :].reshape(m, k)[used] += np.add.reduceat(each[order], starts)
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Machine(float(theta[0]), theta[1 : 1 + m], theta[1 + m :].reshape(m, k))


class Model(NamedTuple):
    """A machine over ``buckets``, sorted. ``cut`` is the value that scores THRESHOLD."""

    machine: Machine
    buckets: np.ndarray
    cut: float

    def rows(self, found: list[np.ndarray]) -> Rows:
        """Those of the documents' terms that count."""
        doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
        flat = np.concatenate([*found, np.zeros(0, np.int32)])
        at = np.searchsorted(self.buckets, flat)
        known = at < len(self.buckets)
        known[known] = self.buckets[at[known]] == flat[known]
        return Rows(doc[known], at[known], len(found))

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        values, _ = self.machine.values(self.rows(found))
        return 1 / (1 + np.exp(-np.clip(values - self.cut + SHIFT, -500, 500)))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, y, terms) of at most ``most`` labelled documents, one row a document.

    Of conflicting labels the larger counts; of rows that share a doc_id one text is taken.
    Labels other than 0 and 1, and nulls, are left out.
    """
    y = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    y = F.broadcast(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # two numbers a row
    found = F.arrow_udf(packed, "binary")("text")
    rows = docs.select("doc_id", "text").join(y, "doc_id").select("doc_id", F.struct("y", found.alias("terms")).alias("row"))
    return rows.groupBy("doc_id").agg(F.max("row").alias("row")).select("doc_id", "row.*")


def counting(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets in LEAST_DOCUMENTS or more whose share of toxic ones is off by more than chance.

    Of m buckets that mean nothing about one is off by sqrt(2 ln m) standard deviations, and about
    CHANCE are by sqrt(2 ln m / CHANCE), which the penalty keeps small. So more documents, which
    have more words, ask for more.
    """
    buckets, where, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    toxic = np.bincount(where, weights=np.repeat(y, [len(x) for x in found]), minlength=len(buckets))
    p = float(y.mean())
    off = np.abs(toxic - n * p) / np.sqrt(n * p * (1 - p))
    often = n >= LEAST_DOCUMENTS
    return buckets[often & (off >= math.sqrt(2 * math.log(max(2.0, often.sum() / CHANCE))))]


def best_cut(values: np.ndarray, y: np.ndarray) -> float:
    """The value between two documents from which on calling them toxic has the highest F0.5: a false alarm costs more than a miss."""
    order = np.argsort(-values, kind="stable")
    hits = np.cumsum(y[order])
    at = int(np.argmax(1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())))
    return float(values[order[at]] + values[order[min(at + 1, len(y) - 1)]]) / 2


def fit(rows: DataFrame) -> Model | None:
    """A model of ``labelled`` rows, whose number is bounded. None if all labels are of one kind.

    The cut is chosen on documents that a machine has not seen: each of FOLDS parts is valued by a
    machine of the others.
    """
    got = sorted({r.doc_id: r for r in sorted(rows.collect())}.values())
    y = np.array([r.y for r in got], float)
    if not len(got) or y.min() == y.max():
        return None
    found = [np.frombuffer(r.terms, np.int32) for r in got]

    def model(of_doc: np.ndarray) -> Model:
        own, own_y = [x for x, use in zip(found, of_doc, strict=True) if use], y[of_doc]
        none = Model(Machine(0.0, np.zeros(0), np.zeros((0, FACTORS))), np.zeros(0, np.int32), 0.0)
        if own_y.min() == own_y.max():
            return none
        start = none._replace(buckets=counting(own, own_y))
        return start._replace(machine=trained(start.rows(own), own_y, len(start.buckets)))

    fold, values = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(min(FOLDS, len(y))):
        part = model(fold != k)
        values[fold == k] = part.machine.values(part.rows([x for x, f in zip(found, fold, strict=True) if f == k]))[0]
    return model(np.ones(len(y), bool))._replace(cut=best_cut(values, y))


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with a toxicity score between 0 and 1 of every whole text, higher for likelier toxic.

    THRESHOLD is the score of the model's cut. Null and empty texts have no terms and get the score
    of the bias alone; repeated rows score alike. Without a model every score is 0.5. A column that
    already has this name is replaced; an empty table stays empty.
    """
    names = [c for c in docs.columns if c != name]
    if model is None:
        return docs.select(*names, F.lit(0.5).alias(name))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores([terms(t.as_py() or "") for t in texts]), pa.float64())

    return docs.withColumn(name, score("text")).select(*names, name)
