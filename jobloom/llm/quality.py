"""Document quality by pairwise ranking (Bradley-Terry)."""

from __future__ import annotations

import math
import operator
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from jobloom.llm.html_text import STOP_WORDS

#: Labelled documents that a fit takes at most, those of the smallest hashes.
MOST_LABELLED = 20_000
#: Preference pairs drawn from them.
PAIRS = 100_000
#: Score at which a document counts as good.
THRESHOLD = 0.3
SHIFT = math.log(THRESHOLD / (1 - THRESHOLD))

SYMBOLS = "#$%&*+/<=>@\\^_`{|}~[]"
CAPITAL = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de\u0391-\u03a9\u0410-\u042f]").findall
LONE_MARKS = re.compile(r"(?<!\S)[^\w\s]+(?!\S)").findall
MARKS = ".,;:!?\"'()"

NAMES = (
    "log_words", "word_length", "distinct_words", "symbols", "shouts", "stops_and_commas", "digits",
    "capitals", "repeats", "stop_words", "lone_marks", "repeated_lines", "line_length",
)


def measured(text: str) -> tuple[float, ...]:
    """The features NAMES of a whole text."""
    words = text.lower().split()
    lines = text.split("\n")
    n, w = max(1, len(text)), max(1, len(words))
    share = lambda chars: sum(map(text.count, chars)) / n
    return (
        math.log1p(len(words)),
        min(len(text) / w, 20.0) / 10,
        len(set(words)) / math.sqrt(w),
        share(SYMBOLS),
        share("!?"),
        share(".,"),
        share("0123456789"),
        len(CAPITAL(text)) / n,
        sum(map(operator.eq, words, words[1:])) / w,
        sum(x.strip(MARKS) in STOP_WORDS for x in words) / w,
        len(LONE_MARKS(text)) / w,
        1 - len(set(lines)) / len(lines),
        math.log1p(len(text) / len(lines)),
    )


@F.arrow_udf(ArrayType(DoubleType()))
def features(texts: pa.Array) -> pa.Array:
    """A column function from text to the features NAMES; null counts as empty."""
    return pa.array([measured(t.as_py() or "") for t in texts], pa.list_(pa.float64()))


def basis(x: np.ndarray) -> np.ndarray:
    """Features, their squares and their square roots, so that a score may bend."""
    return np.hstack([x, np.square(x), np.sqrt(np.abs(x))])


class Model(NamedTuple):
    """A score is linear in the basis; ``cut`` is the score at THRESHOLD, ``slope`` its steepness."""

    weights: tuple[float, ...]
    cut: float
    slope: float

    def score(self, own: Column) -> Column:
        """From features to a score between 0 and 1, higher for better. Without weights always 0.5."""
        if not self.weights:
            return F.lit(0.5)
        x = [F.element_at(own, i + 1) for i in range(len(NAMES))]
        raw = F.lit(0.0)
        for weight, c in zip(self.weights, [*x, *(c * c for c in x), *(F.sqrt(F.abs(c)) for c in x)], strict=True):
            raw = raw + F.lit(weight) * c
        return 1 / (1 + F.exp(-(F.lit(self.slope) * (raw - F.lit(self.cut)) + F.lit(SHIFT))))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, y, x) of at most ``most`` labelled documents, one row a document.

    Of conflicting labels the smaller counts; of rows that share a doc_id one text is taken.
    Labels other than 0 and 1, and nulls, are left out.
    """
    y = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    y = y.groupBy("doc_id").agg(F.min("quality").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    y = F.broadcast(y)  # at most ``most`` rows of two numbers
    rows = docs.select("doc_id", "text").join(y, "doc_id").select("doc_id", F.struct("y", features("text").alias("x")).alias("row"))
    return rows.groupBy("doc_id").agg(F.max("row").alias("row")).select("doc_id", "row.*")


def fit(rows: DataFrame, pairs: int = PAIRS, seed: int = 7, penalty: float = 1e-3) -> Model:
    """A Bradley-Terry model of ``labelled`` rows, whose number is bounded.

    Each pair is a good and a bad document drawn at random; the logistic loss on the
    difference of their features is minimised by Newton steps. The cut is the quantile of the
    scores at the share of bad labels; the slope is fitted on the same rows around that cut.
    With labels of one kind only, the model has no weights.
    """
    got = sorted({r.doc_id: r for r in sorted(rows.collect())}.values())
    y = np.array([r.y for r in got], float)
    if not len(got) or y.min() == y.max():
        return Model((), 0.0, 1.0)
    x = basis(np.array([r.x for r in got], float))
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = (x - x.mean(axis=0)) / scale
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = d.T @ p / pairs - penalty * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    s = z @ w
    cut = float(np.quantile(s, 1 - y.mean()))
    k = 1.0
    for _ in range(50):  # one-dimensional logistic fit of the slope around the cut
        m = np.clip(k * (s - cut) + SHIFT, -500, 500)
        p = 1 / (1 + np.exp(-m))
        bend = float((p * (1 - p) * np.square(s - cut)).sum()) + 1e-9
        k = min(5.0, max(0.05, k + float(((y - p) * (s - cut)).sum()) / bend))
    weights = w / scale
    return Model(tuple(map(float, weights)), cut + float((x.mean(axis=0) * weights).sum()), k)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a score of every text, null and empty texts too.

    A column that already has this name is replaced.
    """
    names = [c for c in docs.columns if c != name]
    rows = docs.withColumn("__features", features("text"))
    return rows.select(*names, model.score(F.col("__features")).alias(name))
