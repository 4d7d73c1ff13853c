"""Exact nearest vectors by inner product: columnar branch and bound over block pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.session import written

#: Vectors in a block of candidates and in a block of queries; both bound a task's memory.
CANDIDATES, QUERIES = 4096, 512
#: Dimensions added per step.
DIMENSIONS = 16
#: Candidate blocks that one task goes through for each of its query blocks.
BLOCKS_PER_TASK = 8
#: Query blocks that meet the same copy of a candidate block.
QUERY_BLOCKS_PER_TASK = 16
#: Largest scores that float64 sums hold exactly.
EXACT = float(1 << 53)

BLOCK = "ids binary, dims int, code string, data binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): one vector of whole numbers per id, floor(scale * x), if all of them are finite.

    Of rows that share an id, the smallest of these vectors stays.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x * F.lit(float(scale))))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    # beyond EXACT every double is whole, and a long would not hold it
    whole = F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return rows.select("id", whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors, stored dimension by dimension. Shorter vectors get zeros."""

    def block(ids: list[int], vectors: list[list[float]]) -> pa.RecordBatch:
        dims = max(map(len, vectors))
        whole = np.zeros((dims, len(ids)))
        for i, v in enumerate(vectors):
            whole[: len(v), i] = v
        code = "<i2" if not whole.size or np.abs(whole).max() < 1 << 15 else "<f8"
        return pa.RecordBatch.from_pydict({
            "ids": [np.array(ids, "<i8").tobytes()], "dims": pa.array([dims], pa.int32()),
            "code": [code], "data": [whole.astype(code).tobytes()],
        })

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[list[float]] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield block(ids[:size], vectors[:size])
                ids, vectors = ids[size:], vectors[size:]
        if ids:
            yield block(ids, vectors)

    full = rows.repartition(max(1, -(-rows.count() // size)))  # else each partition ends in a block that isn't full
    return full.select("id", "v").mapInArrow(pack, BLOCK)


def unpacked(ids: bytes, dims: int, code: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the vectors, one row per dimension."""
    names = np.frombuffer(ids, "<i8")
    return names, np.frombuffer(data, code).reshape(dims, len(names)).astype(np.float64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Search:
    """The k best candidates so far for each query of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.top = [(np.empty(0, np.float64), np.empty(0, np.int64)) for _ in ids]

    def floor_of(self, i: int) -> float:
        scores = self.top[i][0]
        return scores[-1] if len(scores) == self.k else -np.inf

    def keep(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.top[i][0], scores)), np.concatenate((self.top[i][1], ids))
        order = best(scores, ids, self.k)
        self.top[i] = scores[order], ids[order]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Branch and bound over one block of candidates.

        Scores grow by DIMENSIONS at a time, those of most mass first. What the dimensions
        left can still add is at most the product of both remaining norms (Cauchy-Schwarz),
        so a candidate goes once its upper bound is below the k-th best lower bound.
        Equal bounds stay, since ties are told apart by id.
        """
        dims = max(len(vectors), len(self.vectors))
        q, x = (np.pad(m, ((0, dims - len(m)), (0, 0))) for m in (self.vectors, vectors))
        if not len(ids):
            return
        if dims and dims * np.abs(q).max() * np.abs(x).max() >= EXACT:
            return self.add_large(ids, q, x)
        order = np.argsort(-np.square(x).sum(axis=1), kind="stable")
        q, x = q[order], x[order]
        rest_q, rest_x = rest_norms(q), rest_norms(x)
        first = min(DIMENSIONS, dims)
        partial = q[:first].T @ x[:first]
        for i, own in enumerate(self.ids):
            score, live = partial[i], np.flatnonzero(ids != own)
            score, done = score[live], first
            while len(live):
                slack = rest_q[done, i] * rest_x[done, live] * (1 + 1e-9) + (1e-6 if done < dims else 0)
                bound = self.floor_of(i)
                if len(live) > self.k:
                    bound = max(bound, np.partition(score - slack, len(live) - self.k)[len(live) - self.k])
                stay = score + slack >= bound
                live, score = live[stay], score[stay]
                if done == dims:
                    break
                to = min(done + DIMENSIONS, dims)
                score = score + q[done:to, i] @ x[done:to, live]
                done = to
            self.keep(i, score, ids[live])

    def add_large(self, ids: np.ndarray, q: np.ndarray, x: np.ndarray) -> None:
        """Numbers too large for float64 sums, in whole numbers of any size.

        Scores outside the range of a long are set to its nearest end.
        """
        q, x = (np.array([[int(c) for c in row] for row in m], object).reshape(m.shape) for m in (q, x))
        for i, own in enumerate(self.ids):
            live = np.flatnonzero(ids != own)
            scores = [max(-(1 << 63), min((1 << 63) - 1, int(sum(q[:, i] * x[:, j])))) for j in live]
            old = [(int(s), int(j)) for s, j in zip(*self.top[i], strict=True)]
            rows = sorted([*old, *zip(scores, ids[live].tolist(), strict=True)], key=lambda r: (-r[0], r[1]))[: self.k]
            self.top[i] = np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], np.int64)

    def rows(self) -> pa.RecordBatch:
        out = [(int(q), int(v), int(s)) for q, t in zip(self.ids, self.top, strict=True) for s, v in zip(*t, strict=True)]
        names = ("query_id", "vec_id", "score")
        return pa.RecordBatch.from_pydict({n: pa.array([r[j] for r in out], pa.int64()) for j, n in enumerate(names)})


def rest_norms(m: np.ndarray) -> np.ndarray:
    """Norm of each column over the rows from each row on; the last row is zero."""
    squares = np.vstack([np.square(m), np.zeros(m.shape[1])])
    return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])


def groups(blocks: int, per_task: int) -> int:
    """Groups that so many blocks are dealt to."""
    return max(1, -(-blocks // per_task))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * x).

    A query's own id is no candidate. Ties go to the smaller id. Rows with a null id, a null
    vector, or a component that is null or not finite, itself or ``scale`` times, take no part; of
    rows sharing an id the smallest vector of whole numbers counts. Vectors of different
    lengths are padded with zeros. Fewer than k candidates give fewer rows; without queries or
    candidates there are none. Other columns are left out.

    Query blocks meet candidate blocks on a grid of (query group, candidate group) keys, so a
    candidate block is shuffled once per group of QUERY_BLOCKS_PER_TASK query blocks. A task
    holds one block of each kind at a time, and its queries' best k.
    """
    c = written(blocks(written(usable(candidates, id_col, vector_col, scale), "vectors"), CANDIDATES), "candidates")
    q = written(blocks(written(usable(queries, id_col, vector_col, scale), "vectors"), QUERIES), "queries")
    group_c, group_q = groups(c.count(), BLOCKS_PER_TASK), groups(q.count(), QUERY_BLOCKS_PER_TASK)

    def dealt(df: DataFrame, number: int, own: str, other: str, others: int) -> DataFrame:
        """Each block once per group of the other side."""
        mine = F.pmod(F.xxhash64("ids"), F.lit(number)).cast("int").alias(own)
        return df.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left = dealt(q, group_q, "g", "h", group_c).select("g", "h", *(F.col(x).alias(f"q_{x}") for x in q.columns))
    pairs = left.join(dealt(c, group_c, "h", "g", group_q), ["g", "h"])
    pairs = pairs.sortWithinPartitions("g", "h", "q_ids")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if row["q_ids"] != now:
                    if state:
                        yield state.rows()
                    now = row["q_ids"]
                    state = Search(*unpacked(now, row["q_dims"], row["q_code"], row["q_data"]), k)
                state.add(*unpacked(row["ids"], row["dims"], row["code"], row["data"]))
        if state:
            yield state.rows()

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
