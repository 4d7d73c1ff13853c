"""Joins against a unique-key side that hold up when one key owns most rows.

AQE splits skewed shuffle partitions only where both join inputs are plain
shuffles. Here one input is usually an aggregate, so hot keys are split by hand:
keys with ``hot_rows`` rows or more are found by a partial aggregation over
64-bit key hashes, and their rows are dealt to sub-keys of about ``hot_rows`` rows
each, however many that takes. Only their one row of the unique side is repeated,
so all repeats together are at most (rows / hot_rows). All other keys are shuffled
once, unsalted.

The list of hot hashes and their number of sub-keys has at most (rows / hot_rows) rows of
12 bytes, none cut off: 12 MB for 10^12 rows at the default, so Spark's own limit decides
whether it is broadcast. Raise ``hot_rows`` with the table. A hash collision only salts a key
that did not need it; joins compare real keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce as fold
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
#: Sub-keys of rows without a key, which are never repeated on the other side.
NULL_SALTS = 1 << 20


def reduce_or(tests: Iterable[Column]) -> Column:
    return fold(or_, tests)


def largest(counts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sub-keys (_h, _salts) of the hashes with ``hot_rows`` rows or more.

    ``counts`` has _h and _n. Two keys may share a hash, so it is grouped once more;
    by then it holds hot keys only.
    """
    hot = counts.where(F.col("_n") >= hot_rows).groupBy("_h").agg(F.sum("_n").alias("_n"))
    return hot.select("_h", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))


def hot_hashes(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of the keys with at least ``hot_rows`` rows, and their sub-keys."""
    counts = df.select(F.xxhash64(*keys).alias("_h")).groupBy("_h")
    return largest(counts.agg(F.count(F.lit(1)).alias("_n")), hot_rows)


def join_unique(
    fact: DataFrame,
    unique: DataFrame,
    keys: Sequence[str],
    how: str,
    spread: str | Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    reduce: Sequence[Column] | None = None,
) -> DataFrame:
    """``fact`` joined (inner, left, left_semi, left_anti) to ``unique`` on ``keys``.

    ``unique`` has one row per key, or is brought to that by the aggregates in
    ``reduce`` ([] keeps the keys alone). That happens after the salt is set, so that
    the aggregate and the join share one shuffle. ``spread`` names columns of ``fact`` that differ
    between rows of one key, such as ``seq``; they choose the salt. Counting the
    keys reads ``fact`` a second time, columns ``keys`` only: pass a stored table, or
    ``hot`` where the counts are at hand.
    """
    keys = list(keys)
    spread = [spread] if isinstance(spread, str) else list(spread)
    hot = hot_hashes(fact, keys, hot_rows) if hot is None else hot

    def with_salt(df: DataFrame, salt: Column) -> DataFrame:
        marked = df.withColumn("_h", F.xxhash64(*keys)).join(hot, "_h", "left")
        return marked.withColumn("_salt", salt).drop("_h", "_salts")

    salts = F.col("_salts")
    dealt = F.xxhash64(*spread)
    one = F.when(salts.isNotNull(), F.pmod(dealt, salts).cast("int")).otherwise(0)
    # A key with a NULL matches nothing, so its rows may lie anywhere, few or many.
    no_key = reduce_or(F.col(k).isNull() for k in keys)
    one = F.when(no_key, F.pmod(dealt, F.lit(NULL_SALTS)).cast("int")).otherwise(one)
    every = F.explode(
        F.when(salts.isNotNull(), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    )
    salted = with_salt(unique, every)
    if reduce:
        salted = salted.groupBy(*keys, "_salt").agg(*reduce)
    elif reduce is not None:
        salted = salted.select(*keys, "_salt").distinct()
    return with_salt(fact, one).join(salted, keys + ["_salt"], how).drop("_salt")
