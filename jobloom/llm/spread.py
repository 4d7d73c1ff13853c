"""Shared plan pieces: facts about hot keys, bounded broadcasts, table reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.session import written

#: Bytes that may be broadcast, by counted rows and the bytes a row takes.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salts(spark: SparkSession) -> int:
    """As many sub-keys as a shuffle has partitions, so a hot key can fill them all."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt(spark: SparkSession, *on: Column) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(salts(spark)))


def join_per_key(
    rows: DataFrame, key: str, spread_on: Sequence[str], per_key: DataFrame, how: str = "left"
) -> DataFrame:
    """``rows`` with the one row that ``per_key`` holds for their non-null ``key``.

    A key may own any share of ``rows``: its rows are dealt to sub-keys by ``spread_on``,
    and its row of ``per_key`` is repeated once for each sub-key in use, so the repeats
    never outnumber ``rows``.
    """
    dealt = rows.withColumn("__salt", salt(rows.sparkSession, *[F.col(c) for c in spread_on]))
    used = dealt.select(key, "__salt").groupBy(key, "__salt").agg(F.lit(1).alias("__one")).drop("__one")
    return dealt.join(used.join(per_key, key), [key, "__salt"], how).drop("__salt")


def small(df: DataFrame, name: str, row_bytes: int = 16) -> tuple[DataFrame, bool]:
    """``df`` written once, and marked for broadcast if its counted rows take BROADCAST_BYTES or less."""
    kept = written(df, name)
    fits = kept.count() * row_bytes <= BROADCAST_BYTES
    return (F.broadcast(kept) if fits else kept), fits
