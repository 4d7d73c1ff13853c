"""First-row and cross-source duplicate removal."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import fuzzy_key
from jobloom.operators.skew import HOT_ROWS, join_unique, largest

KeyFn = Callable[[Column, Column, Column], Column]
Keep = Callable[[DataFrame, str], DataFrame]
#: Bits of the filter of keys that ``cross_source_marked`` broadcasts: 16 MB at most.
FILTER_BITS = 1 << 27


def with_key(df: DataFrame, key_fn: KeyFn = fuzzy_key, out: str = "fuzzy_key") -> DataFrame:
    return df.withColumn(out, key_fn(F.col("company"), F.col("title"), F.col("location")))


def first_per_key(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The row with the lowest ``seq`` of every key.

    An aggregate, not a window: duplicates shrink before the shuffle, so a key
    with very many rows costs its task one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(seq)).alias("_first")
    picked = df.groupBy(*keys).agg(first)
    return picked.select(*[c if c in keys else F.col(f"_first.{c}") for c in df.columns])


def cross_source_marked(
    postings: DataFrame, key_fn: KeyFn = fuzzy_key, hot_rows: int = HOT_ROWS, keep: Keep | None = None
) -> DataFrame:
    """Postings plus ``dropped``: true if the key was first seen under another source.

    Twins of one source are kept, and so are rows without a key. One aggregate by
    key gives the first source, whether there is another one, and the row count
    that tells hot keys; only keys with two sources or more are joined back. ``keep`` stores
    those and the hot ones first: the keys are shuffled before the rows then, not beside them, and
    Spark, which sees how few hot keys there are, does not shuffle the rows for them. A filter of
    fixed size tells most rows whose key is not joined; those are not shuffled at all.
    """
    rows = with_key(
        postings.withColumn("source", F.coalesce("source", F.lit("workday"))), key_fn
    )
    # Rows without a key share the group '', so that no NULL filter sets the two
    # uses of the aggregate apart: Spark then shuffles it once for both. Each use
    # reads all four values for the same reason.
    # Sources are compared by hash: buffers of fixed width keep it a hash aggregate, where
    # strings would have the whole batch sorted.
    rows = rows.withColumns(
        {"_key": F.coalesce("fuzzy_key", F.lit("")), "_source": F.xxhash64("source")}
    )
    per_key = rows.groupBy("_key").agg(
        F.min_by("_source", "seq").alias("_first_source"),
        F.min("_source").alias("_low"),
        F.max("_source").alias("_high"),
        F.count(F.lit(1)).alias("_n"),
    )
    if keep is not None:
        several = (F.col("_low") != F.col("_high")) | (F.col("_n") >= hot_rows)
        per_key = keep(per_key.where(several), "repeated-keys")
    counts = per_key.where(
        F.col("_first_source").isNotNull() & (F.col("_low") <= F.col("_high"))
    ).select(F.xxhash64("_key").alias("_h"), "_n")
    mixed = per_key.where((F.col("_low") != F.col("_high")) & (F.col("_n") > 0))
    hot = largest(counts, hot_rows)
    # The key moves once with a row, and what can be told from other columns does not.
    rows = rows.withColumn("_keyed", F.col("fuzzy_key").isNotNull()).drop("fuzzy_key", "_source")
    near = rows if keep is None else _may_be_in(rows, mixed)
    joined = join_unique(
        near if keep is None else near.where("_near").drop("_near"),
        mixed.select("_key", "_first_source"),
        ["_key"],
        "left",
        "seq",
        hot=hot if keep is None else keep(hot, "hot-keys"),
    )
    if keep is not None:
        far = near.where(~F.col("_near")).drop("_near").withColumn("_first_source", F.lit(None).cast("bigint"))
        joined = joined.unionByName(far)
    dropped = F.col("_keyed") & F.coalesce(
        F.xxhash64("source") != F.col("_first_source"), F.lit(False)
    )
    out = joined.withColumns({"fuzzy_key": F.when(F.col("_keyed"), F.col("_key")), "dropped": dropped})
    return out.select(*postings.columns, "fuzzy_key", "dropped")


def _may_be_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_near``: false only if their ``_key`` is none of ``keys``.

    The keys' hashes set bits of a bitmap, which is broadcast in parts of 4 KB. The more keys, the
    more rows come out near that are not.
    """
    spot = F.pmod(F.xxhash64("_key"), F.lit(FILTER_BITS))
    part, bit = F.bitmap_bucket_number(spot).alias("_part"), F.bitmap_bit_position(spot)
    bits = keys.groupBy(part).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.col("_bits").substr((F.col("_bit") / 8).cast("int") + 1, F.lit(1))
    mask = F.conv(F.hex(byte), 16, 10).cast("int")
    set_ = F.expr("shiftright(_mask, CAST(_bit % 8 AS INT)) & 1") == 1
    placed = rows.select("*", part, bit.alias("_bit")).join(F.broadcast(bits), "_part", "left")
    near = placed.withColumn("_mask", mask).withColumn("_near", F.coalesce(set_, F.lit(False)))
    return near.drop("_part", "_bit", "_bits", "_mask")


def cross_source_dedupe(
    postings: DataFrame, key_fn: KeyFn = fuzzy_key, hot_rows: int = HOT_ROWS
) -> DataFrame:
    marked = cross_source_marked(postings, key_fn, hot_rows)
    return marked.where(~F.col("dropped")).drop("dropped", "fuzzy_key")
