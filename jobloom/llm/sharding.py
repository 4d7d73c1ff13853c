"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.spread import join_per_key
from jobloom.session import written

SHARD_BYTES = 16 << 20
#: Bits of the hash; a hash is the first 15 hex digits of an MD5 sum.
HASH_BITS = 60
#: Bits looked at per round of splitting.
STEP = 8


def row_hash(key: Column, text: Column) -> Column:
    """60 bits of key and text together, so rows of one key still part by their texts."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def prefix(bits: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits as a number."""
    return F.call_function("shiftright", bits, F.lit(HASH_BITS) - depth)


def directory(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows): the buckets that ``rows`` (hash, size) end in.

    Starts with one bucket. A bucket over ``limit`` splits on its next bit, until all fit or
    all bits are used. Sizes are summed once per round down to STEP bits below the buckets
    still open, so a round reads each open row once and yields at most 2^STEP cells for each.
    """
    open_rows, top, found = rows, 0, []
    while top <= HASH_BITS:
        last = min(top + STEP, HASH_BITS)
        cells = open_rows.groupBy(prefix(F.col("hash"), F.lit(last)).alias("cell")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n")
        )
        levels = cells.select(
            F.explode(F.sequence(F.lit(top), F.lit(last))).alias("depth"), "cell", "size", "n"
        ).withColumn("prefix", F.call_function("shiftright", "cell", F.lit(last) - F.col("depth")))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        sums = written(sums, "directory")
        up = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("size").alias("above"))
        split = sums.withColumn("parent", F.call_function("shiftright", "prefix", F.lit(1))).join(up, ["depth", "parent"], "left")
        done = (F.col("size") <= limit) | (F.col("depth") == HASH_BITS)
        first = (F.col("depth") == top) | (F.col("above") > limit)
        found.append(split.filter(done & first).select("depth", "prefix", F.col("size").alias("shard_bytes"), F.col("n").alias("shard_rows")))
        too_large = sums.filter((F.col("depth") == last) & (F.col("size") > limit)).select(F.col("prefix").alias("cell"))
        if last == HASH_BITS or too_large.isEmpty():
            break
        open_rows = open_rows.join(too_large, prefix(F.col("hash"), F.lit(last)) == F.col("cell"), "left_semi")
        top = last + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes) for every row of ``docs``.

    ``shard`` is the bucket's hash prefix in binary digits, 'all' for the only bucket of
    depth 0. The size of a row is the bytes of its text, 0 for null; a null key hashes as an
    empty one. Repeated rows share all bits. If together they pass ``limit``, they fill
    numbered overflow shards ('<prefix>+1', ...) of that bucket. Only a single text over
    ``limit`` makes a shard larger than ``limit``. No rows give no rows.
    """
    rows = docs.select(
        F.col(key).alias("__key"),
        row_hash(F.col(key), F.col(text)).alias("hash"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("size"),
    )
    rows = written(rows, "shard-sizes")
    buckets = written(directory(rows.select("hash", "size"), limit), "shards")
    out = assigned(rows, buckets)
    repeated = (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    if not buckets.filter(repeated).isEmpty():
        out = written(out, "shard-rows")
        out = out.filter(~repeated).unionByName(overflow(out.filter(repeated), limit))
    return out.select(F.col("__key").alias(key), F.col("size").alias("n_bytes"), "shard", "depth", "shard_bytes")


def assigned(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each row with its bucket, by one equi-join for each depth in use.

    A hot prefix holds few bytes by construction, so no join key is hot but for repeated
    rows; those are many only in buckets of the last depth.
    """
    depths = [r.depth for r in buckets.select("depth").distinct().collect()]  # at most HASH_BITS + 1 numbers
    out = rows.limit(0).select("*", F.lit("").alias("shard"), F.lit(0).alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("shard_bytes", "shard_rows")))
    for depth in sorted(depths):
        at = buckets.filter(F.col("depth") == depth).withColumnRenamed("prefix", "__prefix")
        name = F.lit("all") if depth == 0 else F.lpad(F.bin("__prefix"), depth, "0")
        part = join_per_key(rows.withColumn("__prefix", prefix(F.col("hash"), F.lit(depth))), "__prefix", ["hash", "__key"], at, "inner")
        out = out.unionByName(part.select(*rows.columns, name.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows"))
    return out


def overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Deals repeated rows to parts that fit: they are equal, so all have one size.

    Rows are numbered within (shard, task) and shifted by the counts of the tasks before,
    so no task sees all rows of a shard.
    """
    rows = written(rows.withColumn("__task", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "shard-overflow")
    counts = rows.groupBy("shard", "__task").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumn("__i", F.row_number().over(Window.partitionBy("shard", "__task").orderBy("__at")) - 1)
    numbered = numbered.join(counts.withColumn("__before", before).drop("__n"), ["shard", "__task"])
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.col("size")))
    part = F.floor((F.col("__i") + F.col("__before")) / each)
    held = F.least(each, F.col("shard_rows") - part * each) * F.col("size")
    return numbered.select(
        "__key", "hash", "size", F.concat("shard", F.lit("+"), (part + 1).cast("string")).alias("shard"), "depth",
        held.alias("shard_bytes"), "shard_rows",
    )
