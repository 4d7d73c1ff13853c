"""Versions of job descriptions: what was landed when, and the newest as of a time.

A version is a detail payload, or a job of an Ashby board payload whose description stays a
column, never written back to JSON. Versions are numbered when they are stored, so the newest of a
key is a hash aggregate of numbers alone; bodies are fetched for the versions that won.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.operators.skew import HOT_ROWS, join_unique, largest
from jobloom.session import written

VERSION_COLS = ("source", "detail_key", "status", "body", "plain", "html", "landed")
# The fields of an Ashby board payload that are read.
BOARD_ASHBY = "struct<jobs:array<struct<id:string, descriptionPlain:string, descriptionHtml:string>>>"
#: Digits for the number of a version within its time.
DIGITS = 19

Keep = Callable[[DataFrame, str], DataFrame]


def micros(df: DataFrame, name: str = "landed") -> Column:
    """A time of landing in microseconds: of a timestamp or an ISO text; numbers as they are, 0 without one."""
    if name not in df.columns:
        return F.lit(0).cast("bigint")
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.unix_micros(F.try_to_timestamp(name))
    return F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.col(name).cast("bigint")


def board_jobs(boards: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """VERSION_COLS of the jobs of Ashby board payloads (slug, status, body), ``plain`` and ``html`` as columns.

    ``wanted`` has the detail_key of the jobs to keep; then only the boards that they are on are parsed.
    """
    if wanted is not None:
        boards = boards.join(wanted.select(F.substring_index("detail_key", "/", 1).alias("slug")).distinct(), "slug", "left_semi")
    listed = F.from_json("body", BOARD_ASHBY)["jobs"]
    each = boards.where(F.col("status") == 200).select("slug", micros(boards).alias("landed"), F.explode(listed).alias("job"))
    each = each.where(F.col("job.id").isNotNull())
    return each.select(
        F.lit("ashby").alias("source"), F.concat_ws("/", "slug", F.col("job.id")).alias("detail_key"), F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("body"), F.col("job.descriptionPlain").alias("plain"), F.col("job.descriptionHtml").alias("html"),
        "landed")


def key_counts(keyed: DataFrame, keep: Keep = written) -> DataFrame:
    """(source, detail_key, _n): the keys of jobs and their numbers of rows, stored.

    Jobs are then read for it once, and once more to be joined; keys are long to work out.
    """
    return keep(keyed.groupBy("source", "detail_key").agg(F.count(F.lit(1)).alias("_n")), "detail-keys")


def versions(details: DataFrame | None, boards: DataFrame | None, keyed: DataFrame, keep: Keep = written) -> DataFrame:
    """VERSION_COLS and ``row`` of what was landed for the jobs in ``keyed`` (source, detail_key), stored.

    ``keyed`` may be their ``key_counts``.
    """
    wanted = keyed.where(F.col("detail_key").isNotNull()).select("source", "detail_key")
    if "_n" not in keyed.columns:
        wanted = wanted.distinct()
    parts = []
    if details is not None:
        none = F.lit(None).cast("string")
        own = details.select("source", "detail_key", "status", "body", none.alias("plain"), none.alias("html"), micros(details).alias("landed"))
        parts.append(own.join(wanted, ["source", "detail_key"], "left_semi"))
    if boards is not None:
        of_ashby = wanted.where(F.col("source") == "ashby").select("detail_key")
        parts.append(board_jobs(boards, of_ashby).join(of_ashby, "detail_key", "left_semi").select(*VERSION_COLS))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return keep(every.withColumn("row", F.monotonically_increasing_id()), "detail-versions")


def newest(found: DataFrame, as_of: str | None = None) -> DataFrame:
    """(source, detail_key, rank): the newest good version of each key landed at ``as_of`` or before.

    At a tie in time it is the one stored last. Ranks are unique.
    """
    ok = found.where(F.col("status") == 200)
    if as_of is not None:
        ok = ok.where(F.coalesce("landed", F.lit(0)) <= F.unix_micros(F.to_timestamp(F.lit(as_of))))
    return ok.select("source", "detail_key", rank().alias("rank")).groupBy("source", "detail_key").agg(F.max("rank").alias("rank"))


def rank() -> Column:
    """Time and number of a version as one number that sorts like both."""
    time = F.coalesce("landed", F.lit(0)).cast("decimal(38,0)")
    return (time * F.lit(str(10**DIGITS)).cast("decimal(20,0)") + F.col("row")).cast("decimal(38,0)")


def with_newest(
    jobs: DataFrame, found: DataFrame, as_of: str | None = None, hot_rows: int = HOT_ROWS, counts: DataFrame | None = None
) -> DataFrame:
    """Jobs (with detail_key) joined to ``body``, ``plain`` and ``html`` of the newest version of their key.

    The first join fetches the bodies of the winners by rank, which both sides hold once; so jobs
    are moved once, by the second. ``counts`` are the jobs' ``key_counts``; without them jobs are
    read once more to find hot keys.
    """
    bodies = found.where(F.col("status") == 200).select(rank().alias("rank"), "body", "plain", "html")
    won = newest(found, as_of).join(bodies, "rank").drop("rank")
    keys = ["source", "detail_key"]
    hot = None
    if counts is not None:
        hot = largest(counts.select(F.xxhash64(*keys).alias("_h"), "_n"), hot_rows)
    return join_unique(jobs, won, keys, "left", "job_id", hot_rows, hot)
