"""Text in which board addresses are looked for, and the crawl's bookkeeping."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import SPACE
from jobloom.schemas import CANDIDATE


def seed_lines(lines: DataFrame) -> DataFrame:
    """Lines (``value``) that are not comments."""
    bare = F.regexp_replace("value", rf"(?U)^{SPACE}+", "")
    return lines.where(~bare.startswith("#"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return seed_lines(spark.read.text(path))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, one row each: (origin, body)."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("origin"), F.col("value").alias("body")
    )


def index_urls(lines: DataFrame) -> DataFrame:
    """URL of every JSON line; blank and malformed lines are skipped, no url is ''."""
    parsed = lines.withColumn("_json", F.try_parse_json("value"))
    return parsed.where(F.col("_json").isNotNull()).withColumn(
        "url", F.coalesce(F.try_variant_get("_json", "$.url", "string"), F.lit(""))
    ).drop("_json")


def newest_indexes(indexes: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` of the index list, which has the newest first; all by default.

    An empty list stays empty: a caller that could not fetch one passes its own.
    """
    return indexes if n is None else indexes.orderBy("list_ord").limit(n)


def answered(pairs: DataFrame) -> DataFrame:
    """Pairs whose page count is known. Only these may be marked as done; a page of
    theirs that failed is left out, and stays out."""
    return pairs.where(F.col("num_pages").isNotNull())


def pages_to_fetch(counts: DataFrame, max_pages: int | None = None) -> DataFrame:
    """One row per page of each (index, pattern), at most ``max_pages`` each if that is given."""
    fetch = F.coalesce("num_pages", F.lit(0)).cast("int")
    if max_pages is not None:
        fetch = F.least(fetch, F.lit(max_pages))
    pages = F.when(fetch > 0, F.sequence(F.lit(0), fetch - 1))
    return counts.select("index_name", "pattern", F.explode(pages).alias("page"))


def pending_pairs(pairs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(index, pattern) pairs the ledger does not list as done."""
    return pairs.join(
        ledger.select("index_name", "pattern").distinct(), ["index_name", "pattern"], "left_anti"
    )


def append_ledger(path: str, pairs: DataFrame, candidates: DataFrame) -> None:
    """Store candidates and their pairs as one attempt, which counts once ``manifest`` names it.

    A crash before that leaves rows that are never read: the pairs are pending still, and what
    they find is stored once.
    """
    attempt = uuid.uuid4().hex
    candidates.write.parquet(f"{path}/found/attempt={attempt}")
    pairs.select("index_name", "pattern").write.parquet(f"{path}/done/attempt={attempt}")
    name_attempt(pairs.sparkSession, path, attempt)


def name_attempt(spark: SparkSession, path: str, attempt: str) -> None:
    row = spark.createDataFrame([(attempt,)], "attempt STRING")
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _named(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of the attempts that the manifest names; none before the first."""
    try:
        named = spark.read.schema("attempt STRING").parquet(f"{path}/manifest").distinct()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, attempt STRING").parquet(f"{path}/{kind}")
    return rows.join(named, "attempt", "left_semi").drop("attempt")


def done_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark, path, "done", "index_name STRING, pattern STRING")


def ledger_candidates(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark, path, "found", CANDIDATE)
