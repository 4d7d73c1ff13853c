"""The stages of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import bpe, ngram_join, quality, secret_scan, templates
from jobloom.llm.spread import small, table
from jobloom.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    It learns from ``labels`` of documents that are present; with no usable labels all stay.
    Null and empty texts are scored like others, and repeated rows alike.
    """
    model = quality.fit(quality.labelled(docs, table(spark, sf_dir, "labels")))
    kept = quality.scored(docs, model, "__score").filter(F.col("__score") >= quality.THRESHOLD)
    return kept.drop("__score")


def rows_by_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the column that tells its rows apart: doc_id, if no id is null or repeats.

    Otherwise rows are written once with a number of their own. Ids are counted first, so that
    texts are written again only where that is needed.
    """
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return docs, "doc_id"
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows"), "__row"


def without_rows(rows: DataFrame, key: str, gone: DataFrame, names: list[str], name: str) -> DataFrame:
    """The columns ``names`` of ``rows`` whose ``key`` is not in the one column of ``gone``."""
    ids, _ = small(gone.select(F.col(gone.columns[0]).alias("__id")).distinct(), name)
    return rows.join(ids, rows[key] == ids["__id"], "left_anti").select(*names)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id.

    Rows are told apart by their own, so unlike texts that share a doc_id all stay, and rows
    without a doc_id go if they are like others, which come first if they have one. Of documents
    without words, only repeated rows of a doc_id and text go.
    """
    names = docs.columns
    rows, key = rows_by_key(docs)
    groups = ngram_join.similar(rows.select(F.col(key).alias("doc_id"), "text"))
    if key == "doc_id":
        return without_rows(rows, key, groups.filter("class_id <> doc_id").select("doc_id"), names, "near-duplicates")
    own = rows.select(F.col(key).alias("__key"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    of = own.join(groups.select(F.col("doc_id").alias("__key"), "class_id", "n_ngrams"), "__key")
    words = F.col("n_ngrams") > 0
    of = of.filter(words | F.col("doc_id").isNotNull()).select(
        F.when(words, F.col("class_id")).alias("class"), F.when(~words, F.col("doc_id")).alias("id"), F.when(~words, F.col("hash")).alias("same"),
        F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "__key").alias("order"))
    of = written(of, "row-groups")
    first = of.groupBy("class", "id", "same").agg(F.min("order").alias("first")).select("first.__key")
    gone = of.select("order.__key").join(first, "__key", "left_anti")
    return without_rows(rows, key, gone, names, "near-duplicates")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows into which no item of ``benchmark`` leaks, whether they have a doc_id or share one."""
    names = docs.columns
    rows, key = rows_by_key(docs)
    found = templates.found(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without_rows(rows, key, found.select("doc_id"), names, "leaks")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and ``n_chars`` counted anew."""
    found = secret_scan.scan(docs, ledger=secret_scan.empty_ledger(spark)).findings
    found = written(secret_scan.per_blob(found), "secret-spans")
    # Few blobs hold secrets: if their hashes can be broadcast, no other text is shuffled again.
    hashes, few = small(found.select(F.xxhash64("blob").alias("__has")).distinct(), "secret-hashes")
    clean = secret_scan.redacted(docs, found, hashes=hashes if few else None)
    changed = F.col("n_chars").isNotNull() & F.col("text").isNotNull()
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text; null and empty texts have no ids."""
    coded = docs.select("doc_id", bpe.encode(RANKS, public_tokenizers.PATTERN)("text").alias("ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("tokens", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
