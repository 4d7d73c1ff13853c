"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import alignment, bpe, html_text, ngram_join, preference_chat, quality, resampling, secret_scan, sharding, sql, templates, topk, toxicity, warc
from jobloom.llm.registry import query
from jobloom.llm.spread import table
from jobloom.session import scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op1_template_leaks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_html_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = pages.select("page_id", "url", html_text.extracted("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_secret_scan", sql.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = secret_scan.scan(docs, ledger=secret_scan.empty_ledger(spark))
    found = secret_scan.by_path(done)
    spans = F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>)"))
    line = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(line, 256).alias("base_sha256"), line.alias("spans"),
    )


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    encode, decode = bpe.encode(RANKS, public_tokenizers.PATTERN), bpe.decode(RANKS)
    coded = docs.select("doc_id", encode("text").alias("ids"))
    both = coded.select("doc_id", "ids", decode("ids").alias("data"))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


@query("op5_exact_top_k", sql.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(quality.labelled(docs, labels.filter(~held_out(F.col("doc_id")))))
    return quality.scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


@query("op8_preference_chat", sql.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference_chat.formatted(table(spark, sf_dir, "conversations"))
    for c in ("chosen_mask", "rejected_mask"):
        spans = F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
        out = out.withColumn(c, spans)
    return out


@query("op9_shards", sql.shards(sharding.SHARD_BYTES, sharding.HASH_BITS))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


@query("op10_warc", sql.OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = scratch(spark, "archives")
    files = warc.save_archives(warc.write_archives(pages, warc.dictionary(pages)), folder)
    if files.isEmpty():
        return warc.read_archives(files.select("path", F.lit(b"").alias("content"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    records = warc.read_archives(warc.open_archives(spark, folder))
    checked = records.withColumn("page_id", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "path", "error"))).otherwise(F.col("page_id")))
    return checked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_target_resampling", sql.resampling(resampling.BUCKETS, resampling.LEAST_WORDS, resampling.PERCENT, resampling.SEED))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out_of_toxic(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled(docs, labels.filter(~held_out_of_toxic(F.col("doc_id")))))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out_of_toxic(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES, digest=True).withColumnRenamed("groups", "groups_sha256")
