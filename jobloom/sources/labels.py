"""Labels of titles, kept by the title's hash and the scorer's version.

A model may need hours for the titles of a run; nearly all of them were in the run before. Only
titles that the store has no label for under the version are scored. A title that the model failed
on has no label and is tried again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators.scoring import Scorer, score_titles

LABEL = "title_hash BINARY, label STRING, run STRING, attempt STRING"


def title_hash(title: Column) -> Column:
    """128 bits that stand for a title; NULL for none."""
    return F.unhex(F.md5(title))


class LabelStore:
    """Labels below ``root``, one folder per scorer version; a new model takes a new version."""

    def __init__(self, spark: SparkSession, root: str, version: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/version={version}"

    def read(self) -> DataFrame:
        """(title_hash, label, run): one row per title, of attempts that were finished."""
        try:
            done = self.spark.read.schema("attempt STRING").parquet(f"{self.root}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LABEL).drop("attempt")
        rows = self.spark.read.schema(LABEL).parquet(f"{self.root}/labels").join(done.distinct(), "attempt", "left_semi")
        # two runs at the same time may both have scored a title; short texts of a fixed list
        return rows.groupBy("title_hash").agg(F.min(F.struct("run", "label")).alias("_l")).select("title_hash", "_l.label", "_l.run")

    def labelled(self, titles: DataFrame, factory: Callable[[], Scorer], run: str, tasks: int | None = None) -> DataFrame:
        """(title, label) of ``titles``; those the store lacks are scored and added as of ``run``."""
        hashed = titles.select("title").distinct().withColumn("title_hash", title_hash(F.col("title")))
        unseen = hashed.join(self.read().select("title_hash"), "title_hash", "left_anti")
        attempt = uuid.uuid4().hex
        scored = score_titles(unseen.select("title"), factory, tasks).where(F.col("label").isNotNull())
        rows = scored.select(title_hash(F.col("title")).alias("title_hash"), "label", F.lit(run).alias("run"), F.lit(attempt).alias("attempt"))
        rows.write.mode("append").parquet(f"{self.root}/labels")
        self.spark.createDataFrame([(attempt,)], "attempt STRING").coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return hashed.join(self.read().select("title_hash", "label"), "title_hash", "left").select("title", "label")
