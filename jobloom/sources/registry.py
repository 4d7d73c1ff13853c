"""The board registry: which boards are read, per applicant-tracking system."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.keys import board_key
from jobloom.operators.boards import ATS
from jobloom.schemas import BOARD, BOARD_COLS

# The field of a registry entry that holds its slug.
SLUG_FIELDS = {
    "greenhouse": "token",
    "lever": "slug",
    "ashby": "slug",
    "smartrecruiters": "company",
    "workable": "slug",
}


def with_board_key(boards: DataFrame) -> DataFrame:
    key = board_key(*[F.col(c) for c in ("ats", "tenant", "wd", "site", "slug")])
    return boards.withColumn("board_key", key).select(*BOARD_COLS)


def read_yaml(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """Registry files by system; a missing or empty file adds no boards.

    The files are small, hand-kept configuration. Large registries live in a
    table with the same columns.
    """
    import yaml

    rows = []
    for ats, path in files.items():
        if not os.path.exists(path):
            continue
        with open(path, encoding="utf-8") as handle:
            companies = (yaml.safe_load(handle) or {}).get("companies") or []
        for place, entry in enumerate(companies):
            slug = str(entry[SLUG_FIELDS[ats]]) if ats in SLUG_FIELDS else None
            parts = [entry.get(c) for c in ("tenant", "wd", "site")]
            rows.append((ats, None, *parts, slug, entry.get("name"), place))
    return with_board_key(spark.createDataFrame(rows, BOARD))


def of_systems(boards: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Rows of the systems named; an unknown name is an error."""
    names = {w.strip().lower() for w in wanted if w.strip()}
    unknown = sorted(names - set(ATS))
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}; known: {', '.join(ATS)}")
    return boards.where(F.col("ats").isin(*sorted(names))) if names else boards
