"""Registered queries, each next to the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contract.fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NOW = "2026-01-03T00:00:00+00:00"


class Views:
    """The fixture views of one scale factor: ``v.postings_fx``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.made)


def add(
    name: str,
    build: Callable[[Views], DataFrame],
    views: str = "",
    sql: str | None = None,
    ctes: list[tuple[str, str]] | None = None,
) -> None:
    """Register ``build``; ``sql`` reads ``views`` and the extra ``ctes``."""
    QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
    if sql is None:
        return
    parts = [with_views(*views.split())] if with_views(*views.split()) else []
    parts += [f"{n} AS (\n{s.strip()}\n)" for n, s in ctes or []]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    ORACLE[name] = head + sql.strip()
