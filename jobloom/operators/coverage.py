"""How much of what the harvest surfaces is in the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.keys import key_label
from jobloom.operators.boards import systems
from jobloom.session import written


def entry_counts(boards: DataFrame) -> DataFrame:
    """Rows and distinct keys per system.

    Two aggregates, by key and then by system: the distinct keys of one system
    are counted by many tasks.
    """
    per_key = boards.groupBy("ats", "board_key").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_key.groupBy("ats").agg(
        F.sum("_n").alias("entries"), F.count(F.lit(1)).alias("unique_keys")
    )
    listed = systems(boards.sparkSession).join(counts, "ats", "left")
    return listed.na.fill(0, ["entries", "unique_keys"])


def funnel_keys(surfaced: DataFrame, registry: DataFrame) -> DataFrame:
    """Every distinct key of either side with ``surfaced`` and ``validated``."""
    keys = ["ats", "board_key"]
    found = surfaced.select(*keys, "tenant", "wd", "site").dropDuplicates(keys)
    found = found.withColumn("surfaced", F.lit(True))
    known = registry.select(*keys).distinct().withColumn("validated", F.lit(True))
    return found.join(known, keys, "full_outer").na.fill(False, ["surfaced", "validated"])


def registered(surfaced: DataFrame, registry: DataFrame) -> DataFrame:
    """Keys on both sides. Repeats go first: Spark would join before it drops them."""
    keys = ["ats", "board_key"]
    return surfaced.select(*keys).distinct().intersect(registry.select(*keys).distinct())


def unregistered(surfaced: DataFrame, registry: DataFrame) -> DataFrame:
    """Surfaced keys the registry lacks."""
    keys = ["ats", "board_key"]
    return surfaced.select(*keys).distinct().subtract(registry.select(*keys).distinct())


def funnel(marked: DataFrame) -> DataFrame:
    """Per system: surfaced, validated, missing and the percentage validated."""
    both = F.col("surfaced") & F.col("validated")
    counts = marked.groupBy("ats").agg(
        F.count_if("surfaced").alias("surfaced"),
        F.count_if(both).alias("validated"),
        F.count_if(F.col("surfaced") & ~F.col("validated")).alias("missing"),
    )
    listed = systems(marked.sparkSession).join(counts, "ats", "left")
    listed = listed.na.fill(0, ["surfaced", "validated", "missing"])
    pct = F.when(
        F.col("surfaced") > 0, F.bround(100 * F.col("validated") / F.col("surfaced"), 1)
    ).otherwise(0.0)
    return listed.withColumn("pct", pct)


def missing_boards(marked: DataFrame) -> DataFrame:
    """(ats, board): every missing board, by its printed key."""
    label = key_label(*[F.col(c) for c in ("ats", "tenant", "wd", "site", "board_key")])
    missing = F.col("surfaced") & ~F.col("validated")
    return marked.where(missing).select("ats", label.alias("board"))


def missing_sample(marked: DataFrame, size: int) -> DataFrame:
    """The first ``size`` missing boards of each system.

    Spark cuts each map task to ``size`` rows per system before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy("ats").orderBy("board"))
    return missing_boards(marked).withColumn("place", place).where(F.col("place") <= size)


def report(
    surfaced: DataFrame,
    registry: DataFrame,
    sample_size: int,
    keep: Callable[[DataFrame, str], DataFrame] = written,
) -> DataFrame:
    """Registry size, funnel and ``sample_size`` missing boards, one row per system.

    The marked keys are stored, so that the harvest is not read once per part.
    """
    marked = keep(funnel_keys(surfaced, registry), "funnel")
    sample = missing_sample(marked, sample_size).groupBy("ats").agg(
        F.array_sort(F.collect_list(F.struct("place", "board"))).alias("_s")
    )
    rows = entry_counts(registry).join(funnel(marked), "ats").join(sample, "ats", "left")
    return rows.withColumn(
        "missing_boards", F.coalesce(F.array_join(F.col("_s.board"), "; "), F.lit(""))
    ).drop("_s")
