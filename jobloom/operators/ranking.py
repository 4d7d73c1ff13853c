"""Positions over a whole table without one task seeing the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.session import written

# The low bits of monotonically_increasing_id, which count a partition's rows.
IN_PARTITION = (1 << 33) - 1


def global_row_number(
    df: DataFrame, order: str | Sequence[str | Column], out: str
) -> DataFrame:
    """Dense position 1..n by ``order``, columns (or ``col.desc()``) that together are unique.

    Rows are dealt by range and sorted within partitions, and stored with their place, so
    that both uses below see the same ranges. A position is that place plus the rows of the
    partitions before; only one row per partition meets in the window.
    """
    order = [order] if isinstance(order, str) else list(order)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skip = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    position = F.col("_skip") + F.col("_id").bitwiseAND(IN_PARTITION) + 1
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(skip), "_part")  # one row per shuffle partition
        .withColumn(out, position.cast("bigint"))
        .drop("_part", "_skip", "_id")
    )
