"""Connected components of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): each node of ``links`` (a, b) with the smallest node it is connected to.

    A round takes the smallest label among neighbours and then the label's own label, so a
    chain of n nodes takes about log n rounds. Labels are written after each round, which cuts
    the lineage. A node with many links is a hot join key whose partitions Spark may split,
    and its smallest label is found by partial aggregation.
    """
    links = links.filter("a <> b AND a IS NOT NULL AND b IS NOT NULL")
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("next"))
        of = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        new = written(lower.join(of, "next").select("node", "was", F.least("next", "beyond").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("label <> was").isEmpty():
            return labels
