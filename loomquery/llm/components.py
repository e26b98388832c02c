"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm.shared import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(v, c) of all vertices of edges (a, b): c is the least vertex of v's component.

    Each round takes the least label of all neighbours (combined before the
    shuffle), then that label's own label. The labels live in checkpoints, so a
    lost executor repeats one round at most; the driver sees one count a round.
    """
    edges = checkpoint(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("v"), "c"))
    while True:
        told = edges.join(labels.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "c")
        least = checkpoint(told.unionAll(labels).groupBy("v").agg(F.min("c").alias("c")))
        jump = least.filter("v <> c").select(F.col("v").alias("c"), F.col("c").alias("up"))  # a root's label is itself
        new = checkpoint(least.join(jump, "c", "left").select("v", F.coalesce("up", "c").alias("c")))
        changed = new.join(labels.withColumnRenamed("c", "old"), "v").filter("c <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
