"""Connected components of a link table, by label propagation with pointer jumping.

Labels start as the smaller end of each link and only ever fall, so every node ends with the smallest id
it can reach. Each round is a grouped minimum and three joins, written to the shared folder; nothing is
collected but the number of labels that changed. The number of rounds follows the logarithm of the
longest path. Links may repeat or point either way; an empty link table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: for each node of a link, the smallest node reachable."""
    ends = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))
    both = cut(links.where(F.col(a) != F.col(b)).select(F.explode(ends).alias("e")).select("e.x", "e.y").distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", "label", F.least("label", "near").alias("low"))
        # the label's own label: chains halve; both sides are dealt for this join alone, so a label that many
        # nodes share is a skewed join that Spark splits
        up = low.select(F.col("node").alias("low"), F.col("low").alias("up"))
        moved = cut(low.join(up, "low", "left").select("node", "label", F.least("low", F.coalesce("up", "low")).alias("low")))
        changed = moved.where("low < label").limit(1).count()
        labels = moved.select("node", F.col("low").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
