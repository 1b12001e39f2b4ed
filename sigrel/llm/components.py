"""Connected components of an edge table by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs -> (id, component), component being the smallest id that links reach.

    Each round takes the least label among a node's neighbours, then the label of its label, so the number of
    rounds grows with the logarithm of the longest path. Labels are checkpointed each round. Hubs with very many
    edges are pre-aggregated by the groupings and split by adaptive skew joins. An empty table gives an empty one.
    """
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    # both directions from one row: a union would plan the edges twice
    both = edges.where("a is not null and b is not null and a <> b").select(F.explode(F.array(there, back)).alias("e"))
    both = cut(both.select("e.a", "e.b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        jumped = cut(low.join(up, "component", "left").select("id", "was", F.least("component", "up").alias("component")))
        changed = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels
