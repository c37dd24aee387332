"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node of ``edges`` (a, b).

    Each round takes the least label among a node's neighbours and then that label's own label, so
    long chains shorten by about half a round.  Rounds are stored, so none depends on an executor.
    """
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = hooked.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        new = stored(jumped.select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = new.drop("old")
        if new.where("old <> label").isEmpty():
            return labels
