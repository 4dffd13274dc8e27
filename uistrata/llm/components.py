"""Connected components of a distributed edge list: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for each end of an edge (a, b) the smallest id that it reaches.

    Each round takes the least label among neighbours (a partial aggregate, so a
    hub costs one row per task) and then the label of that label, so a path of
    length n needs about log n rounds.  Rounds are stored in the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = common.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        step = common.stored(step, "step")
        up = step.select(F.col("v").alias("label"), F.col("label").alias("above"))
        after = common.stored(step.join(up, "label").select("v", "was", F.least("label", "above").alias("label")), "labels")
        moved = after.where("label <> was").limit(1).count()
        common.discard(labels, step)
        path, labels = after._stored_path, after.select("v", "label")
        labels._stored_path = path
        if not moved:
            return labels
