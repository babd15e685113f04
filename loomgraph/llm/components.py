"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): label is the smallest node of the component.

    Each round takes the smallest label among neighbours, then the label of the
    label, so long chains halve. A round is written to the shared folder.
    """
    both = stage(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), "label")
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = low.join(up, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("label")).alias("changed"))
        new = stage(new, "labels")
        drop_stage(labels)
        changed = new.where("changed").limit(1).count()
        path = new._loom_path
        labels = new.select("node", "label")
        labels._loom_path = path
        if not changed:
            drop_stage(both)
            return labels
