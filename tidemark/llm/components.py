"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, label): the smallest node it can reach. Each round takes the
    smallest label among the neighbours, then the label's label; every round is written to
    the shared folder, and only the number of changed labels comes to the driver."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("near"))
        further = labels.select(F.col("node").alias("near"), F.col("label").alias("jump"))
        after = written(nearer.join(further, "near").select("node", F.least("near", "jump").alias("label"), (F.least("near", "jump") < F.col("label")).alias("changed")), "labels")
        labels = after.select("node", "label")
        if after.filter("changed").isEmpty():
            return labels
