"""Connected components of an edge table by least labels and pointer jumping.

Edges stay distributed: each round is two joins and a written table, so no
component, however large, meets in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, staged

#: Pointer jumping halves the depth of labels in a round, so 60 rounds serve more nodes than 64-bit identifiers can name.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of the edges (a, b)."""
    spark = edges.sparkSession
    with scratch(spark):
        both = staged(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
        labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
        for _ in range(MAX_ROUNDS):
            near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
            moved = staged(lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
            labels = moved.select("node", "label")
            if moved.filter("label <> old").isEmpty():
                return staged(labels, "components", result=True)
    raise RuntimeError("components did not settle")
