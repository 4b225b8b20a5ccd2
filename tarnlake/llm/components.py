"""Connected components of a link table, by contraction in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.session import keep


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b): equal roots exactly within a component.

    Each round every node takes the smallest of itself and its neighbours as parent; parents are
    followed to the end by doubling; links between different trees are links of the next round, whose
    nodes are the roots. The nodes that are no root at least halve each time. All steps are joins and
    aggregates over two columns, written to the shared folder.
    """
    edges = keep(links.select("a", "b").filter("a <> b").distinct(), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("b"))
        parents = keep(parents.select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        while True:
            above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = keep(
                parents.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")),
                "parents",
            )
            parents = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        labels = labels.join(parents.withColumnsRenamed({"node": "root", "up": "to"}), "root", "left")
        labels = keep(labels.select("node", F.coalesce("to", "root").alias("root")), "labels")
        for end in ("a", "b"):
            edges = edges.join(parents.withColumnsRenamed({"node": end, "up": "to"}), end, "left")
            edges = edges.withColumn(end, F.coalesce("to", end)).drop("to")
        edges = keep(edges.select("a", "b").filter("a <> b").distinct(), "links")
    return labels
