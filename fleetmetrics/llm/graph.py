"""Connected components of links between texts, as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node it reaches.

    Each round every node takes the smallest label of its neighbours and then the label of
    its label, so rounds follow the logarithm of a component's breadth. Labels are written
    out between rounds. A node with very many links is one join key with one row on the
    label side, which adaptive execution splits, and minima are combined before shuffles.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = staged(both.where("a <> b").distinct(), "pairs")
    labels = staged(
        pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels"
    )
    while True:
        near = pairs.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        jumped = spread.join(ahead, "label", "left").select("node", "old", F.least("label", "ahead").alias("label"))
        after = staged(jumped, "labels")
        if after.where("old <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
