"""Connected components of a graph of links as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label of
    that label, until nothing changes: about as many rounds as the logarithm of the longest
    path. Rounds are written to the shared folder; only a count of changes comes to the driver.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("of")).agg(F.min("label").alias("heard"))
        told = labels.join(heard, F.col("node") == F.col("of")).select(
            "node", "label", F.least("label", "heard").alias("low"))
        above = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        jumped = staged(told.join(above, F.col("low") == F.col("at")).select(
            "node", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("label")).alias("changed")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("changed").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
