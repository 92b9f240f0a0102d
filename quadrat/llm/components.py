"""Connected components of links as tables: smallest label by neighbour, then labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, label (the smallest node that it reaches) of every node that has a link.

    A round costs three shuffles of the linked nodes and halves paths; each round is stored, so that no
    plan grows and a lost executor costs one round at most. Nothing is gathered per component.
    """
    links = links.filter("a <> b").select("a", "b")
    both = stored(links.union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("_n")).agg(F.min("label").alias("_l"))
        low = labels.join(near, labels["node"] == near["_n"], "left").select("node", F.col("label").alias("old"), F.least("label", "_l").alias("label"))
        # one jump: the label of the label
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        after = stored(low.join(jump, low["label"] == jump["_n"], "left").select("node", "old", F.least("label", "_l").alias("label")), "labels")
        if after.filter("label <> old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
