"""Connected components of a table of links, in rounds of joins; nothing is gathered on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash, stashes


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): for each node of a link the smallest node reachable. Null ends are ignored.

    Each round takes the smallest label of the neighbours, then the label of that label, so that long chains halve. Labels
    are written to shared files each round, and those of the round before removed. Minima combine on the map side, and hot
    nodes only widen joins that adaptive execution can split.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = stash(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    labels = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label"))
    labels = stash(labels, "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = stash(hooked.join(upper, "label").select("node", F.least("label", "above").alias("label"), "old"), "cc-labels")
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", F.col("label").alias("component"))
        discard(jumped.sparkSession, stashes() - 2, keep=1)  # the labels that this round read
        labels = jumped.select("node", "label")
