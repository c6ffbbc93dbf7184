"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.work import discard, saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` reaches.

    Each round a node takes the smallest label around it and then that label's own label, and
    the labels are written; the number of rounds grows with the logarithm of the longest path
    for paths in order of their labels. No links give an empty table.
    """
    one = links.select(F.col(a).alias("at"), F.col(b).alias("to")).where("at is not null and to is not null")
    edges = saved(one.union(one.select("to", "at")).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("at").alias("node")).agg(F.least("node", F.min("to")).alias("label")), "labels")
    while True:
        around = edges.join(labels, edges["to"] == labels["node"]).groupBy("at").agg(F.min("label").alias("least"))
        lower = labels.join(around, labels["node"] == around["at"]).select("node", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        step = saved(lower, "labels")
        up = step.select(F.col("node").alias("root"), F.col("label").alias("above"))
        jumped = saved(step.join(up, step["label"] == up["root"]).select("node", F.col("above").alias("label"), "was"), "labels")
        changed = jumped.where("label <> was").limit(1).count()
        discard(labels, step)
        labels = jumped
        if not changed:
            discard(edges)
            return labels.select("node", "label")
