"""Connected components of a link table, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b).

    Each round takes the smallest label among a node's neighbours (pre-aggregated before
    the shuffle) and then the label of that label, so distances halve. Labels are written
    each round. Nodes without links don't appear. Raises if ``rounds`` don't suffice.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = written(both.where("node != other").distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("node").alias("other"), "component"), "other").select("node", "component")
        least = heard.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        hop = least.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = least.join(hop, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        old = labels.select("node", F.col("component").alias("old"))
        new = written(jumped.join(old, "node"), "labels")
        labels = new.select("node", "component")
        if new.where("component != old").isEmpty():
            return labels
    raise RuntimeError(f"components have not settled in {rounds} rounds")
