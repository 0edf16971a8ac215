"""Connected components of an edge table, without gathering links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diglot.storage import materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for each node of the edges a, b (longs).

    Each round gives every node the least root among its own and its neighbours', then replaces each
    root by its root's root (pointer jumping), so chains shrink by doubling. Minima are taken before
    the shuffle, so a node with very many links is no burden. Each round is a written table.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), "roots")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels.node == near.a, "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        parents = labels.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        jumped = materialise(stepped.join(parents, F.col("next") == F.col("up"), "left").select("node", F.least("next", F.coalesce("up_root", "next")).alias("root"), (F.col("root") != F.least("next", F.coalesce("up_root", "next"))).alias("moved")), "roots")
        labels = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components still change after {most_rounds} rounds")
