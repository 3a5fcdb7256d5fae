"""Connected components of a graph given as pairs, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runlens.llm.common import table


def components(edges: DataFrame) -> DataFrame:
    """``x``, ``y`` to ``node``, ``label``: the smallest node reachable. Nodes without a pair are left out.

    Each round takes the smallest label among a node's own and its neighbours', then follows labels once,
    so chains are walked in steps that double. All of it stays in tables; only a count of
    changes comes to the driver. Runs jobs.
    """
    both = table(
        edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(),
        "edges",
    )
    if both.isEmpty():
        return both.select(F.col("x").alias("node"), F.col("y").alias("label"))
    labels = table(both.groupBy("x").agg(F.least("x", F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        taken = labels.join(near.withColumnRenamed("x", "node"), "node").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("next")
        )
        taken = table(taken, "taken")
        ahead = taken.select(F.col("node").alias("next"), F.col("next").alias("ahead"))
        jumped = taken.join(ahead, "next").select("node", "was", F.least("next", "ahead").alias("label"))
        jumped = table(jumped, "labels")
        if jumped.where("label <> was").limit(1).count() == 0:
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
