"""Connected components of an edge table, without gathering it anywhere.

Every node takes the smallest label among its neighbours, then the label of its
label (pointer jumping), until nothing changes: a number of rounds that grows
with the logarithm of the longest chain.  Labels are aggregated before each
shuffle, so the centre of a large star sends a row a task; joins are by node,
one side unique, and Spark splits hot nodes.  Each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) for the ends of ``edges`` (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        # Smallest label around every label's node: hooks whole trees, not single nodes.
        ends = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        hooks = ends.where("la <> lb").select(F.greatest("la", "lb").alias("root"), F.least("la", "lb").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        hooks = materialise(hooks, "hooks")
        if hooks.isEmpty():
            release(hooks)
            return labels
        hooked = labels.join(hooks, F.col("label") == F.col("root"), "left").select("node", F.coalesce("to", "label").alias("label"))
        jump = materialise(hooked, "labels")
        up = jump.select(F.col("node").alias("via"), F.col("label").alias("further"))
        before, labels = labels, materialise(jump.join(up, F.col("label") == F.col("via"), "left").select("node", F.coalesce(F.least("further", "label"), "label").alias("label")), "labels")
        release(before, hooks, jump)
