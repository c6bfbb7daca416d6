"""Connected components by hooking and pointer jumping, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jadwal.llm.common import written


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, label for every node of ``edges`` (a, b) and of ``labels``: the smallest node reachable.

    ``labels`` (node, label) are components known so far. Each round maps the edges to components, lets every
    component hook to its smallest neighbour, and shortens the hooks' chains; the components at
    least halve where edges are left. Nulls and loops are ignored.
    """
    edges = edges.where("a is not null and b is not null")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if labels is None:
        labels = nodes.withColumn("label", F.col("node"))
    else:
        labels = labels.unionByName(nodes.join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    labels, left = written(labels, "labels"), edges
    while True:
        near = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        far = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        left = written(left.join(near, "a").join(far, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels
        both = left.union(left.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")).where("y < x")
        hook = written(hook, "hooks")
        while True:  # to the end of each chain: a label must not hook itself
            nxt = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
            jumped = hook.join(nxt, "y", "left")
            if jumped.where("z is not null").isEmpty():
                break
            hook = written(jumped.select("x", F.coalesce("z", "y").alias("y")), "hooks")
        labels = written(labels.join(hook, labels["label"] == hook["x"], "left").select("node", F.coalesce("y", "label").alias("label")), "labels")
