"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch.session import stage


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (node, root) to the end of each chain; every round halves the chains."""
    while True:
        up = parents.select(F.col("node").alias("via"), F.col("root").alias("above"))
        joined = parents.join(up, parents["root"] == up["via"], "left")
        nxt = stage(joined.select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        parents = nxt.select("node", "root")
        if nxt.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that can be reached.

    Each round hooks every node that has a smaller neighbour to the smallest one, follows the hooks to their roots,
    and keeps the edges between different roots. A round at least halves the nodes that still have edges. All state is
    in staged tables; only whether rows are left reaches the driver. Nulls and loops in the edges are ignored; without
    edges the result is empty.
    """
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        hooks = _roots(stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooks"))
        if labels is None:
            labels = hooks.unionByName(edges.select(F.col("b").alias("node")).distinct().join(hooks, "node", "left_anti").withColumn("root", F.col("node")))
        else:
            up = hooks.select(F.col("node").alias("via"), F.col("root").alias("above"))
            labels = labels.join(up, labels["root"] == up["via"], "left").select("node", F.coalesce("above", "root").alias("root"))
        labels = stage(labels, "labels")
        one = hooks.select(F.col("node").alias("a"), F.col("root").alias("a_root"))
        two = hooks.select(F.col("node").alias("b"), F.col("root").alias("b_root"))
        moved = edges.join(one, "a").join(two, "b", "left").select(F.col("a_root").alias("a"), F.coalesce("b_root", "b").alias("b"))
        edges = stage(moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
