"""Connected components of a large graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.llm.common import stored


def _roots(parents: DataFrame) -> DataFrame:
    """node, parent -> node, root: every step doubles the distance covered."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = stored(parents.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")), "jumps")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of numbers to (node, root) for each node with an edge; root is the smallest node reachable.

    Every round hooks each node to its smallest neighbour below it, follows the hooks to
    their ends and replaces edges by edges between these. At least half of the
    remaining nodes that have edges disappear per round. Nothing is collected; hubs are combined
    before each shuffle. Loops and repeated edges are harmless, an empty table gives no rows.
    """
    def lean(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    label = stored(nodes.withColumn("root", F.col("node")), "labels")
    left = stored(lean(edges), "edges")
    while not left.isEmpty():
        hooks = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        roots = _roots(stored(hooks, "hooks"))
        over = roots.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        label = stored(label.join(over, "root", "left").select("node", F.coalesce("_top", "root").alias("root")), "labels")
        for end in ("a", "b"):
            to = roots.select(F.col("node").alias(end), F.col("root").alias("_top"))
            other = "b" if end == "a" else "a"
            left = left.join(to, end, "left").select(F.coalesce("_top", end).alias(end), other)
        left = stored(lean(left), "edges")
    return label
