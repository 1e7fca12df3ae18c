"""Connected components of a graph whose edges lie in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.functions.lineage import save


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """node, root: for each node of ``edges`` (a, b: bigint) the smallest node it is linked to, over any number of links.

    Each round points every node to its smallest neighbour or itself, follows the pointers to their ends by doubling, and contracts
    the graph to these ends. All nodes but local minima vanish in a round, so rounds are few; each is a handful of joins, whose large
    partitions can be split, and of aggregations that are combined map-side. Loops and repeated edges do no harm.
    """
    edges = save(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:
            # ends point to themselves; only nodes whose pointer's pointer goes further change
            further = to.where("node != root").select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = save(to.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            to = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            roots = to
        else:
            roots = save(roots.join(to.select(F.col("node").alias("root"), F.col("root").alias("r2")), "root", "left").select("node", F.coalesce("r2", "root").alias("root")))
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        linked = edges.join(a, "a").join(b, "b").where("ra != rb")
        edges = save(linked.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
