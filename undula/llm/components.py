"""Connected components of a link table, by distributed contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.shared import checkpointed, settled


def _roots(parents: DataFrame, max_rounds: int) -> DataFrame:
    """(node, parent) with every node under the root of its tree; parents: (node, parent), each parent smaller or the node itself."""
    for _ in range(max_rounds):
        above = parents.where("node <> parent").select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        new = checkpointed(parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        parents = new.drop("moved")
        if not moved:
            return parents
    raise RuntimeError(f"trees are still deep after {max_rounds} rounds")


@settled
def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node reachable.

    In a round every node hangs itself below its smallest neighbour, if that is smaller,
    and the trees so made become one node each, named by their roots. Links within a tree
    go, so each round joins fewer of them. Minima are taken on the map side, and what a
    round leaves is written to the checkpoint folder. Null ends and self links are
    dropped; no links give no rows.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    links, found = checkpointed(links.distinct()), None
    for _ in range(max_rounds):
        ends = links.select(F.col("b").alias("node"), F.col("a").alias("near")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("near")))
        trees = _roots(checkpointed(ends.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("parent"))), max_rounds)
        if found is None:
            found = trees.withColumnRenamed("parent", "component")
        else:
            found = checkpointed(found.join(trees.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        moved = trees.where("node <> parent")
        up = lambda df, c: df.join(moved.select(F.col("node").alias(c), "parent"), c, "left").withColumn(c, F.coalesce("parent", c)).drop("parent")
        left = up(up(links, "b"), "a").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = checkpointed(left.distinct())
        if not links.limit(1).count():
            return found
    raise RuntimeError(f"links are left after {max_rounds} rounds")
