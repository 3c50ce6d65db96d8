"""Connected components of a graph that only exists as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import stored


def _parents(links: DataFrame) -> DataFrame:
    """Every node that has a smaller neighbour, with the smallest node it was linked to."""
    return links.groupBy("node").agg(F.min("to").alias("least"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node that can be reached.

    Large-star and small-star rounds: neighbours are hung below the smallest of a neighbourhood until all
    trees are stars. A round is two joins on the node, whose hot keys Spark splits; its result is stored, so
    that lineage stays short. The number of rounds grows with the logarithm of the longest chain. NULL ends
    and links of a node to itself are left out; repeated links count once; no links give no rows.
    """
    x, y = F.col(a), F.col(b)
    tree = stored(
        links.where(x != y).select(F.greatest(x, y).alias("node"), F.least(x, y).alias("to")).distinct(), "links"
    )
    seen = None
    while True:
        both = tree.union(tree.select("to", "node"))
        near = both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("least"))
        large = (
            both.join(near, "node").where(F.col("to") > F.col("node")).select(F.col("to").alias("node"), F.col("least").alias("to"))
        ).distinct()
        large = stored(large, "large-star")
        hung = large.join(_parents(large), "node")
        small = hung.select("node", F.col("least").alias("to")).union(
            hung.where(F.col("to") != F.col("least")).select(F.col("to").alias("node"), F.col("least").alias("to"))
        )
        tree = stored(small.distinct(), "small-star")
        now = tree.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = tree.select("node", F.col("to").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
