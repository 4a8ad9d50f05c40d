"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tables import checkpointed

#: A table of so many nodes may be broadcast (about 20 MB); more are joined by a shuffle.
BROADCAST_NODES = 200_000


def held(table: DataFrame, n: int) -> DataFrame:
    """A table of n nodes at most, for a join."""
    return F.broadcast(table) if n <= BROADCAST_NODES else table


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that link two nodes; root is the least node of its component."""
    return grouped(links)[0]


def grouped(links: DataFrame) -> tuple[DataFrame, int]:
    """``components``, and the number of their nodes.

    Each round links every neighbour of a node to the least one; rounds repeat until all components are stars, about
    the logarithm of the longest path. A node's neighbours meet only in a minimum and a join on the node, which
    can be split; rounds never make more links than there were.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"))
    while True:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        near = checkpointed(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")))
        # In stars a node with a smaller neighbour has no other one.
        n, more = near.agg(F.count("*"), F.count_if((F.col("low") < F.col("a")) & (F.col("low") < F.col("high")))).first()
        least = near.select("a", F.least("a", "low").alias("m"))
        if not more:
            return least.select(F.col("a").alias("node"), F.col("m").alias("root")), n
        large = both.join(held(least, n), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = checkpointed(large.join(held(least, n), "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")))


def merged(roots: DataFrame, n: int, links: DataFrame) -> tuple[DataFrame, int]:
    """The components of n nodes at most (``grouped``) after further links: only their roots are linked anew."""
    known = held(roots, n)
    of = lambda side: known.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    rooted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    more, m = grouped(rooted.filter("a <> b").distinct())
    if not m:
        return roots, n
    moved = roots.join(held(more.select(F.col("node").alias("root"), F.col("root").alias("least")), m), "root", "left")
    alone = more.join(known.select("node"), "node", "left_anti")
    return checkpointed(moved.select("node", F.coalesce("least", "root").alias("root")).unionByName(alone)), n + m
