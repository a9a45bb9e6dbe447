"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import cut


#: Edges, about, that one partition of an iteration holds; small components are written as few files.
EDGES = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(links: DataFrame) -> DataFrame:
    """node, root of every node of the links (a, b): root is the smallest node of its component.

    Each step joins every node with the smallest of its neighbours; edges stay as many as there are nodes and links,
    and a component of any size is spread over tasks by node. Links of a node with itself and repeated ones don't
    matter. No links: no rows.
    """
    edges = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while True:
        # Large star: neighbours above a node get the smallest of its neighbourhood.
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        # Small star: a node and its neighbours below get the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(8 + state[0] // EDGES))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) after further links (a, b)."""
    tree = component.filter(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b"))
    return connected(tree.union(links.select("a", "b")))
