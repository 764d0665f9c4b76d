"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every linked node: root is the smallest node reachable, the node itself included.

    Each round hangs the larger neighbours of a node under its smallest neighbour, then the smaller ones; the table of links
    never grows beyond its first size plus one row per node. Rounds end when nothing changes and are checkpointed. Links of a
    node to itself and links with a null end say nothing and are left out; roots point at themselves.
    """
    a, b = F.col(left), F.col(right)
    first = links.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    nodes = None
    edges = durable(first.where("a <> b").distinct())
    before = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = durable(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = _mark(edges)
        if now == before:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            break
        before = now
    if nodes is None:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
