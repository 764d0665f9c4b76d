"""What given nodes reach in a graph: one operator for hierarchies, call trees, call chains and dependency context."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.durable import durable

#: Edges of one node that stay together; the edges of a node with more are dealt to several tasks.
FAN = 10_000


def parted_edges(edges: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(edges with `part`, (project, node, parts) of the hot nodes). A node with more than `fan` edges has one part for each `fan` of them."""
    e = durable(edges.select("project", "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    hot = durable(e.groupBy("project", "src").agg(F.count("*").alias("_n")).where(F.col("_n") > fan).select(
        "project", F.col("src").alias("node"), F.ceil(F.col("_n") / fan).cast("int").alias("parts")))
    if not hot.take(1):
        return e.withColumn("part", F.lit(0)), hot
    found = e.join(hot.withColumnRenamed("node", "src"), ["project", "src"], "left")
    part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    return durable(found.select("project", "src", "dst", part.alias("part"))), hot


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, fan: int = FAN) -> DataFrame:
    """(project, seed, node, depth): every node a seed reaches, at its least depth; depth 0 is where the seed starts.

    edges(project, src, dst), seeds(project, seed, node); nodes may be structs. Only what the seeds reach is worked out, never the closure of
    the graph. Each round follows the edges of the nodes that were new in the last one and leaves out what a seed knows already, so
    cycles end; rounds are checkpointed and stop when nothing is new, or at `max_depth`. A seed meets a hot node's edges part by
    part, in as many tasks. Null nodes and edges of a node to itself say nothing; repeated seeds and edges count once; empty
    tables give what the seeds are.
    """
    links, hot = parted_edges(edges, fan)
    links = links.withColumnRenamed("src", "node")
    known = front = durable(seeds.select("project", "seed", "node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        aimed = front.join(hot, ["project", "node"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        step = aimed.join(links, ["project", "node", "part"]).select("project", "seed", F.col("dst").alias("node")).distinct()
        front = durable(step.join(known.select("project", "seed", "node"), ["project", "seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not front.take(1):
            break
        known = known.unionByName(front)
    return known
