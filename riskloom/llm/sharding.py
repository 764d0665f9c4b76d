"""Sharding by longest-processing-time scheduling: groups that must stay together go, by falling size, to the least-loaded shard.

The heap sees a bounded list however large the table is: groups of at least 1 / (shards x `grain`) of all bytes stand for
themselves (there can be no more than shards x grain of them), the smaller ones are bundled by the hash of their key into
shards x grain bundles of hashed width, whose sums Spark adds up. On small tables nearly every group stands for itself.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.durable import durable

GRAIN = 1_024


def least_loaded(items: list[tuple], shards: int) -> dict:
    """item -> shard for (item, size) pairs: by falling size, ties by item, each to the least-loaded shard, ties to the lowest."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", grain: int = GRAIN, rows_per_slice: int = 20_000) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes of the text, null: none, plus 8), text_crc32, shard, slot (gapless from 0).

    Equal texts form a group and share a shard; null texts are one group, empty texts another. The group key is a 64-bit hash: a
    collision would only keep two groups together. Repeated rows each get a slot. An empty table gives no rows. Columns beside
    id and text are not read. Slots follow a hashed slice of the id, then the id, so no task sorts a whole shard.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = durable(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                               F.xxhash64(F.col(text_col).isNull(), text).alias("g")))
    groups = durable(rows.groupBy("g").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    total, count = groups.agg(F.sum("size"), F.sum("n")).first()
    total, count, bundles = total or 0, count or 0, shards * grain
    limit = total / bundles
    bundle = F.pmod(F.xxhash64(F.lit("bundle"), "g"), F.lit(bundles)).cast("long")
    large = groups.where(F.col("size") >= limit).select(F.col("g").alias("item"), "size").collect()  # at most shards x grain rows
    small = groups.where(F.col("size") < limit).groupBy(bundle.alias("item")).agg(F.sum("size").alias("size")).collect()  # the same bound
    placed = least_loaded([(("g", r["item"]), r["size"]) for r in large] + [(("b", r["item"]), r["size"]) for r in small], shards)
    of_group = spark.createDataFrame([(k[1], s) for k, s in placed.items() if k[0] == "g"], "g long, of_group int")
    of_bundle = spark.createDataFrame([(k[1], s) for k, s in placed.items() if k[0] == "b"], "bundle long, of_bundle int")
    slices = max(1, count // (shards * rows_per_slice))
    put = (rows.withColumn("bundle", bundle).join(F.broadcast(of_group), "g", "left").join(F.broadcast(of_bundle), "bundle", "left")
           .select("id", "size", "text_crc32", F.coalesce("of_group", "of_bundle").alias("shard"), F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(slices)).alias("slice")))
    sums = put.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = sums.select("shard", "slice", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("id", "text_crc32", "size")) - 1
    return (put.withColumn("place", place).join(before, ["shard", "slice"])
            .select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot")))
