"""Trees of file hashes: what changed between two snapshots, by descent from the roots of projects to buckets to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.durable import durable
from riskloom.sources.history import file_hash

#: Hex digits of the hash of a path that name a bucket, level by level: the project, 256 buckets, 65,536 buckets.
LEVELS = (0, 2, 4)
_LANES = 4


def tree_entries(files: DataFrame) -> DataFrame:
    """(project, path, hash, bucket) of files(project, path, content); a null content has a null hash. Repeated rows count once."""
    return files.select("project", "path", file_hash(F.col("content")).alias("hash"), F.left(F.md5("path"), F.lit(LEVELS[-1])).alias("bucket")).distinct()


def hash_tree(entries: DataFrame) -> DataFrame:
    """(project, level, bucket, files, digest): one row per project (level 0) and per bucket of its paths.

    A bucket's digest comes from sums over the digests of its entries, four lanes of 60 bits and their number, so it needs no order,
    is combined on the map side, and no value ever holds the entries of a project; a level is summed from the level below it.
    """
    sha = F.sha2(F.concat_ws(":", "path", F.coalesce("hash", F.lit("-"))), 256)
    lanes = [F.conv(F.substring("_d", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)").alias(f"_l{i}") for i in range(_LANES)]
    at = entries.withColumn("_d", sha).select("project", "bucket", F.lit(1).cast("long").alias("files"), *lanes)
    out, kept = None, ["files"] + [f"_l{i}" for i in range(_LANES)]
    for level in reversed(LEVELS):
        at = at.groupBy("project", F.left("bucket", F.lit(level)).alias("bucket")).agg(*[F.sum(c).cast("decimal(38,0)" if c != "files" else "long").alias(c) for c in kept])
        digest = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in kept]), 256)
        rows = at.select("project", F.lit(level).alias("level"), "bucket", "files", digest.alias("digest"))
        out = rows if out is None else out.unionByName(rows)
    return out


def save_tree(entries: DataFrame, folder: str) -> None:
    """Writes a snapshot: its tree by level, so that a comparison reads the roots alone first, and its entries by their first bucket."""
    e = durable(entries)
    hash_tree(e).write.mode("overwrite").partitionBy("level").parquet(f"{folder}/tree")
    e.withColumn("top", F.left("bucket", F.lit(LEVELS[1]))).repartition("top").write.mode("overwrite").partitionBy("top").parquet(f"{folder}/entries")


def load_tree(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(tree, entries) of a snapshot."""
    return spark.read.parquet(f"{folder}/tree"), spark.read.parquet(f"{folder}/entries")


def differing_buckets(now: DataFrame, last: DataFrame) -> list[DataFrame]:
    """Per level the (project, bucket) whose digests differ, also where one side has none. Each level looks only into what differs above it:
    an unchanged project is one row compared, whatever its size."""
    found: list[DataFrame] = []
    for i, level in enumerate(LEVELS):
        sides = []
        for tree, name in ((now, "a"), (last, "b")):
            side = tree.where(F.col("level") == level).select("project", "bucket", F.col("digest").alias(name))
            if found:
                above = found[-1].withColumnRenamed("bucket", "_up")
                side = side.withColumn("_up", F.left("bucket", F.lit(LEVELS[i - 1]))).join(above, ["project", "_up"], "left_semi").drop("_up")
            sides.append(side)
        found.append(durable(sides[0].join(sides[1], ["project", "bucket"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("project", "bucket")))
    return found


def changes(now: tuple[DataFrame, DataFrame], last: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(project, path, change, hash) between two snapshots (tree, entries): `added`, `changed` or `removed` (hash: the former one).

    Entries are compared in differing buckets only. Empty snapshots are allowed on either side.
    """
    buckets = differing_buckets(now[0], last[0])[-1]
    a, b = (e.join(buckets, ["project", "bucket"], "left_semi").select("project", "path", "hash", F.lit(True).alias("is")) for e in (now[1], last[1]))
    both = a.join(b.withColumnsRenamed({"hash": "was_hash", "is": "was"}), ["project", "path"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("hash").eqNullSafe(F.col("was_hash")), "changed")
    rows = both.select("project", "path", change.alias("change"), F.when(F.col("is").isNull(), F.col("was_hash")).otherwise(F.col("hash")).alias("hash"))
    return rows.where("change IS NOT NULL")
