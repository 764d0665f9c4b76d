"""Runs over time: history, checkpoints, resume, and skipping what did not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.ranking import first_per, top_n

HISTORY_RUNS, HISTORY_PATTERNS = 8, 12


def append_run_history(history: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """runs(created_at, ..., learned array<string>) with the new ones; the last eight are kept, per key if given."""
    return top_n(history.unionByName(new), HISTORY_RUNS, [F.col("created_at").desc(), *[F.col(c) for c in ("run_id",) if c in new.columns]], by=keys)


def learned_patterns(history: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The twelve most recent distinct patterns."""
    keys = keys or []
    rows = history.select(*keys, "created_at", F.posexplode("learned").alias("pos", "pattern")).where(F.coalesce("pattern", F.lit("")) != "")
    order = [-F.unix_micros(F.col("created_at").cast("timestamp")), "pos"]
    latest = first_per(rows, [*keys, "pattern"], order)
    return top_n(latest, HISTORY_PATTERNS, [F.col("created_at").desc(), "pos", "pattern"], by=keys or None).select(*keys, "pattern")


def latest_checkpoint(checkpoints: DataFrame, keys: list[str] = ("agent",)) -> DataFrame:
    """The newest row per agent; a combined aggregate, not a sort."""
    ties = [c for c in ("name",) if c in checkpoints.columns]
    return first_per(checkpoints, list(keys), [-F.unix_micros(F.col("modified").cast("timestamp")), *ties])


def expire_checkpoints(checkpoints: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Those older than the limit."""
    return checkpoints.where(F.col("modified").cast("timestamp") < as_of.cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def remaining_projects(projects: DataFrame, done: DataFrame) -> DataFrame:
    return projects.join(done.select("project").distinct(), "project", "left_anti")


def file_hash(content: Column) -> Column:
    return F.left(F.sha2(content, 256), F.lit(16))


def snapshot(files: DataFrame) -> DataFrame:
    return files.select("project", "path", file_hash(F.col("content")).alias("hash"))


def changed_files(files: DataFrame, last: DataFrame) -> DataFrame:
    """Files whose (path, hash) is not in the last snapshot. Hashes alone are compared; only texts of changed files are fetched."""
    new = snapshot(files).distinct().join(last.select("project", "path", "hash").distinct(), ["project", "path", "hash"], "left_anti")
    return files.withColumn("hash", file_hash(F.col("content"))).join(new, ["project", "path", "hash"], "left_semi")


def merge_cached(files: DataFrame, last: DataFrame, cached: DataFrame, new: DataFrame) -> DataFrame:
    """Cached findings of unchanged files plus new findings of changed ones; deleted files drop out."""
    same = snapshot(files).join(last.select("project", "path", "hash").distinct(), ["project", "path", "hash"], "left_semi")
    keep = same.select("project", F.col("path").alias("file"))
    return cached.join(keep, ["project", "file"], "left_semi").unionByName(new, allowMissingColumns=True)


def _hash_entries(files: DataFrame) -> DataFrame:
    return files.select("project", F.concat_ws(":", "path", file_hash(F.col("content"))).alias("e"), F.left(F.md5("path"), F.lit(3)).alias("b"))


def _joined_hash(entries: str) -> Column:
    return F.left(F.sha2(F.array_join(F.sort_array(F.collect_list(entries)), "|"), 256), F.lit(32)).alias("hash")


def project_hash(files: DataFrame) -> DataFrame:
    """One hash per project over its sorted `path:hash` entries, joined. A project's entries meet in one value
    (some 60 bytes a file); `project_hash_tree` is the way for projects of any size."""
    return _hash_entries(files).groupBy("project").agg(_joined_hash("e")).select("project", F.lit("flat").alias("hash_kind"), "hash")


def project_hash_tree(files: DataFrame) -> DataFrame:
    """One hash per project over the hashes of 4,096 buckets of paths, so that no value holds a whole project."""
    buckets = _hash_entries(files).groupBy("project", "b").agg(F.array_join(F.sort_array(F.collect_list("e")), "|").alias("t"))
    one = buckets.select("project", F.concat_ws(":", "b", F.sha2("t", 256)).alias("t"))
    return one.groupBy("project").agg(_joined_hash("t")).select("project", F.lit("tree").alias("hash_kind"), "hash")
