"""The same operators on streams of files, calls and rounds.

Every job that keeps state bounds it with a watermark or a time to live.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.functions.ranking import first_per
from riskloom.operators import scan
from riskloom.operators.messages import ROUND_SCHEMA, advance
from riskloom.sources.history import file_hash
from riskloom.sources.rules import Rule


def work_folder(spark: SparkSession) -> str:
    """A new folder for one run: below the folder the cluster names, else a scratch folder of this machine (tests)."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stream_table(spark: SparkSession, folder: str, file_glob: str, files_per_batch: int | None = None) -> DataFrame:
    """What `file_glob` names below a folder as a stream: parquet files, or folders of parquet files. The schema is that of the files present."""
    path = f"{folder.rstrip('/')}/{file_glob}"
    schema = spark.read.parquet(path).schema
    # a stream takes a single file only by a pattern
    path = path if any(c in file_glob for c in "*?[{") else f"{folder.rstrip('/')}/[{file_glob[0]}]{file_glob[1:]}"
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def stream_scan(files: DataFrame, rules: list[Rule], exact_offsets: bool = False) -> DataFrame:
    """Findings of files as they arrive; no state."""
    found = scan.scan_rules(files, rules) if exact_offsets else scan.scan_lines(files, rules)
    return scan.make_findings(found, "quick_scan")


def stream_changed(files: DataFrame, keep: str = "30 days") -> DataFrame:
    """Files whose (project, path, content hash) did not arrive within the last `keep`.

    Time is the time of arrival, so a file counts however old its modification time is; a file that comes back after `keep`
    counts again, which bounds the state by what arrives within `keep`.
    """
    return (files.withColumn("hash", file_hash(F.col("content"))).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", keep)
            .dropDuplicatesWithinWatermark(["project", "path", "hash"]).drop("_arrived"))


def stream_failure_rate(log: DataFrame, window: str = "60 seconds", slide: str | None = "10 seconds", late: str = "1 minute",
                        threshold: float = 0.5, min_calls: int = 10) -> DataFrame:
    """Failure rate per key in sliding windows (tumbling with slide=None). log(ts, key, ok)."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = log.withWatermark("ts", late).groupBy(span.alias("w"), "key").agg(F.count("*").alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("failures"))
    rate = F.col("failures") / F.col("calls")
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "calls", "failures", rate.alias("failure_rate"),
                      ((F.col("calls") >= min_calls) & (rate >= threshold)).alias("alarm"))


def stream_metrics(log: DataFrame, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Calls, duration and successes per key and window. log(ts, key, ok, duration)."""
    out = log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "key").agg(
        F.count("*").alias("n"), F.sum("duration").alias("total_duration"), F.count(F.when(F.col("ok"), 1)).alias("successful"))
    return out.select(F.col("w.start").alias("window_start"), "key", "n", "total_duration", "successful")


def stream_token_rounds(rounds: DataFrame, max_tokens: int, soft: float = 0.60, hard: float = 0.80, keep: float = 0.2,
                        ttl: str | None = "1 day") -> DataFrame:
    """Token rounds per conversation with state carried between batches and dropped after `ttl` without a round.

    rounds(conv_id, turn, input_tokens, output_tokens); rounds of one batch go in turn order. Give
    ttl=None to a run that ends with the available data: pending timeouts would keep it alive.
    """
    def walk(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current = state.get if state.exists else (0, 0, 0, False, False, 0)
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, i, o in rows[["turn", "input_tokens", "output_tokens"]].itertuples(index=False):
            current, row = advance(tuple(current), int(i), int(o), max_tokens, soft, hard, keep)
            out.append((key[0], turn, *row))
        state.update(current)
        if ttl:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "round", "total", "ratio", "soft", "hard", "compressions", "rounds_left"])

    n, unit = (ttl or "0 day").split()
    ttl_ms = int(n) * {"day": 86_400_000, "hour": 3_600_000, "minute": 60_000}[unit.rstrip("s")]
    return rounds.groupBy("conv_id").applyInPandasWithState(
        walk, f"conv_id long, turn long, {ROUND_SCHEMA}", "i long, o long, n int, soft boolean, hard boolean, c int", "append",
        GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)


def finding_counts_sink(path: str):
    """foreachBatch writer of per-batch counts; a replayed batch overwrites its own folder, so nothing counts twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("project", "severity").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stream_finding_counts(findings: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Starts the running counts of a findings stream; read them with `running_counts`."""
    writer = findings.writeStream.foreachBatch(finding_counts_sink(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_counts(spark: SparkSession, path: str) -> DataFrame:
    """Totals so far, and the last batch that added to each, as an event order."""
    return spark.read.parquet(path).groupBy("project", "severity").agg(F.sum("n").alias("n"), F.max("batch").alias("last_batch"))


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over everything available, into a parquet table, and returns that table.

    append and update write one folder per batch, so a replayed batch overwrites itself; update returns the row of the last batch
    for each of `keys`, which it needs. complete keeps the last state.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys that identify a row")
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state" if mode == "complete" else f"{out}/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if mode == "update":
        return first_per(spark.read.schema(stream.schema.add("batch", "long")).parquet(out), keys, [-F.col("batch")]).drop("batch")
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)
