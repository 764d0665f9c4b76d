"""Calls to outside services: failures, rates, request counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def failure_stats(log: DataFrame, keys: list[str], threshold: float = 0.3, recent: int = 5) -> DataFrame:
    """Per key: calls, failures, rate, alarm, and the ids of the last failures. log(ts, ok, id)."""
    per = log.groupBy(*keys).agg(F.count("*").alias("total"), F.count(F.when(~F.col("ok"), 1)).alias("failed"))
    from riskloom.functions.ranking import top_n

    last = top_n(log.where(~F.col("ok")), recent, [F.col("ts").desc(), F.col("id").desc()], by=keys)
    last = last.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"]).alias("recent_errors"))
    return per.withColumn("failure_rate", F.col("failed") / F.col("total")).withColumn("above_threshold", F.col("failure_rate") >= threshold).join(
        last, keys, "left")


def request_metrics(log: DataFrame, key: str = "key") -> DataFrame:
    """Per path: calls, total duration, successes."""
    return log.groupBy(key).agg(F.count("*").alias("n"), F.sum("duration").alias("total_duration"), F.count(F.when(F.col("ok"), 1)).alias("successful"))


def rolling_failure_rate(log: DataFrame, seconds: int = 60, key: str = "key", min_calls: int = 10, rate: float = 0.5,
                         in_a_row: int = 5, slice_seconds: int = 3600) -> DataFrame:
    """Each call with the failure rate of the last seconds, the failures in a row so far, and an alarm.

    log(id, ts, key, ok). A hot key does not become one task: rows are cut into time slices of any length and windows run
    per (key, slice). A call is counted where it stands and taken back `seconds` later, so rates are differences of running
    totals and no row is visited again for the calls of its window, however many they are.
    Running totals and the run of failures carried into a slice come from one small row per slice.
    """
    # the window includes its own instant, so a call exactly `seconds` old still counts as out
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span, width = seconds * 1_000_000, slice_seconds * 1_000_000
    row, fails = F.struct(*log.columns), F.when(~F.col("ok"), 1).otherwise(0)
    steps = F.array(F.struct(us.alias("_us"), F.lit(1).alias("_d"), fails.alias("_f"), row.alias("_row")),
                    F.struct((us + span).alias("_us"), F.lit(-1).alias("_d"), (-fails).alias("_f"), F.when(F.lit(False), row).alias("_row")))
    marks = log.where(us.isNotNull()).select(F.col(key), F.explode(steps).alias("_m")).select(key, "_m.*").withColumn("_slice", F.floor(F.col("_us") / width))
    own = F.col("_d") == 1
    fail, good = F.when(own & ~F.col("_row.ok"), 1), F.when(own & F.col("_row.ok"), 1)
    marks = marks.withColumn("_id", F.col("_row.id"))
    seq = W.partitionBy(key, "_slice").orderBy("_us", "_id").rowsBetween(W.unboundedPreceding, 0)
    upto = W.partitionBy(key, "_slice").orderBy("_us").rangeBetween(W.unboundedPreceding, W.currentRow)

    def runs(rows: DataFrame) -> DataFrame:
        """Calls, successes, and failures since the last success, so far in the slice: windows of one order, so one sort."""
        rows = rows.withColumn("_n", F.count(F.when(own, 1)).over(seq)).withColumn("_run", F.count(good).over(seq)).withColumn("_bad", F.count(fail).over(seq))
        return rows.withColumn("_streak", F.col("_bad") - F.coalesce(F.max(F.when(good == 1, F.col("_bad"))).over(seq), F.lit(0)))

    win = runs(marks).withColumn("_open_calls", F.sum("_d").over(upto)).withColumn("_open_failures", F.sum("_f").over(upto))
    # per slice: calls, the failures at its end (all of them when nothing succeeded), and the calls and failures left open
    ends = runs(marks.where(own)).groupBy(key, "_slice").agg(F.count("*").alias("_calls"), F.max("_run").alias("_oks"), F.max_by("_streak", F.struct("_n")).alias("_tail"))
    left = marks.groupBy(key, "_slice").agg(F.sum("_d").alias("_dc"), F.sum("_f").alias("_df"))
    ends = left.join(ends, [key, "_slice"], "left").na.fill(0, ["_calls", "_oks", "_tail"])
    by_time = W.partitionBy(key).orderBy("_slice")
    before = by_time.rowsBetween(W.unboundedPreceding, -1)
    # failures carried in: the tails since the last slice with a success
    grp = ends.withColumn("_g", F.sum(F.when(F.col("_oks") > 0, 1).otherwise(0)).over(by_time.rowsBetween(W.unboundedPreceding, 0)))
    run_sum = F.sum("_tail").over(W.partitionBy(key, "_g").orderBy("_slice").rowsBetween(W.unboundedPreceding, 0))
    grp = grp.withColumn("_open", run_sum).withColumn("_carry", F.coalesce(F.lag("_open").over(by_time), F.lit(0)))
    for total, of in (("_prior", "_calls"), ("_prior_calls", "_dc"), ("_prior_failures", "_df")):
        grp = grp.withColumn(total, F.coalesce(F.sum(of).over(before), F.lit(0)))
    out = win.where(own).join(grp.select(key, "_slice", "_carry", "_prior", "_prior_calls", "_prior_failures"), [key, "_slice"])
    out = out.withColumn("window_calls", F.col("_open_calls") + F.col("_prior_calls")).withColumn("window_failures", F.col("_open_failures") + F.col("_prior_failures"))
    streak = F.when(F.col("_row.ok"), 0).otherwise(F.col("_streak") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0))
    out = out.withColumn("consecutive_failures", streak).withColumn("failure_rate", F.col("window_failures") / F.col("window_calls"))
    total = F.col("_n") + F.col("_prior")
    return out.withColumn("alarm", (F.col("consecutive_failures") >= in_a_row) | ((total >= min_calls) & (F.col("failure_rate") >= rate))).select(
        *[F.col(f"_row.{c}").alias(c) for c in log.columns], "window_calls", "window_failures", "failure_rate", "consecutive_failures", "alarm")
