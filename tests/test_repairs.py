"""Faults found in review: patterns the JVM refuses, old files on a stream, update mode, defaults that keep every row."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions.ranking import top_n
from riskloom.operators import scan
from riskloom.sources.rules import Rule, portable, usable
from riskloom.streaming import jobs


def test_loose_braces_run_in_both_engines(spark):
    assert portable(r"exec\s*\(`.*\${") == r"exec\s*\(`.*\$\{" and portable(r"a{2,3}\{b[{]") == r"a{2,3}\{b[\{]"
    good, bad = usable([Rule("R1", r"exec\s*\(`.*\${"), Rule("R2", r"a{1,2}b"), Rule("R3", "("), Rule("R4", r"(?P<n>x)(?P=n)")])
    assert [r.rule_id for r in good] == ["R1", "R2"] and [b[0] for b in bad] == ["R3", "R4"] and "JVM" in bad[1][2]
    files = spark.createDataFrame([("p", "a.js", "x = 1;\nexec(`ls ${dir}`)\naab", 10)], "project string, path string, content string, size long")
    assert sorted(r["rule_id"] for r in scan.scan_rules(files, good).collect()) == ["R1", "R2"]


def _write(spark, folder, k, rows):
    spark.createDataFrame(rows, "project string, path string, content string, modified timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_changed_files_of_any_age_in_several_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k, year in enumerate((2026, 2026, 2024, 2020)):
        _write(spark, folder, k, [("p", f"f{k}", "text", dt.datetime(year, 1, 1 + k)), ("p", "same", "text", dt.datetime(year, 1, 1))])
    stream = jobs.stream_table(spark, folder, "*.parquet", files_per_batch=1)
    got = jobs.run_to_table(jobs.stream_changed(stream), folder=str(tmp_path / "out"))
    assert sorted(r["path"] for r in got.collect()) == ["f0", "f1", "f2", "f3", "same"]


def test_update_mode_keeps_earlier_groups(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k, path in enumerate(("a", "b", "a", "c")):
        _write(spark, folder, k, [("p", path, "x", dt.datetime(2026, 1, 1))])
    counts = jobs.stream_table(spark, folder, "*.parquet", files_per_batch=1).groupBy("path").agg(F.count("*").alias("n"))
    got = jobs.run_to_table(counts, "update", folder=str(tmp_path / "out"), keys=["path"])
    assert {r["path"]: r["n"] for r in got.collect()} == {"a": 2, "b": 1, "c": 1}


def test_no_limit_keeps_every_row(spark):
    df = spark.range(300).withColumn("k", F.col("id") % 2)
    assert top_n(df, None, ["id"]).count() == 300 and top_n(df, 5, ["id"], by=["k"]).count() == 10
    lines = df.select(F.lit("p").alias("project"), F.lit("f").alias("path"), F.col("id").alias("line_no"), F.lit("a word").alias("line"))
    assert scan.search_text(lines, "WORD").count() == 300
