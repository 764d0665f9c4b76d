"""Findings of several detectors brought together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskloom import dims
from riskloom.functions import paths, severity
from riskloom.functions.durable import durable
from riskloom.functions.joins import growing
from riskloom.functions.ranking import top_n
from riskloom.operators.dedup import dedup_findings, exact_distinct, file_of, line_of
from riskloom.operators.filters import confidence_filter, title_fp_filter

MODEL_SOURCES = ["llm", "gapfill"]
SCAN_SOURCES = ["quick_scan", "taint", "rule", "pattern", "heuristic"]
IDENTITY = ["source", "file", "line", "vuln_type", "rule_id"]


def union_detectors(frames: list[DataFrame]) -> DataFrame:
    """One frame of all detectors; columns a detector lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def normalize_type(df: DataFrame, use: str = "merge", col: str = "vuln_type", out: str = "canonical_type") -> DataFrame:
    """The canonical type of a raw type; the synonym table is small and fixed."""
    key = F.lower(F.trim(col)) if use == "review" else F.col(col)
    dim = dims.synonym_dim(df.sparkSession, use).select(F.col("raw_type").alias("_raw"), F.col("canonical_type").alias("_to"))
    return df.withColumn("_key", key).join(F.broadcast(dim), F.col("_key") == F.col("_raw"), "left").withColumn(
        out, F.coalesce("_to", F.col(col), F.lit(""))).drop("_key", "_raw", "_to")


def cross_source_merge(findings: DataFrame, distance: int = 5) -> tuple[DataFrame, DataFrame]:
    """(kept findings with merged_count, dropped scan findings with the model finding that covers them).

    A scan finding goes when a model finding of the same file name and canonical type is within
    `distance` lines; the first model finding in severity and confidence order takes it. Only one
    model finding per line can be first, and scan lines are looked up line by line, so the join
    holds at most 2 * distance + 1 rows per scan line however many findings share a name. The findings are worked out once
    and kept, and so is the verdict on each scan finding: every part of the result reads them, with scans of texts behind.
    """
    project = [c for c in ("project",) if c in findings.columns]
    findings = durable(findings)
    df = normalize_type(findings, "merge").withColumn("_name", F.lower(paths.basename(file_of(findings)))).withColumn("_line", line_of(findings))
    keys = [*project, "_name", "canonical_type"]
    model, scan = df.where(F.col("source").isin(MODEL_SOURCES)), df.where(F.col("source").isin(SCAN_SOURCES))
    order = F.struct((-severity.severity_rank(F.col("severity"))).alias("s"), (-F.coalesce(F.col("confidence"), F.lit(0.0))).alias("c"),
                     *[F.col(c) for c in IDENTITY])
    per_line = model.groupBy(*keys, F.col("_line").alias("_at")).agg(F.min(order).alias("_best"))
    lines = scan.select(*keys, "_line").distinct()
    near = lines.withColumn("_at", F.explode(F.sequence(F.col("_line") - distance, F.col("_line") + distance)))
    cover = near.join(growing(per_line), [*keys, "_at"]).groupBy(*keys, "_line").agg(F.min("_best").alias("_best"))
    judged = durable(scan.join(growing(cover), [*keys, "_line"], "left"))
    merged = judged.where(F.col("_best").isNotNull()).select(
        *project, F.struct(*[F.col(f"_best.{c}").alias(c) for c in IDENTITY]).alias("into"), "source", "vuln_type", "location", "title")
    counts = merged.groupBy(*project, *[F.col(f"into.{c}").alias(c) for c in IDENTITY]).agg(F.count("*").alias("merged_count"))
    cols = findings.columns
    kept_model = findings.where(F.col("source").isin(MODEL_SOURCES)).join(growing(counts), [*project, *IDENTITY], "left")
    kept_scan = judged.where(F.col("_best").isNull()).select(*cols, F.lit(0).cast("long").alias("merged_count"))
    other = findings.where(~F.col("source").isin(MODEL_SOURCES + SCAN_SOURCES)).withColumn("merged_count", F.lit(0).cast("long"))
    kept = kept_model.select(*cols, F.coalesce("merged_count", F.lit(0)).alias("merged_count")).unionByName(kept_scan).unionByName(other)
    return exact_distinct(kept), merged


def merge_prioritize(detectors: list[DataFrame] | DataFrame, min_confidence: float = 0.4, gbt: dict | None = None) -> DataFrame:
    """Empty titles out, duplicates out per detector, model findings over scan findings, enriched, filtered."""
    from riskloom.operators.enrich import enrich_findings

    df = detectors if isinstance(detectors, DataFrame) else union_detectors(detectors)
    kept, _ = cross_source_merge(dedup_findings(title_fp_filter(df), keep_sources=True))
    return confidence_filter(enrich_findings(kept, gbt), min_confidence)


def _file(df: DataFrame):
    return F.element_at(F.split(F.coalesce("location", F.lit("")), ":"), 1)


def type_gap_map(findings: DataFrame, n: int | None = None) -> DataFrame:
    """(file, type) pairs only the scans found, at high or critical severity, with their findings.

    With n, only the first n of a project and their members.
    """
    df = normalize_type(findings, "gap", out="norm_type").withColumn("gap_file", _file(findings)).withColumn("_line", line_of(findings))
    keys = ["project", "gap_file", "norm_type"]
    model = df.where(F.col("source").isin(MODEL_SOURCES)).select(*keys).distinct()
    scans = df.where(F.col("source").isin(SCAN_SOURCES)).join(growing(model), keys, "left_anti")
    rank = severity.severity_rank(F.col("severity"))
    gaps = scans.groupBy(*keys).agg(F.max_by("severity", rank).alias("max_severity"), F.max(rank).alias("_rank"), F.count("*").alias("findings"))
    gaps = gaps.where(F.col("_rank") >= 3).drop("_rank")
    if n is not None:
        gaps = top_n(gaps, n, [F.col("gap_file"), F.col("norm_type")], by=["project"])
    members = group_members(scans.join(growing(gaps.select(*keys)), keys, "left_semi"), keys)
    return gaps.join(growing(members), keys)


def group_members(findings: DataFrame, keys: list[str]) -> DataFrame:
    """members array<struct<line,location,severity,title>> per key; a key holds the findings of one file."""
    at = F.col("_line") if "_line" in findings.columns else line_of(findings)
    return findings.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        at.alias("line"), "location", "severity", "title"))).alias("members"))


def unverified_flag(findings: DataFrame) -> DataFrame:
    """`unverified` on critical and high scan findings no reviewer touched on the same (file, type)."""
    by_model = (F.col("source") == "llm") | (F.col("skill_id") == "vuln-type-gapfill") if "skill_id" in findings.columns else F.col("source") == "llm"
    df = findings.withColumn("_f", _file(findings))
    seen = df.where(by_model).select("project", "_f", "vuln_type").distinct().withColumn("_seen", F.lit(True))
    hit = (F.col("source") == "quick_scan") & F.lower("severity").isin("critical", "high") & F.col("_seen").isNull()
    return df.join(growing(seen), ["project", "_f", "vuln_type"], "left").withColumn("unverified", hit).select(*findings.columns, "unverified")


def uncovered_files(files: DataFrame, findings: DataFrame, extra: int | None = None) -> DataFrame:
    """Files with findings but none from a reviewer, and the first few files of a project without any."""
    hits = findings.select("project", _file(findings).alias("path"), (F.col("source") == "llm").alias("m")).groupBy("project", "path").agg(
        F.bool_or("m").alias("m"))
    gap = hits.where(~F.col("m")).select("project", "path", F.lit("no_model_finding").alias("reason"))
    missed = files.select("project", "path").join(growing(hits.select("project", "path")), ["project", "path"], "left_anti")
    return gap.unionByName(top_n(missed, extra, [F.col("path")], by=["project"]).withColumn("reason", F.lit("never_reported")))


def final_counts(findings: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Per project: all findings, accepted ones, and accepted ones by detector; reviewer calls made and skipped."""
    ok = F.coalesce("verdict", F.lit("")) != "false_positive" if "verdict" in findings.columns else F.lit(True)
    out = findings.groupBy("project").agg(
        F.count("*").alias("total"), F.count(F.when(ok, 1)).alias("confirmed"), F.count(F.when(ok & (F.col("source") == "llm"), 1)).alias("model"),
        F.count(F.when(ok & F.col("source").isin("quick_scan", "taint", "rule", "pattern"), 1)).alias("scan"))
    if calls is not None:
        c = calls.groupBy("project").agg(F.count(F.when(F.col("called"), 1)).alias("calls"), F.count(F.when(~F.col("called"), 1)).alias("skipped"))
        out = out.join(growing(c), "project", "full").na.fill(0)
    return out
