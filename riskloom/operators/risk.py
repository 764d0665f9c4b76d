"""Unresolved risks and their pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.severity import round_half_up
from riskloom.operators.validate import complexity_score, impact_score, missing_evidence, reachability_score

SEVERITY_POINTS = {"critical": 30, "high": 20, "medium": 10, "low": 5}


def risk_entries(findings: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Findings that are not settled, with a score of 0-100, a priority and the reasons.

    Counts the three dimensions, the trace status (traces(project, location, trace_status)), each
    missing piece of evidence (15), no proof by exploit (30), and the severity.
    """
    if "evidence_points" not in findings.columns:
        findings = findings.withColumn("evidence_points", F.array().cast("array<string>"))
    df = missing_evidence(findings)
    if traces is not None:
        df = df.join(traces.select("project", "location", "trace_status"), ["project", "location"], "left")
    else:
        df = df.withColumn("trace_status", F.lit(None).cast("string"))
    proven = F.coalesce("confirmed_exploitable", F.lit(False)) if "confirmed_exploitable" in df.columns else F.lit(False)
    partial = F.col("completeness") == "PARTIAL"
    open_trace = F.coalesce(F.col("trace_status").isin("UNRESOLVED", "PARTIAL"), F.lit(False))
    points = F.coalesce(*[F.when(F.col("severity") == s, p) for s, p in SEVERITY_POINTS.items()], F.lit(0))
    score = (reachability_score(df) * 40 / 3.0 + impact_score() * 35 / 3.0 + complexity_score() * 25 / 3.0
             + F.when(F.col("trace_status") == "UNRESOLVED", 40).when(F.col("trace_status") == "PARTIAL", 20).otherwise(0)
             + F.when(partial, F.size("missing_evidence") * 15).otherwise(0) + F.when(proven, 0).otherwise(30) + points)
    reasons = F.array_compact(F.array(
        F.when(open_trace, F.concat(F.lit("trace: "), F.col("trace_status"))),
        F.when(partial, F.concat(F.lit("missing evidence: "), F.array_join("missing_evidence", ", "))),
        F.when(~proven & ~open_trace & ~partial, "not proven by exploit")))
    df = df.withColumn("reasons", reasons).withColumn("risk_score", F.least(round_half_up(score), F.lit(100)))
    df = df.where(F.size("reasons") > 0)
    priority = F.when(F.col("risk_score") >= 70, "high").when(F.col("risk_score") >= 40, "medium").otherwise("low")
    return df.withColumn("risk_status", F.lit("to_verify")).withColumn("priority", priority)


def risk_pool(entries: DataFrame) -> DataFrame:
    """Per project: counts by priority and the mean score."""
    return entries.groupBy("project").agg(
        F.count("*").alias("total"), *[F.count(F.when(F.col("priority") == p, 1)).alias(f"{p}_count") for p in ("high", "medium", "low")],
        round_half_up(F.avg("risk_score")).alias("avg_score"))
