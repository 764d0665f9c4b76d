"""Findings of one place and kind seen as a chain.

Every pair of a cluster is linked by the same few facts, so edges are counted from group sizes and
never listed pair by pair: the work grows with the findings, not with their square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom import dims
from riskloom.functions import paths, severity
from riskloom.functions.severity import round_half_up

# Which sink family feeds which, and the weight of a link.
FLOWS = {"CMD": ["CMD", "CODE", "FILE"], "SQL": ["SQL", "CODE"], "CODE": ["CMD", "SQL", "FILE", "SSRF", "XSS"],
         "SSRF": ["CMD", "SQL", "CODE", "FILE"], "XSS": ["XSS", "CODE"], "FILE": ["CMD", "SQL", "CODE"]}
WEIGHTS = {"data_flow": 1.0, "control_flow": 0.8}


def with_cluster(findings: DataFrame) -> DataFrame:
    """cluster `directory:type` and the sink family of each finding."""
    sinks = F.broadcast(dims.sink_dim(findings.sparkSession).select("vuln_type", "sink_type"))
    folder = F.coalesce(F.nullif(paths.directory(F.col("file")), F.lit("")), F.lit("root"))
    return findings.join(sinks, "vuln_type", "left").withColumn("sink_type", F.coalesce("sink_type", "vuln_type", F.lit(""))).withColumn(
        "cluster", F.concat_ws(":", folder, F.coalesce("vuln_type", F.lit("unknown"))))


def _flows(a, b):
    out = F.lit(False)
    for src, targets in FLOWS.items():
        out = out | ((a == src) & b.isin(targets))
    return out


def chain_edges(findings: DataFrame) -> DataFrame:
    """edges(project, cluster, from_sink, to_sink, link, n, from_points): directed links between different findings.

    A link is a data flow when the families allow it, else it is control flow (one directory).
    from_points sums the severity weight of the starting finding over the links.
    """
    df = with_cluster(findings).groupBy("project", "cluster", "sink_type").agg(
        F.count("*").alias("n"), F.sum(severity.severity_weight(F.col("severity"))).alias("w"))
    # families per cluster: at most the handful of sink families
    a = df.select("project", "cluster", F.col("sink_type").alias("from_sink"), F.col("n").alias("na"), F.col("w").alias("wa"))
    b = df.select("project", "cluster", F.col("sink_type").alias("to_sink"), F.col("n").alias("nb"))
    both = a.join(b, ["project", "cluster"])
    targets = F.when(F.col("from_sink") == F.col("to_sink"), F.col("nb") - 1).otherwise(F.col("nb"))
    link = F.when(_flows(F.col("from_sink"), F.col("to_sink")), "data_flow").otherwise("control_flow")
    return both.select("project", "cluster", "from_sink", "to_sink", link.alias("link"), (F.col("na") * targets).alias("n"),
                       (F.col("wa") * targets).alias("from_points")).where(F.col("n") > 0)


def shared_evidence(a, b):
    """Do two evidence lists have an entry in common?"""
    return F.arrays_overlap(a, b)


def chains(findings: DataFrame) -> DataFrame:
    """Clusters of two or more: size, links, risk on a 0-100 scale, severity.

    risk = mean of severity weight * 10, plus 10 per entry up to 30, plus 0.3 per weighted link up to 20;
    raw_risk is the unscaled sum over the size.
    """
    df = with_cluster(findings).groupBy("project", "cluster").agg(
        F.count("*").alias("length"), F.sum(severity.severity_weight(F.col("severity"))).alias("_points"), F.count_distinct("file").alias("files"))
    links = chain_edges(findings).groupBy("project", "cluster").agg(
        F.sum("n").alias("connections"), F.sum(F.col("from_points") * F.when(F.col("link") == "data_flow", 1.0).otherwise(0.8) * F.lit(0.3)).alias("_bonus"))
    out = df.where(F.col("length") >= 2).join(links, ["project", "cluster"])
    entry, bonus = F.least(F.col("length") * 10, F.lit(30)), F.least(F.col("_bonus"), F.lit(20.0))
    out = out.withColumn("raw_risk", F.least(round_half_up((F.col("_points") + entry + bonus) / F.col("length")), F.lit(100)))
    out = out.withColumn("risk", F.least(F.lit(100), round_half_up(F.col("_points") * 10.0 / F.col("length")) + round_half_up(entry + bonus)))
    sev = F.when(F.col("risk") >= 80, "critical").when(F.col("risk") >= 60, "high").when(F.col("risk") >= 40, "medium").otherwise("low")
    easy = F.when(F.col("risk") >= 80, "high").when(F.col("risk") >= 60, "medium").otherwise("low")
    return out.withColumn("severity", sev).withColumn("exploitability", easy).drop("_points", "_bonus")


def chain_report(chains_: DataFrame) -> DataFrame:
    return chains_.groupBy("project").agg(
        F.count("*").alias("total_chains"), *[F.count(F.when(F.col("severity") == s, 1)).alias(f"{s}_count") for s in ("critical", "high", "medium")],
        round_half_up(F.avg("risk")).alias("avg_risk"))
