"""Numbers on findings and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import dims
from riskloom.functions import severity
from riskloom.functions.severity import round_half_up


def cvss_3d(df: DataFrame) -> DataFrame:
    """Reachability, impact and complexity of the type: 0.40 R + 0.35 I + 0.25 C, and a CVSS from it."""
    dim = F.broadcast(dims.type_dim(df.sparkSession).select("vuln_type", "reachability", "impact_level", "complexity"))
    out = df.join(dim, "vuln_type", "left")
    for c in ("reachability", "impact_level", "complexity"):
        out = out.withColumn(c, F.coalesce(c, F.lit(2)))
    r, i, c = F.col("reachability"), F.col("impact_level"), F.col("complexity")
    score = r * F.lit(0.40) + i * F.lit(0.35) + c * F.lit(0.25)
    mult = severity_multiplier(F.col("severity"))
    adjusted = [round_half_up(x * mult).cast("string") for x in (r, i, c)]
    return (out.withColumn("score_raw", round_half_up(score, 2))
            .withColumn("cvss", F.floor(score / F.lit(3.0) * F.lit(10.0) * mult * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0))
            .withColumn("cvss_breakdown", F.concat_ws("/", *adjusted)))


def severity_multiplier(col: Column) -> Column:
    return dims.lookup(severity.MULTIPLIERS, severity.severity_map_strict(col), 0.7)


def cvss_base(df: DataFrame) -> DataFrame:
    dim = F.broadcast(dims.type_dim(df.sparkSession).select("vuln_type", "cvss_base"))
    value = F.coalesce("cvss_base", F.lit(5.0)) * severity_multiplier(F.col("severity"))
    return df.join(dim, "vuln_type", "left").withColumn("cvss_base", F.floor(value * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0))


# Vulnerable components are scored by severity alone.
COMPONENT = {"critical": (9.8, "3/3/1", 3), "high": (8.0, "3/2/1", 2), "medium": (5.9, "2/2/1", 2), "low": (3.1, "1/1/1", 1)}


def component_cvss(col: Column) -> Column:
    return F.struct(dims.lookup({k: v[0] for k, v in COMPONENT.items()}, col, 5.0).alias("cvss"),
                    dims.lookup({k: v[1] for k, v in COMPONENT.items()}, col, "2/2/1").alias("breakdown"),
                    dims.lookup({k: v[2] for k, v in COMPONENT.items()}, col, 2).alias("impact_level"))


# How a statement on exploitability changes reachability and complexity.
EXPLOITABILITY = {"confirmed": (1.0, 1.0), "unverified": (1.0, 0.67), "not_exploitable": (0.0, 0.0),
                  "environment": (0.67, 0.67)}
# Type:R:I:C -> score, CVSS, level of well-known cases.
TYPICAL = {
    "SQL_INJECTION:3:3:3": (3.00, 10.0, "C"), "SQL_INJECTION:3:3:2": (2.75, 9.2, "C"), "SQL_INJECTION:2:3:2": (2.35, 7.8, "H"),
    "SQL_INJECTION:1:2:1": (1.35, 4.5, "M"), "XXE:3:3:3": (3.00, 10.0, "C"), "XXE:2:3:3": (2.60, 8.7, "H"),
    "XXE:2:2:2": (2.00, 6.7, "M"), "FILE_UPLOAD:3:3:2": (2.75, 9.2, "C"), "FILE_UPLOAD:3:2:2": (2.40, 8.0, "H"),
    "FILE_READ:3:2:2": (2.40, 8.0, "H"), "FILE_READ:2:2:2": (2.00, 6.7, "M"), "AUTH_BYPASS:3:2:2": (2.40, 8.0, "H"),
    "AUTH_BYPASS:3:3:2": (2.75, 9.2, "C"), "COMMAND_INJECTION:3:3:3": (3.00, 10.0, "C"),
    "DESERIALIZATION:3:3:2": (2.75, 9.2, "C"), "SSRF:3:2:2": (2.40, 8.0, "H"), "COMPONENT_VULNERABILITY:3:3:1": (2.50, 8.3, "H"),
}


def score_vulnerability(df: DataFrame, r: str = "reachability", i: str = "impact_level", c: str = "complexity",
                        exploitability: str | None = None) -> DataFrame:
    """score, cvss and level; a well-known (type, R, I, C) case has its listed values."""
    rr, ii, cc = (F.coalesce(F.col(x).cast("double"), F.lit(2.0)) for x in (r, i, c))
    if exploitability:
        rr = rr * dims.lookup({k: v[0] for k, v in EXPLOITABILITY.items()}, F.col(exploitability), 1.0)
        cc = cc * dims.lookup({k: v[1] for k, v in EXPLOITABILITY.items()}, F.col(exploitability), 1.0)
    score = round_half_up(rr * F.lit(0.40) + ii * F.lit(0.35) + cc * F.lit(0.25), 2)
    level = (F.when(F.col("score").between(2.70, 3.00), "C").when(F.col("score").between(2.10, 2.69), "H")
             .when(F.col("score").between(1.20, 2.09), "M").otherwise("L"))
    known = F.concat_ws(":", "vuln_type", F.col(r).cast("int"), F.col(i).cast("int"), F.col(c).cast("int"))
    out = df.withColumn("score", score)
    out = (out.withColumn("cvss", F.floor(F.col("score") / F.lit(3.0) * F.lit(10.0) * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0))
           .withColumn("level", level))
    if exploitability is None:
        for n, name in enumerate(("score", "cvss", "level")):
            out = out.withColumn(name, F.coalesce(dims.lookup({k: v[n] for k, v in TYPICAL.items()}, known), F.col(name)))
    return out


# Base scores (plain, or per detail), friction and weaponisation.
DKTSS_BASE = {"COMMAND_INJECTION": 10, "CODE_INJECTION": 10, "DESERIALIZATION": 10, "AUTH_BYPASS": 8, "IDOR": 7, "XXE": 6,
              "PATH_TRAVERSAL": 6, "FILE_UPLOAD": 6, "WEAK_CRYPTO": 5, "WEAK_HASH": 4, "HARD_CODE_PASSWORD": 7,
              "LOG_INJECTION": 4}
DKTSS_FRICTION = {"access_path": {"internet": 0, "intranet": -2, "physical": -4},
                  "auth_required": {"none": 0, "lowPrivilege": -1, "highPrivilege": -3},
                  "interaction": {"none": 0, "weak": -1, "strong": -3}}
DKTSS_WEAPON = {"matureExp": 1, "pocOnly": 0, "theoretical": -2}


def dktss(df: DataFrame) -> DataFrame:
    """Base minus friction plus weaponisation, within 0-10. Missing columns take the mildest value."""
    def col(name):
        return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")

    detail = col("detail")
    # a detail the type's own scale does not know leaves the type's default
    base = (F.when(F.col("vuln_type") == "SQL_INJECTION",
                   F.when(detail.contains("脱库") | detail.contains("写文件"), 8)
                   .when(detail.contains("读") | detail.contains("limited"), 6).otherwise(7))
            .when(F.col("vuln_type") == "SSRF", 7).when(F.col("vuln_type") == "XSS", 5)
            .otherwise(dims.lookup(DKTSS_BASE, F.col("vuln_type"), 5)))
    friction = sum((dims.lookup(m, col(name), 0) for name, m in DKTSS_FRICTION.items()), F.lit(0))
    value = base + friction + dims.lookup(DKTSS_WEAPON, col("weapon_level"), 0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), value.cast("double")))
    return df.withColumn("dktss", score).withColumn(
        "dktss_level", F.when(score >= 7, "critical").when(score >= 5, "high").when(score >= 3, "medium").otherwise("low"))


def _score_columns(threshold: int, max_major: int, max_blocker: int) -> list[Column]:
    level = severity.severity_level(F.col("severity"))
    return [F.count(F.when(F.col("_finding") & (level == x), 1)).alias(x) for x in ("blocker", "major", "minor", "info")]


def _with_gate(counts: DataFrame, threshold: int, max_major: int, max_blocker: int) -> DataFrame:
    score = F.greatest(F.lit(0), F.lit(100) - F.col("blocker") * 25 - F.col("major") * 5 - F.col("minor")
                       - F.least(F.lit(3), F.greatest(F.lit(0), F.col("info") - 5)))
    out = counts.withColumn("score", score)
    reasons = F.array_compact(F.array(
        F.when(F.col("blocker") > max_blocker, F.concat(F.lit("blocker:"), F.col("blocker"), F.lit(f">{max_blocker}"))),
        F.when(F.col("major") > max_major, F.concat(F.lit("major:"), F.col("major"), F.lit(f">{max_major}"))),
        F.when(F.col("score") < threshold, F.concat(F.lit("score:"), F.col("score"), F.lit(f"<{threshold}")))))
    return (out.withColumn("gate_reasons", reasons).withColumn("gate_passed", F.size("gate_reasons") == 0)
            .withColumn("rating", F.when(F.col("score") >= 85, "A").when(F.col("score") >= 70, "B")
                        .when(F.col("score") >= 50, "C").otherwise("D")))


def score_project(findings: DataFrame, threshold: int = 70, max_major: int = 3, max_blocker: int = 0,
                  projects: DataFrame | None = None) -> DataFrame:
    """Score, gate and rating per project; one map-side combined aggregate.

    With `projects`, those without findings appear with the full score.
    """
    rows = findings.select("project", "severity", F.lit(True).alias("_finding"))
    if projects is not None:
        rows = rows.unionByName(projects.select("project", F.lit(None).cast("string").alias("severity"), F.lit(False).alias("_finding")))
    counts = rows.groupBy("project").agg(*_score_columns(threshold, max_major, max_blocker),
                                         F.count(F.when(F.col("_finding"), 1)).alias("findings_count"))
    return _with_gate(counts, threshold, max_major, max_blocker)


SOURCE_GROUPS = {"heuristic": "scan", "quick-scan": "scan", "quick_scan": "scan", "llm": "model", "react": "agent"}


def score_by_source(findings: DataFrame, threshold: int = 70, max_major: int = 3, max_blocker: int = 0) -> DataFrame:
    """The same overall and per detector group (scan, model, agent): one pass with grouping sets."""
    rows = findings.select("project", "severity", F.lit(True).alias("_finding"),
                           dims.lookup(SOURCE_GROUPS, F.col("source"), "other").alias("source_group"))
    counts = (rows.groupingSets([[F.col("project")], [F.col("project"), F.col("source_group")]], "project", "source_group")
              .agg(*_score_columns(threshold, max_major, max_blocker), F.count("_finding").alias("findings_count"),
                   F.grouping("source_group").alias("_all")))
    counts = counts.withColumn("source_group", F.when(F.col("_all") == 1, "overall").otherwise(F.col("source_group"))).drop("_all")
    return _with_gate(counts.where(F.col("source_group") != "other"), threshold, max_major, max_blocker)


def severity_table(findings: DataFrame) -> DataFrame:
    """Counts by the first letter of the finding id."""
    return (findings.where(F.col("vuln_id").rlike("^[CHML]-")).groupBy(F.left("vuln_id", F.lit(1)).alias("level"))
            .agg(F.count("*").alias("n")))
