"""Writing findings: tables, Markdown rows, SARIF documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from riskloom.dims import lookup
from riskloom.functions import paths
from riskloom.functions.durable import durable
from riskloom.functions.ranking import numbered

# SARIF level of a severity.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def exportable(findings: DataFrame) -> DataFrame:
    """Everything but rejected findings."""
    if "verdict" not in findings.columns:
        return findings
    return findings.where(F.coalesce("verdict", F.lit("")) != "false_positive")


def export_findings(findings: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Accepted findings, one directory per project.

    With dynamic partition overwrite a run replaces only the projects it holds.
    """
    (exportable(findings).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("project").format(format).save(path))


def _ordered(findings: DataFrame) -> DataFrame:
    df = (exportable(findings).withColumn("_dir", paths.directory(F.col("file"))).withColumn("_name", paths.basename(F.col("file"))))
    order = ["line", *[c for c in ("offset", "rule_id", "vuln_type", "match") if c in findings.columns]]
    return numbered(df, ["project"], ["_dir", "_name"], order, "ord").drop("_dir", "_name")


def export_markdown(findings: DataFrame, title_chars: int = 60) -> DataFrame:
    """lines(project, section, ord, line) of the report: head, table, details.

    One row per report line, in order of (section, ord); a report is never collected into one value.
    """
    df = _ordered(findings)

    def text(name, default):
        return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(default)) if name in df.columns else F.lit(default)

    head = df.groupBy("project").agg(F.count("*").alias("n")).select("project", F.posexplode(F.array(
        F.lit("# Code security report"), F.lit(""), F.concat(F.lit("**Findings**: "), F.col("n")), F.lit(""), F.lit("## Findings"), F.lit(""),
        F.lit("| Severity | Type | File | Line | Title |"), F.lit("|---|---|---|---|---|"))).alias("p", "line")).select(
        "project", F.lit(0).alias("section"), F.col("p").cast("long").alias("ord"), "line")
    title = F.left(F.replace(text("title", ""), F.lit("|"), F.lit("\\|")), F.lit(title_chars))
    table = df.select("project", F.lit(1).alias("section"), F.col("ord").cast("long").alias("ord"), F.concat(
        F.lit("| "), F.concat_ws(" | ", F.upper(text("severity", "medium")), text("vuln_type", "unknown"), text("file", "n/a"),
                                 text("line", ""), title), F.lit(" |")).alias("line"))
    detail = df.select("project", "ord", F.posexplode(F.array_compact(F.array(
        F.concat(F.lit("### "), F.col("ord"), F.lit(". "), text("title", "untitled")), F.lit(""),
        F.concat(F.lit("- **Severity**: "), text("severity", "N/A")), F.concat(F.lit("- **Type**: "), text("vuln_type", "N/A")),
        F.concat(F.lit("- **Location**: "), text("location", "N/A")),
        F.when(text("description", "") != "", F.concat(F.lit("- **Description**: "), text("description", ""))),
        F.when(text("remediation", "") != "", F.concat(F.lit("- **Remediation**: "), text("remediation", ""))), F.lit("")))).alias("p", "line")
    ).select("project", F.lit(2).alias("section"), (F.col("ord") * 100 + F.col("p")).cast("long").alias("ord"), "line")
    return head.unionByName(table).unionByName(detail)


def write_markdown(lines: DataFrame, path: str) -> None:
    """One directory of text files per project, lines in report order."""
    (lines.repartitionByRange("project", "section", "ord").sortWithinPartitions("project", "section", "ord")
     .select("project", F.col("line").alias("value")).write.mode("overwrite").partitionBy("project").text(path))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(project, ord, rule_id_, rule_index, level, result json): one SARIF result per finding.

    Rules are numbered by first appearance; the window runs over the distinct rules of a project only.
    """
    df = durable(_ordered(findings).withColumn("_rule", F.coalesce(F.nullif("vuln_type", F.lit("")), F.lit("UNKNOWN"))))
    seen = df.groupBy("project", "_rule").agg(F.min("ord").alias("_first"))
    index = seen.select("project", "_rule", (F.row_number().over(W.partitionBy("project").orderBy("_first")) - 1).alias("rule_index"))
    df = df.join(index, ["project", "_rule"])
    level = lookup(SARIF_LEVELS, F.lower(F.coalesce("severity", F.lit(""))), "warning")
    at = paths.split_location(F.col("location"))
    region = F.when(at["line"] > 0, F.struct(
        at["line"].alias("startLine"), F.coalesce(at["col"], F.lit(1)).alias("startColumn"),
        F.struct(F.col("evidence").alias("text")).alias("snippet")))
    place = F.array(F.struct(F.struct(F.struct(at["file"].alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
                                      region.alias("region")).alias("physicalLocation")))
    suppressed = [F.when(F.coalesce("suppression", F.lit("")) != "", F.array(F.struct(
        F.lit("inSource").alias("kind"), F.col("suppression").alias("justification")))).alias("suppressions")] if "suppression" in df.columns else []
    message = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("impact_text", "title") if c in df.columns], F.lit("Security issue detected"))
    result = F.to_json(F.struct(F.col("_rule").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"),
                                F.struct(message.alias("text")).alias("message"), place.alias("locations"), *suppressed))
    return df.select("project", "ord", F.col("_rule").alias("rule"), "rule_index", level.alias("level"), "title", "severity",
                     *[F.col(c) for c in ("cwe", "remediation") if c in df.columns], result.alias("result"))


def export_sarif(findings: DataFrame, page_size: int = 5000, tool: str = "riskloom", version: str = "0.1") -> DataFrame:
    """(project, page, sarif): complete SARIF 2.1.0 documents.

    A document holds at most `page_size` results, so no row grows with the project; the pages of a
    project share their rule list and together hold every result.
    """
    res = sarif_results(findings)
    extra = [c for c in ("cwe", "remediation") if c in res.columns]
    firsts = res.groupBy("project", "rule_index", F.col("rule").alias("_id")).agg(F.min_by(F.struct("title", "severity", "level", *extra), "ord").alias("f"))
    rule = F.struct(
        F.col("_id").alias("id"), F.coalesce("f.title", F.col("_id")).alias("name"),
        F.struct(F.coalesce("f.title", F.col("_id")).alias("text")).alias("shortDescription"),
        F.struct((F.coalesce("f.remediation", F.lit("")) if "remediation" in extra else F.lit("")).alias("text")).alias("help"),
        F.struct(F.col("f.level").alias("level")).alias("defaultConfiguration"),
        F.struct(F.array(F.lit("security"), F.coalesce("f.severity", F.lit("medium"))).alias("tags"),
                 *([F.array("f.cwe").alias("cwe")] if "cwe" in extra else [])).alias("properties"))
    rules = firsts.select("project", F.struct("rule_index", rule.alias("rule")).alias("r")).groupBy("project").agg(
        F.transform(F.sort_array(F.collect_list("r")), lambda x: F.to_json(x["rule"])).alias("rules"))
    pages = res.withColumn("page", F.floor((F.col("ord") - 1) / page_size)).groupBy("project", "page").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "result"))), lambda x: x["result"]).alias("results"))
    head = '{"version":"2.1.0","$schema":"%s","runs":[{"tool":{"driver":{"name":"%s","version":"%s","rules":[' % (SARIF_SCHEMA, tool, version)
    return pages.join(rules, "project").select("project", "page", F.concat(
        F.lit(head), F.array_join("rules", ","), F.lit(']}},"results":['), F.array_join("results", ","), F.lit("]}]}")).alias("sarif"))


def sarif_summary(findings: DataFrame) -> DataFrame:
    """Counts by level and by rule, in one pass."""
    df = exportable(findings).select("project", lookup(SARIF_LEVELS, F.lower(F.coalesce("severity", F.lit(""))), "warning").alias("level"),
                                     F.coalesce(F.nullif("vuln_type", F.lit("")), F.lit("UNKNOWN")).alias("rule"))
    counts = df.groupingSets([[F.col("project"), F.col("level")], [F.col("project"), F.col("rule")]], "project", "level", "rule").agg(
        F.count("*").alias("n"), F.grouping("rule").alias("_by_level"))
    return counts.select("project", F.when(F.col("_by_level") == 1, "level").otherwise("rule").alias("kind"),
                         F.coalesce("level", "rule").alias("value"), "n")
