"""Known vulnerable dependencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.ranking import first_per


@dataclass
class ComponentRule:
    name: str
    cve: str
    component: str
    pattern: str
    severity: str
    fix: str = ""


SEP = r"""["']?\s*[:_-]\s*["']?"""
# Published advisories; the pattern is the affected version range of a coordinate.
COMPONENT_RULES = [
    ComponentRule("Log4Shell", "CVE-2021-44228", "log4j-core", "log4j-core" + SEP + r"2\.(0|1|2|3|4|5|6|7|8|9|10|11|12|13|14)\.", "critical", "2.17.1"),
    ComponentRule("Log4j2 lookup", "CVE-2021-45046", "log4j-core", "log4j-core" + SEP + r"2\.15\.0", "critical", "2.17.1"),
    ComponentRule("Log4j 1.x SocketServer", "CVE-2019-17571", "log4j", "log4j" + SEP + r"1\.2\.", "critical", "2.17.1"),
    ComponentRule("Fastjson autotype", "CVE-2022-25845", "fastjson", "fastjson" + SEP + r"1\.2\.([0-7][0-9]|80)", "critical", "1.2.83"),
    ComponentRule("Fastjson gadget", "CVE-2020-8840", "fastjson", "fastjson" + SEP + r"1\.2\.([0-5][0-9]|6[0-8])", "critical", "1.2.84"),
    ComponentRule("Spring4Shell", "CVE-2022-22965", "spring-beans", "spring-(beans|core|context|web)" + SEP + r"5\.(3\.(0|1[0-7])|2\.(0|1[0-9]))", "critical", "5.3.18"),
    ComponentRule("Struts2 OGNL", "CVE-2020-17530", "struts2-core", "struts2-core" + SEP + r"2\.[0-5]\.([0-9]|1[0-9]|2[0-5])", "critical", "2.5.26"),
    ComponentRule("Struts2 multipart", "CVE-2017-5638", "struts2-core", "struts2-core" + SEP + r"2\.(3\.([5-9]|[12][0-9]|3[01])|5\.([0-9]|10))", "critical", "2.5.26"),
    ComponentRule("Commons Collections gadget", "CVE-2015-6420", "commons-collections", "commons-collections" + SEP + r"3\.(0|1|2\.[01])", "critical", "3.2.2"),
    ComponentRule("Shiro bypass", "CVE-2020-13933", "shiro-core", "shiro-core" + SEP + r"1\.[0-5]\.", "critical", "1.7.1"),
    ComponentRule("Shiro remember-me", "CVE-2016-4437", "shiro-core", "shiro-core" + SEP + r"1\.[0-2]\.", "critical", "1.7.1"),
    ComponentRule("Actuator exposure", "CWE-200", "spring-boot-starter-actuator", "spring-boot-starter-actuator" + SEP + r"1\.", "high", "2.x"),
    ComponentRule("Jackson databind", "CVE-2020-36518", "jackson-databind", "jackson-databind" + SEP + r"2\.[0-9]\.", "high", "2.13.3"),
    ComponentRule("Tomcat session", "CVE-2020-9484", "tomcat-embed-core", "tomcat-embed-core" + SEP + r"9\.0\.(0|[1-2][0-9]|3[0-5])", "high", "9.0.36"),
    ComponentRule("Shiro path", "CVE-2020-11989", "shiro-core", "shiro-core" + SEP + r"1\.[0-5]\.[0-2]", "high", "1.5.3"),
    ComponentRule("Guava temp dir", "CVE-2020-8908", "guava", "guava" + SEP + r"(1[0-9]|2[0-9])\.", "medium", "30.0"),
    ComponentRule("Gson", "CVE-2022-25647", "gson", "gson" + SEP + r"2\.[0-8]\.[0-8]", "medium", "2.8.9"),
    ComponentRule("PostgreSQL JDBC", "CVE-2024-1597", "postgresql", "postgresql" + SEP + r"42\.[0-7]\.[0-1]", "medium", "42.7.2"),
    ComponentRule("H2 console", "CVE-2022-23221", "h2", "h2" + SEP + r"[12]\.(0|1)\.", "medium", "2.1.210"),
    ComponentRule("Avro", "CVE-2024-47561", "avro", "avro" + SEP + r"1\.(0|1|2|3|4|5|6|7|8|9|10|11)\.", "medium", "1.11.4"),
    ComponentRule("OkHttp certificates", "CWE-295", "okhttp", "okhttp" + SEP + r"3\.(0|1|2|3|4|5|6|7|8|9|10|11|12)\.", "low", "4.x"),
]


def component_findings(rows: DataFrame) -> DataFrame:
    """Rows (project, file, component, version, rule_name, cve, severity, fix_version) as findings."""
    return rows.select(
        "*", F.lit("component_scan").alias("source"), F.lit("supply-chain").alias("skill_id"), F.lit("COMPONENT_VULNERABILITY").alias("vuln_type"),
        F.col("file").alias("location"), F.lit(1).alias("line"), F.lit(0.95).alias("confidence"), F.lit("CWE-1104").alias("cwe"),
        F.concat(F.col("rule_name"), F.lit(" - "), F.col("component")).alias("title"),
        F.concat(F.lit("Upgrade "), F.col("component"), F.lit(" to "), F.col("fix_version")).alias("remediation"))


def match_components(deps: DataFrame, rules: list[ComponentRule] = COMPONENT_RULES) -> DataFrame:
    """Findings for dependencies in an affected range, one per project, component and advisory.

    The rules are literals in one expression, so there is no join; duplicates fall in a combined aggregate.
    """
    coordinate = F.col("coordinate")
    low = F.lower(coordinate)
    tests = [F.when(low.contains(r.component.lower()) & coordinate.rlike(r.pattern), F.struct(
        F.lit(r.name).alias("rule_name"), F.lit(r.cve).alias("cve"), F.lit(r.severity).alias("severity"), F.lit(r.fix).alias("fix_version")))
        for r in rules]
    hits = deps.select("project", "path", "group_id", "artifact", "version", F.explode(F.array_compact(F.array(*tests))).alias("h"))
    rows = hits.select(
        "project", F.col("path").alias("file"), F.concat_ws(":", F.nullif("group_id", F.lit("")), "artifact").alias("component"), "version", "h.*")
    return component_findings(first_per(rows, ["project", "component", "cve"], ["file", "version", "rule_name"]))


def component_stats(deps: DataFrame, findings: DataFrame) -> DataFrame:
    """Per project: dependency files, dependencies, and unique vulnerabilities by severity."""
    d = deps.groupBy("project").agg(F.count_distinct("path").alias("files_scanned"), F.count("*").alias("dependencies"))
    f = findings.groupBy("project").agg(F.count("*").alias("vulnerabilities"), *[
        F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("critical", "high", "medium", "low")])
    return d.join(f, "project", "left").na.fill(0)
