"""Missing fields of findings filled from dimension tables, and findings read from reviewer text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom import dims
from riskloom.functions import paths, severity
from riskloom.functions.ranking import first_per
from riskloom.operators.merge import normalize_type

BLANK_CWE, BLANK_OWASP = ["", "CWE-000", "unknown", "undefined"], ["", "unknown", "undefined", "无", "none"]


def _or_null(df, name, blanks, cast="string"):
    if name not in df.columns:
        return F.lit(None).cast(cast)
    return F.when(~F.coalesce(F.col(name), F.lit("")).isin(blanks), F.col(name))


def enrich_findings(findings: DataFrame, gbt: dict | None = None) -> DataFrame:
    """Canonical type, CWE, OWASP, language, GB/T clause, CVSS and a default remediation.

    Every dimension is a fixed or configured table of a few hundred rows and is broadcast.
    """
    spark = findings.sparkSession
    df = normalize_type(findings, "enrich", out="_type").withColumn("vuln_type", F.col("_type")).drop("_type")
    types = dims.type_dim(spark).select("vuln_type", "owasp_id", "type_cwe")
    df = df.join(F.broadcast(types), "vuln_type", "left")
    df = df.withColumn("cwe", F.coalesce(_or_null(findings, "cwe", BLANK_CWE), "type_cwe", F.lit("")))
    df = df.withColumn("owasp", F.coalesce(_or_null(findings, "owasp", BLANK_OWASP), "owasp_id", F.lit("")))
    place = F.col("file") if "file" in findings.columns else F.element_at(F.split("location", ":"), 1)
    df = df.withColumn("language", F.coalesce(_or_null(findings, "language", BLANK_CWE), paths.detect_language(place)))
    clauses = dims.gbt_dim(spark, gbt)
    exact = clauses.where("language <> 'default'").withColumnRenamed("gbt", "_g1")
    default = clauses.where("language = 'default'").select("vuln_type", F.col("gbt").alias("_g2"))
    df = df.join(F.broadcast(exact), ["vuln_type", "language"], "left").join(F.broadcast(default), "vuln_type", "left")
    df = df.withColumn("gbt", F.coalesce(_or_null(findings, "gbt", BLANK_OWASP + [dims.GBT_BASELINE]), "_g1", "_g2", F.lit(dims.GBT_BASELINE)))
    known = F.when(F.col("cvss") > 0, F.col("cvss")) if "cvss" in findings.columns else F.lit(None).cast("double")
    df = df.withColumn("cvss", F.coalesce(known, dims.lookup(severity.CVSS_BY_SEVERITY, F.col("severity"), 5.0)))
    urgency = F.when(F.lower("severity") == "critical", "Fix now: harden ").when(F.lower("severity") == "high", "Fix soon: harden ").otherwise(
        "Plan a fix: harden ")
    text = F.concat(urgency, F.coalesce(F.nullif("vuln_type", F.lit("")), F.lit("this finding")),
                    F.lit(" with input validation, bound parameters or an allow list"))
    given = F.nullif(F.trim("remediation"), F.lit("")) if "remediation" in findings.columns else F.lit(None).cast("string")
    return df.withColumn("remediation", F.coalesce(given, text)).drop("owasp_id", "type_cwe", "_g1", "_g2")


def fix_location(findings: DataFrame, files: DataFrame) -> DataFrame:
    """A bare file name in `location` becomes the project's path of that name (the greatest among equals)."""
    known = files.groupBy("project", F.lower(paths.basename(F.col("path"))).alias("_name")).agg(F.max("path").alias("_full"))
    bare = ~F.coalesce("location", F.lit("")).contains("/")
    df = findings.withColumn("_name", F.when(bare, F.lower(F.element_at(F.split("location", ":"), 1))))
    suffix = F.regexp_extract("location", r"^[^:]*(:.*)$", 1)
    return df.join(known, ["project", "_name"], "left").withColumn(
        "location", F.when(F.col("_full").isNotNull(), F.concat("_full", suffix)).otherwise(F.col("location"))).select(*findings.columns)


# Words of a table head, of a table row that reports something, and of a sentence that does.
HEAD_WORDS = ["文件", "端点", "问题", "漏洞", "发现"]
ROW_WORDS = ["漏洞", "注入", "绕过", "泄露", "风险", "越权", "遍历"]
SENTENCE_WORDS = ["漏洞", "注入", "绕过", "泄露", "遍历", "越权", "篡改", "伪造", "命令执行", "RCE", "XSS", "SSRF", "SQL", "DESERIALIZATION"]


def findings_from_text(df: DataFrame, key: str = "doc_id", text: str = "text", head_words: list[str] = HEAD_WORDS,
                       row_words: list[str] = ROW_WORDS, sentence_words: list[str] = SENTENCE_WORDS) -> DataFrame:
    """Findings from reviewer prose: rows of a Markdown table under a matching head, else `File.ext: description` sentences.

    Confidence 0.55. Duplicates by location and the first 30 characters of the title are dropped per text.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw")).withColumn("raw", F.trim("raw"))
    lines = lines.withColumn("is_row", F.col("raw").startswith("|") & F.col("raw").endswith("|") & (F.length("raw") > 1))
    w = W.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("block", F.sum(F.when(F.col("is_row"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    is_head = F.col("is_row") & F.lower("raw").rlike("|".join(head_words))
    lines = lines.withColumn("head", F.min(F.when(is_head, F.col("pos"))).over(W.partitionBy(key, "block")))
    cells = F.filter(F.transform(F.split("raw", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = lines.where(F.col("is_row") & (F.col("pos") > F.col("head"))).withColumn("c", cells).where(
        (F.size("c") >= 2) & ~F.element_at("c", 1).contains("---") & F.lower(F.element_at("c", -1)).rlike("|".join(row_words)))
    place = F.element_at("c", 1)
    table = rows.select(key, "pos", F.when(place.contains("."), place).otherwise(F.concat(place, F.lit(":?"))).alias("location"), F.element_at("c", -1).alias("description"))
    pattern = r"""(?i)([a-zA-Z_][a-zA-Z0-9_]*\.(?:java|py|js|ts|php|rb|cpp|c|cs|go|rs))['":\s]+([^。\n]{10,})"""
    loose = df.select(key, F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("l"),
                                                     F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("d"))).alias("pos", "m"))
    loose = loose.select(key, "pos", F.concat("m.l", F.lit(":?")).alias("location"), F.trim("m.d").alias("description")).where(
        F.col("description").rlike("(?i)" + "|".join(sentence_words)) & (F.length("description") > 10))
    both = table.unionByName(loose.join(table.select(key).distinct(), key, "left_anti"))
    titled = both.withColumn("title", F.when(F.length("description") > 120, F.concat(F.left("description", F.lit(120)), F.lit("..."))).otherwise(
        F.col("description"))).withColumn("_start", F.left("title", F.lit(30)))
    one = first_per(titled, [key, "location", "_start"], ["pos"]).drop("_start")
    return one.select(key, "location", "title", F.col("description").alias("evidence"), F.lit("medium").alias("severity"),
                      F.lit(0.55).alias("confidence"), F.lit("llm").alias("source"))


FINDING_JSON = ("findings array<struct<title:string,severity:string,location:string,vulnType:string,confidence:string,cwe:string,"
                "evidence:string,remediation:string,cvssScore:string>>, _corrupt string")


def parse_finding_json(df: DataFrame, key: str = "doc_id", text: str = "text", min_confidence: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """(findings, texts that hold no readable JSON). Fenced or embedded objects are found; broken JSON is not repaired."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.coalesce(F.nullif(fenced, F.lit("")), F.col(text))
    obj = F.regexp_extract(body, r'(?s)\{.*"findings".*\}', 0)
    parsed = df.withColumn("_j", F.from_json(obj, FINDING_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = parsed.where((obj == "") | F.col("_j").isNull() | F.col("_j._corrupt").isNotNull() | F.col("_j.findings").isNull()).select(key, F.col(text))
    rows = parsed.where(F.col("_j._corrupt").isNull()).select(key, F.posexplode("_j.findings").alias("ord", "f"))
    out = rows.select(
        key, "ord", severity.safe_string(F.col("f.title"), "Reviewer finding").alias("title"), severity.severity_map(F.col("f.severity")).alias("severity"),
        severity.safe_string(F.col("f.location"), "n/a").alias("location"), F.col("f.vulnType").alias("vuln_type"),
        severity.clamp_confidence(F.col("f.confidence")).alias("confidence"), severity.safe_string(F.col("f.cwe"), "").alias("cwe"),
        severity.safe_string(F.col("f.evidence"), "Reported by review; confirm by hand.").alias("evidence"),
        severity.safe_string(F.col("f.remediation"), "Check permissions and defaults on the server side.").alias("remediation"),
        severity.clamp_cvss(F.col("f.cvssScore")).alias("cvss"), F.lit("llm").alias("source"))
    return normalize_type(out, "review").drop("vuln_type").withColumnRenamed("canonical_type", "vuln_type").where(
        F.col("confidence") >= min_confidence), bad
