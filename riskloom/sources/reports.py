"""Reports of external scanners as findings. The scanners themselves are not run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.dims import lookup
from riskloom.functions import paths

SCHEMAS = {
    "gitleaks": "RuleID string, File string, StartLine int, Secret string, Match string, Commit string, Author string",
    "bandit": ("results array<struct<test_id:string,test_name:string,issue_text:string,issue_severity:string,"
               "issue_confidence:string,issue_cwe:struct<id:string>,filename:string,line_number:int,more_info:string,code:string>>"),
    "semgrep": ("results array<struct<check_id:string,path:string,start:struct<line:int>,message:string,severity:string,"
                "fix:string,extra:struct<lines:string>>>"),
}
CVSS = {"high": 8.5, "medium": 5.5, "low": 3.0}
INPUT_CLAUSE = "GB/T39412-6.1.1.1"
SECRET_CLAUSE = "GB/T39412-6.1.1.10"

# Bandit test -> finding type.
BANDIT_TYPES = {
    "B101": "ASSERT_STATEMENT", "B102": "EXEC_STATEMENT", "B103": "INSECURE_FILE_PERMISSIONS", "B104": "HARDCODED_BIND_ADDRESS",
    "B105": "HARD_CODED_PASSWORD", "B106": "HARD_CODED_PASSWORD", "B107": "HARD_CODED_PASSWORD", "B108": "INSECURE_TEMP_FILE",
    "B109": "HARD_CODED_PASSWORD", "B110": "EXCEPT_PASS", "B111": "EXCEPT_PASS", "B112": "EXCEPT_PASS",
    "B113": "REQUEST_WITHOUT_TIMEOUT", "B201": "FLASK_DEBUG_TRUE", "B301": "INSECURE_UNPICKLE", "B302": "INSECURE_MARSHAL",
    "B303": "WEAK_CRYPTO_MD5", "B304": "WEAK_CRYPTO_CIPHER", "B305": "WEAK_CRYPTO_CIPHER", "B306": "INSECURE_HASH_SHA1",
    "B307": "DANGEROUS_EVAL", "B308": "INSECURE_YAML_LOAD", "B310": "INSECURE_URL_OPEN", "B311": "WEAK_RANDOM",
    "B312": "TELNET_USAGE", **{f"B{n}": "WEAK_CRYPTO_XML" for n in range(313, 321)}, "B321": "FTP_USAGE",
    "B322": "BUILTIN_OPEN", "B323": "UNSAFE_XSLT", "B324": "WEAK_HASH", **{f"B{n}": "INSECURE_IMPORT" for n in range(401, 415)},
    "B501": "REQUEST_WITHOUT_TIMEOUT", "B502": "SSL_INSECURE", "B503": "SSL_WEAK", "B504": "SSL_WEAK", "B505": "WEAK_CRYPTO_DSA",
    "B506": "INSECURE_YAML_LOAD", "B507": "SSH_NO_HOST_VERIFY", "B508": "SSH_NO_HOST_VERIFY", "B509": "WEAK_CRYPTO",
    "B601": "PARAMETERIZED_COMMAND", "B602": "SUBPROCESS_SHELL_TRUE", "B603": "SUBPROCESS_WITHOUT_SHELL",
    "B604": "ANY_INSECURE_FUNCTION", "B605": "OS_STARTFILE_WITH_SHELL", "B606": "START_PROCESS_WITH_SHELL",
    "B607": "START_PROCESS_WITH_PARTIAL_PATH", "B608": "HARDCODED_SQL", "B609": "LINUX_COMMAND_WILDCARD_INJECTION",
    "B610": "DJANGO_EXTRA", "B611": "DJANGO_RAW_SQL", "B701": "JINJA2_AUTOESCAPE_DISABLED", "B702": "TARFILE_UNSAFE_EXTRACTION",
    "B703": "MARKUPSAFE_UNSAFE",
}
# Words in a Semgrep check id -> finding type, first match wins.
SEMGREP_TYPES = [(["sql"], "SQL_INJECTION"), (["xss"], "XSS"), (["command", "exec"], "COMMAND_INJECTION"),
                 (["path"], "PATH_TRAVERSAL"), (["secret", "credential"], "HARD_CODED_SECRET"),
                 (["crypto", "encryption"], "WEAK_CRYPTO"), (["deserial"], "DESERIALIZATION"), (["ssrf"], "SSRF"), (["xxe"], "XXE")]


def read_tool_report(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """Report items; one JSON document per file."""
    raw = spark.read.schema(SCHEMAS[tool]).option("multiLine", True).json(path)
    return raw if tool == "gitleaks" else raw.select(F.explode("results").alias("r")).select("r.*")


def _common(project: Column, tool: str, vuln_id, title, sev, conf, file, line, vtype, cwe, language, gbt, cvss, evidence, advice, code):
    return [project.alias("project"), F.lit("external_tool").alias("source"), F.lit(tool).alias("tool"),
            F.lit("tool-import").alias("skill_id"), vuln_id.alias("rule_id"), title.alias("title"), sev.alias("severity"),
            F.lit(conf).alias("confidence"), file.alias("file"), line.alias("line"), F.concat_ws(":", file, line).alias("location"),
            vtype.alias("vuln_type"), cwe.alias("cwe"), language.alias("language"), F.lit(gbt).alias("gbt"), cvss.alias("cvss"),
            evidence.alias("evidence"), advice.alias("remediation"), code.alias("snippet"), F.lit("open").alias("status")]


def import_tool_findings(items: DataFrame, tool: str, project: Column | None = None) -> DataFrame:
    """Items of a Gitleaks, Bandit or Semgrep report as findings, with confidence 0.9, 0.85 and 0.85."""
    project = project if project is not None else (F.col("project") if "project" in items.columns else F.lit("default"))

    def clean(c):
        return F.replace(F.regexp_replace(c, r"^\./", ""), F.lit("\\"), F.lit("/"))

    if tool == "gitleaks":
        file, line = clean(F.col("File")), F.col("StartLine")
        cols = _common(project, tool, F.col("RuleID"), F.concat(F.lit("Secret found: "), F.col("RuleID")), F.lit("high"), 0.9, file, line,
                       F.lit("HARD_CODED_SECRET"), F.lit("CWE-798"), F.lit("unknown"), SECRET_CLAUSE, F.lit(8.5),
                       F.concat(F.lit("Secret of kind "), F.col("RuleID"), F.lit(" at "), file, F.lit(":"), line),
                       F.lit("Remove the secret from the code and read it from a key management service."),
                       F.coalesce(F.nullif("Secret", F.lit("")), F.col("Match")))
    elif tool == "bandit":
        sev = lookup({"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}, F.col("issue_severity"), "medium")
        file, line = clean(F.col("filename")), F.col("line_number")
        cwe_id = F.col("issue_cwe.id")
        cols = _common(project, tool, F.col("test_id"), F.col("issue_text"), sev, 0.85, file, line,
                       lookup(BANDIT_TYPES, F.col("test_id"), "UNKNOWN"),
                       F.when(cwe_id.isNull() | (cwe_id == ""), "CWE-unknown").when(cwe_id.startswith("CWE-"), cwe_id).otherwise(
                           F.concat(F.lit("CWE-"), cwe_id)),
                       F.lit("python"), INPUT_CLAUSE, lookup(CVSS, sev, 5.0),
                       F.concat(F.col("issue_text"), F.lit(" at "), file, F.lit(":"), line),
                       F.concat(F.lit("See "), F.coalesce("more_info", F.lit("the secure coding guide"))), F.coalesce("code", F.lit("")))
    elif tool == "semgrep":
        sev = lookup({"ERROR": "high", "WARNING": "medium", "INFO": "low"}, F.col("severity"), "medium")
        low = F.lower("check_id")
        vtype = F.lit("UNKNOWN")
        for words, name in reversed(SEMGREP_TYPES):
            hit = F.lit(False)
            for w in words:
                hit = hit | low.contains(w)
            vtype = F.when(hit, name).otherwise(vtype)
        file, line = clean(F.col("path")), F.col("start.line")
        cwe = F.regexp_extract("message", r"CWE-\d+", 0)
        cols = _common(project, tool, F.col("check_id"), F.col("message"), sev, 0.85, file, line, vtype,
                       F.when(cwe == "", "CWE-unknown").otherwise(cwe), paths.detect_language(file), INPUT_CLAUSE,
                       lookup(CVSS, sev, 5.0), F.concat(F.col("message"), F.lit(" at "), file, F.lit(":"), line),
                       F.coalesce("fix", F.lit("See the secure coding guide")), F.coalesce("extra.lines", F.lit("")))
    else:
        raise ValueError(f"unknown tool {tool!r}; known: {sorted(SCHEMAS)}")
    return items.select(*cols)
