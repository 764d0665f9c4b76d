"""Choosing files and findings: risk of a path, tiers, false-positive rules, candidate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import dims
from riskloom.functions import paths, severity, texts
from riskloom.functions.joins import growing
from riskloom.functions.severity import round_half_up
from riskloom.sources.rules import Rule, rules_frame

# Extensions and name parts that make a file more or less worth reading.
LOW_RISK_EXTENSIONS = ["md", "txt", "json", "yaml", "yml", "xml", "svg", "png", "jpg", "jpeg", "gif", "ico", "css",
                       "scss", "less", "lock", "gitignore", "dockerignore", "md5", "sha256", "log", "tmp", "bak"]
HIGH_RISK_EXTENSIONS = ["java", "py", "js", "ts", "tsx", "jsx", "php", "go", "rs", "rb", "cpp", "c", "cxx", "h", "hpp",
                        "cs", "vb", "asp", "aspx", "sql", "pl", "pm", "tpl"]
HIGH_RISK_NAMES = ["controller", "service", "handler", "api", "auth", "security", "login", "admin", "payment", "encrypt",
                   "decrypt", "config", "secret", "token", "session", "jdbc", "orm", "dto", "entity", "model"]
LOW_RISK_NAMES = ["test", "spec", "mock", "fixture", "sample", "example", "demo", "doc", "docs", "readme", "changelog",
                  "license"]
TIER_NAMES = {
    "T1": ["controller", "filter", "interceptor", "gateway", "securityconfig", "webconfig", "route", "router",
           "dispatchservlet", "dispatchfilter", "mvcconfig", "authfilter", "corsfilter", "ratelimitfilter"],
    "T2": ["service", "dao", "mapper", "repository", "util", "helper", "manager", "handler", "config", "properties",
           "application", "business", "core", "common"],
    "T3": ["entity", "dto", "vo", "pojo", "model", "domain", "bean", "object", "request", "response", "param"],
}
TIER_WEIGHTS = {"T1": 1.0, "T2": 0.5, "T3": 0.1}
MUST_PASS_TYPES = ["XSS", "OPEN_REDIRECT", "RACE_CONDITION", "FORMAT_STRING_VULNERABILITY", "FORMAT_STRING",
                   "SENSITIVE_INFO_IN_LOGS", "MISSING_ACCESS_CONTROL", "ARBITRARY_FILE_READ",
                   "PLAINTEXT_PASSWORD_TRANSMISSION", "PLAINTEXT_TRANSMISSION", "UNRESTRICTED_FILE_UPLOAD", "FILE_UPLOAD",
                   "INTEGER_OVERFLOW", "INSECURE_DESERIALIZATION", "UNRESTRICTED_UPLOAD", "CREDENTIAL_EXPOSURE",
                   "CORS_MISCONFIGURATION", "LOG_INJECTION", "TRUST_BOUNDARY_VIOLATION"]


def _in_directory(path: Column, names: list[str]) -> Column:
    return F.concat(F.lit("/"), F.lower(paths.directory(path)), F.lit("/")).rlike("/(?:" + "|".join(names) + ")/")


def file_risk(path: Column, skip_tests: bool = True, min_score: float = 0.6) -> Column:
    """struct(should_audit, reason, risk_score) of a path; a skipped file has no score."""
    name, folder = F.lower(paths.basename(path)), F.lower(paths.directory(path))
    reason = F.when(F.lower(paths.extension(path)).isin(LOW_RISK_EXTENSIONS), "low_risk_extension")
    if skip_tests:
        reason = (reason.when(texts.any_match(name, LOW_RISK_NAMES), "test_file")
                  .when(_in_directory(path, ["test", "tests", "spec"]), "test_directory"))
    reason = (reason.when(_in_directory(path, ["node_modules", "vendor", "dist", "build"]), "third_party_code")
              .when(_in_directory(path, ["docs", "documentation"]), "documentation"))
    score = (F.lit(0.5) + F.when(paths.extension(path).isin(HIGH_RISK_EXTENSIONS), 0.3).otherwise(0.0)
             + F.when(texts.any_match(name, HIGH_RISK_NAMES), 0.2).otherwise(0.0)
             + F.when(texts.any_match(folder, HIGH_RISK_NAMES), 0.1).otherwise(0.0))
    score = F.least(score, F.lit(0.95))
    return F.when(reason.isNotNull(), F.struct(
        F.lit(False).alias("should_audit"), reason.alias("reason"), F.lit(None).cast("double").alias("risk_score"))).otherwise(
        F.struct((score >= min_score).alias("should_audit"),
                 F.when(score >= 0.8, "high_risk").when(score >= 0.6, "medium_risk").otherwise("low_risk").alias("reason"),
                 score.alias("risk_score")))


def filter_files(files: DataFrame, skip_tests: bool = True, min_score: float = 0.6) -> DataFrame:
    """Files with should_audit, reason and risk_score, the riskiest first."""
    return (files.withColumn("_r", file_risk(F.col("path"), skip_tests, min_score)).select("*", "_r.*").drop("_r")
            .orderBy(F.col("should_audit").desc(), F.col("risk_score").desc_nulls_last(), "project", "path"))


def filter_stats(files: DataFrame, skip_tests: bool = True, min_score: float = 0.6) -> DataFrame:
    r = files.select(file_risk(F.col("path"), skip_tests, min_score).alias("r")).select("r.*")
    return r.agg(F.count("*").alias("total"), F.count(F.when(F.col("should_audit"), 1)).alias("to_audit"),
                 F.count(F.when(~F.col("should_audit"), 1)).alias("skipped"),
                 F.coalesce(round_half_up(F.avg(F.when(F.col("should_audit"), F.col("risk_score"))), 2), F.lit(0.0)).alias("avg_risk"))


def audit_time_estimate(files: DataFrame, per_file_ms: int = 3000, per_batch_ms: int = 1000, batch_size: int = 5,
                        skip_tests: bool = True, min_score: float = 0.6) -> DataFrame:
    s = filter_stats(files, skip_tests, min_score).withColumn("batches", F.ceil(F.col("to_audit") / batch_size))
    ms = F.col("to_audit") * per_file_ms + F.col("batches") * per_batch_ms
    return (s.withColumn("estimated_ms", ms).withColumn("estimated_seconds", round_half_up(F.col("estimated_ms") / 1000.0))
            .withColumn("estimated_minutes", round_half_up(F.col("estimated_ms") / 60000.0)))


def file_tier(path: Column) -> Column:
    name, folder = F.lower(paths.basename(path)), F.lower(paths.directory(path))
    tier = None
    for label, words in TIER_NAMES.items():
        hit = texts.any_match(name, words, False) | texts.any_match(folder, words, False)
        tier = F.when(hit, label) if tier is None else tier.when(hit, label)
    return tier.otherwise("T2")


def effective_loc(files: DataFrame, loc: Column | None = None, budget_per_agent: int = 15000) -> DataFrame:
    """Weighted lines per project (T1 full, T2 half, T3 a tenth) and the reviewers they need.

    `loc` counts one per file by default; give a line count to weigh lines.
    """
    size = loc if loc is not None else F.lit(1)
    tiers = files.select("project", file_tier(F.col("path")).alias("_t"), size.alias("_n"))
    sums = tiers.groupBy("project").agg(*[F.coalesce(F.sum(F.when(F.col("_t") == t, F.col("_n"))), F.lit(0)).alias(t.lower())
                                          for t in TIER_WEIGHTS])
    total = sum((F.col(t.lower()) * F.lit(w) for t, w in TIER_WEIGHTS.items()), F.lit(0.0))
    return sums.withColumn("effective_loc", F.ceil(total)).withColumn(
        "agents", F.ceil(F.col("effective_loc") / budget_per_agent))


def is_test_path(path: Column, variant: str = "directory") -> Column:
    """`directory`: a test-like directory or a .test. / .spec. / .mock. name; `name`: test or spec anywhere;
    `words`: any word of a test, sample or placeholder."""
    if variant == "directory":
        low = F.lower(F.coalesce(path, F.lit("")))
        return low.rlike(r"[\\/](test|tests|__tests__|spec|mock|fixture|example|sample|demo|stub|placeholder|dummy)[\\/]") | low.rlike(
            r"\.(test|spec|mock)\.")
    if variant == "name":
        return path.rlike(r"(?i)test|spec")
    return path.rlike(r"(?i)test|spec|mock|fixture|example|sample|demo|stub|placeholder|dummy")


# ------------------------------------------------------------------ false positives

# Why a finding is dropped, first match wins.
FRAMEWORK_PATHS = ["node_modules", "vendor", r"\.git", "dist", "build", "coverage", r"\.next", r"\.nuxt", "__pycache__"]
SAFE_CODE = [r"logger\.(error|warn|info|debug)", r"console\.(log|debug|info)", r"(?i:throw new Error.*test)", "(?i:skip)",
             "(?i:todo)", "(?i: FIXME )", "(?i: XXX )"]


def false_positive_rules(path: Column, code: Column, vuln_type: Column) -> Column:
    """struct(reason, confidence), null when no rule applies."""
    code = F.coalesce(code, F.lit(""))
    imports = code.rlike(r"""import\s+.*from\s+['"]|require\s*\(|using\s+.*;|include\s*<""") & ~code.contains("(")

    def why(reason, confidence):
        return F.struct(F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))

    return (F.when(path.rlike(r"(?i)test|spec|mock|fixture|example|demo|stub|placeholder|dummy"), why("test_file", 0.9))
            .when(texts.any_match(path, FRAMEWORK_PATHS, False), why("framework_code", 0.95))
            .when(texts.any_match(code, SAFE_CODE, False), why("safe_pattern", 0.8))
            .when(F.trim(code).rlike(r"^//|^/\*|^\*|#|<!--"), why("comment_line", 0.95))
            .when((F.coalesce(vuln_type, F.lit("")) != "") & imports, why("import_only", 0.85))
            .when(code.rlike(r"assert|expect|should\.be|should\.eq|jest\.fn|sinon"), why("test_assertion", 0.9)))


def heuristic_fp_filter(findings: DataFrame, min_confidence: float = 0.5, custom: list[str] | None = None,
                        path: str = "file", context: str = "context") -> DataFrame:
    """Drops weak findings, test files, and hits on or near test-like or excluded lines.

    `context` is array<struct<line,content,is_target>>; findings without context or match are kept.
    """
    from riskloom.operators.scan import TEST_LINE

    usable = F.col(context).isNotNull() & F.col("match").isNotNull()
    target = F.try_element_at(F.filter(context, lambda c: c["is_target"]), F.lit(1))["content"]
    around = F.array_join(F.transform(context, lambda c: c["content"]), " ")
    noisy = texts.any_match(around, TEST_LINE)
    if custom:
        noisy = noisy | texts.any_match(F.lower(target), custom)
    drop = usable & (is_test_path(F.col(path), "name") | (target.isNotNull() & noisy))
    return findings.where((F.col("confidence") >= min_confidence) & ~F.coalesce(drop, F.lit(False)))


# Titles that say that nothing was found.
EMPTY_TITLES = ["no direct vulnerability", "no executable code", "reviewed and passed", "no vulnerability found",
                "no security issue", "safe implementation"]


def title_fp_filter(df: DataFrame) -> DataFrame:
    return df.where(~texts.any_match(F.coalesce("title", F.lit("")), EMPTY_TITLES))


def confidence_filter(df: DataFrame, threshold: float) -> DataFrame:
    """Usual thresholds: 0.4 after merging, 0.5 for rules, 0.55 for reviewer output."""
    return df.where(F.col("confidence") >= threshold)


def type_supported(vuln_type: Column, language: Column) -> Column:
    """Is the type expected in the language? Unknown languages and missing values pass."""
    expected = dims.lookup({}, language) if not dims.TYPES_BY_LANGUAGE else F.try_element_at(
        F.create_map(*[x for k, v in dims.TYPES_BY_LANGUAGE.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v.split()]))]),
        language)
    upper = F.upper(vuln_type)
    ok = F.exists(expected, lambda t: upper.contains(t))
    return F.when((F.coalesce(vuln_type, F.lit("")) == "") | (F.coalesce(language, F.lit("")) == "") | expected.isNull(),
                  F.lit(True)).otherwise(ok)


def finding_issues(df: DataFrame) -> DataFrame:
    """Schema problems of a finding, whether it is valid, and whether one can act on it."""
    parts = F.split(F.coalesce("location", F.lit("")), ":")
    second = F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    missing = F.coalesce("location", F.lit("")) == ""
    issues = F.array_compact(F.array(
        F.when(missing, "missing_location"),
        F.when(~missing & (F.element_at(parts, 1) == ""), "invalid_location_format"),
        F.when(~missing & (F.size(parts) == 2) & ~second.rlike("[0-9]"), "invalid_line_number"),
        F.when(F.length(F.coalesce("evidence", F.lit(""))) < 20, "evidence_too_short"),
        F.when(F.length(F.coalesce("remediation", F.lit(""))) < 15, "remediation_too_short"),
        F.when(F.coalesce("confidence", F.lit(0.0)) < 0.3, "low_confidence"),
        F.when(~F.lower(F.coalesce("severity", F.lit(""))).isin("critical", "high", "medium", "low", "info"), "invalid_severity")))
    return (df.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)
            .withColumn("is_actionable", F.size(F.array_remove("issues", "low_confidence")) == 0))


# What a remediation text must not say and should say.
VAGUE_ADVICE = ["fix the vulnerability", "improve security", "pay attention to security", "strengthen validation",
                "be careful", "修复漏洞", "加强安全", "注意安全", "建议修复"]
ACTION_VERBS = ["use", "replace", "remove", "validate", "encode", "escape", "disable", "enable", "configure", "upgrade",
                "restrict", "使用", "替换", "移除", "添加", "禁用", "升级", "配置"]
CONCRETE_API = r"[A-Za-z_]\w*\s*\(|[A-Za-z_]\w*\.[A-Za-z_]\w+|[A-Z][a-z]+[A-Z]\w*|\d+\.\d+"


def remediation_quality(col: Column, min_length: int = 30) -> Column:
    text = F.coalesce(col, F.lit(""))
    vague, action = texts.any_match(text, VAGUE_ADVICE), texts.any_match(text, ACTION_VERBS)
    concrete = text.rlike(CONCRETE_API)
    return F.struct(vague.alias("is_vague"), (F.length(text) >= min_length).alias("long_enough"), action.alias("has_action"),
                    concrete.alias("has_api"), (~vague & (F.length(text) >= min_length) & action & concrete).alias("is_good"))


def incremental_skip(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Why a changed file need not be scanned again, or null.

    changes(project, path, changed_lines array<int>, only_whitespace boolean); files without a row are not judged.
    """
    df = files.join(growing(changes), ["project", "path"], "left")
    lines = texts.lines_of(F.col("content"))
    inside = F.filter("changed_lines", lambda n: (n > 0) & (n <= F.size(lines)))
    visible = F.exists(inside, lambda n: F.trim(F.element_at(lines, n)) != "")
    return df.withColumn("skip_reason", F.when(F.col("changed_lines").isNull(), None)
                         .when(F.size(inside) == 0, "no changed lines in file")
                         .when(F.coalesce("only_whitespace", F.lit(False)) & ~visible, "only whitespace changes"))


def changed_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """changes(project, path, changed_lines, only_whitespace) between two versions, line by line in place."""
    a = old.select("project", "path", F.split("content", "\n", -1).alias("_a"))
    b = new.select("project", "path", F.split("content", "\n", -1).alias("_b"))
    both = b.join(growing(a), ["project", "path"]).withColumn("_n", F.greatest(F.size("_a"), F.size("_b")))

    def at(arr, i):
        return F.try_element_at(arr, i)

    differ = F.filter(F.sequence(F.lit(1), F.col("_n")), lambda i: ~at(F.col("_a"), i).eqNullSafe(at(F.col("_b"), i)))
    squeezed = F.regexp_replace(F.array_join("_a", "\n"), r"\s+", "") == F.regexp_replace(F.array_join("_b", "\n"), r"\s+", "")
    return both.select("project", "path", differ.alias("changed_lines"), squeezed.alias("only_whitespace"))


def rules_by(rules: DataFrame | list[Rule], spark=None, profile: str | None = None, guideline: tuple[str, str] | None = None,
             labels: list[str] | None = None) -> DataFrame:
    """Rules of a profile, with a guideline such as ("cwe", "89"), or with any of some `key:value` labels."""
    df = rules_frame(spark, rules) if isinstance(rules, list) else rules
    own = F.array_distinct(F.concat(
        F.array(F.concat(F.lit("severity:"), F.lower("severity")), F.concat(F.lit("category:"), F.lower("category"))),
        F.transform("profiles", lambda p: F.concat(F.lit("profile:"), F.lower(p))),
        F.flatten(F.transform(F.map_entries("guidelines"), lambda e: F.transform(
            e["value"], lambda v: F.concat(F.lower(e["key"]), F.lit(":"), F.lower(v)))))))
    if profile:
        df = df.where(F.array_contains("profiles", profile.lower()))
    if guideline:
        df = df.where(F.array_contains(F.coalesce(F.try_element_at("guidelines", F.lit(guideline[0].lower())),
                                                  F.array().cast("array<string>")), guideline[1]))
    if labels:
        wanted = F.array(*[F.lit(x.lower()) for x in labels])
        df = df.withColumn("matched_labels", F.array_intersect(own, wanted)).where(F.size("matched_labels") > 0)
    return df


# ------------------------------------------------------------------ candidate score

def severity_points(col: Column) -> Column:
    return severity.severity_weight(col)


def candidate_score(profile: Column, severity_: Column, evidence: Column, location: Column) -> Column:
    """Severity * 5, plus signals in the evidence, plus 8 for a sensitive word in the location."""
    from riskloom.operators.hints import hint_score

    has_in, has_sink = profile["input_count"] > 0, profile["sink_count"] > 0
    guarded = (profile["validation_count"] > 0) | (profile["safety_count"] > 0)
    signals = (hint_score(profile) + F.when(has_in, 25).otherwise(0) + F.when(has_sink, 35).otherwise(0)
               + F.when(has_in & has_sink, 200).otherwise(0) + F.when(has_in & has_sink & ~guarded, 150).otherwise(0))
    sensitive = F.coalesce(location, F.lit("")).rlike(
        r"(?i)\b(api|auth|admin|login|upload|download|user|password|token|secret)\b")
    return (severity_points(severity_) * 5 + F.when(F.coalesce(evidence, F.lit("")) != "", signals).otherwise(0)
            + F.when(sensitive, 8).otherwise(0))


def language_extension(language: Column) -> Column:
    return dims.lookup({"python": "py", "javascript": "js", "typescript": "ts", "java": "java", "go": "go", "golang": "go",
                        "php": "php", "csharp": "cs", "c#": "cs", "cpp": "cpp", "c++": "cpp", "c": "c"}, language, "")


def candidate_priority(score: Column) -> Column:
    return F.when(score >= 50, "high").when(score >= 20, "medium").otherwise("low")


def candidate_filter(df: DataFrame, mode: str = "strict", threshold: int = 12, evidence: str = "evidence",
                     language: str = "language", location: str = "location") -> DataFrame:
    """Findings with score, priority and passed.

    strict: the score reaches the threshold. lenient: high always passes, medium from the threshold.
    Types that must be looked at always pass.
    """
    from riskloom.operators.hints import hint_profile

    def col(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    # a column of its own, so that each signal is tested once
    out = df.withColumn("_hints", hint_profile(F.coalesce(col(evidence), F.lit("")), language_extension(col(language))))
    out = out.withColumn("audit_score", candidate_score(F.col("_hints"), F.col("severity"), col(evidence), col(location)))
    out = out.withColumn("audit_priority", candidate_priority(F.col("audit_score"))).drop("_hints")
    must = F.coalesce(F.col("vuln_type").isin(MUST_PASS_TYPES), F.lit(False)) if "vuln_type" in df.columns else F.lit(False)
    if mode == "strict":
        ok = F.col("audit_score") >= threshold
    else:
        ok = (F.col("audit_priority") == "high") | ((F.col("audit_priority") == "medium") & (F.col("audit_score") >= threshold))
    return out.withColumn("passed", ok | must)
