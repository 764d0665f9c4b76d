"""What the lines around a finding say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import paths, texts
from riskloom.functions.durable import durable
from riskloom.functions.joins import growing
from riskloom.operators.dedup import file_of, line_of
from riskloom.operators.filters import is_test_path
from riskloom.operators.scan import if_any, scan_rules
from riskloom.sources.rules import Rule

# Code that guards against a type of finding. (?i:...) marks those that ignore case.
GUARDS = {
    "COMMAND_INJECTION": [r'"[^"]*"\s*\+?\s*"[^"]*"', r"Array\.(from|of|isArray)"],
    "SQL_INJECTION": [r"PreparedStatement|prepareStatement|createQuery\s*\([^)]*\.class", r"\?[\s,)]",
                      r"setParameter|setString|setInt|setLong", r"NamedParameterJdbcTemplate|JdbcTemplate\s*\(\s*dataSource"],
    "CODE_INJECTION": [r"(?i:\.replace\s*\(.*pattern)", r"\.sanitize|\.escape|htmlspecialchars|strip_tags", r"JSON\.parse\s*\("],
    "XSS": [r"\.textContent\s*=|\.innerText\s*=", r"\.replace\s*\(.*<[^>]*>", r"escapeHtml|sanitizeHtml|DOMPurify|xss-filters",
            r"text/plain|Content-Security-Policy"],
    "PATH_TRAVERSAL": [r"\.normalize\s*\(", r"\.resolve\s*\(", r"(?i:path\.join\s*\()",
                       r"SecurityManager|AccessController\.checkPermission", r"basename\s*\(|(?i:path\.basename)"],
    "DESERIALIZATION": [r"ValidatingObjectInputStream|LookAheadObjectInputStream", r"resolveClass\s*\(",
                        r"setAcceptClasses|setRejectClasses|setAllowedTypes", r"ObjectInputFilter|serialFilter|jdk\.serialFilter",
                        r"useSafeClasses|safeDeserialization|enableSafeMode"],
    "SSRF": [r"ALLOWED_HOSTS|ALLOWED_DOMAINS|whitelist|blocklist",
             r"""\.startsWith\s*\(\s*['"]/api/|\.includes\s*\(\s*['"]/internal""", r"isSafeUrl|validateUrl|checkHost|isInternal",
             r"InetAddress\.getByName|isLoopbackAddress|isSiteLocalAddress"],
    "HARD_CODE_PASSWORD": [r"process\.env\.|os\.environ|System\.getenv|getenv\s*\(",
                           r"config\[|config\.get\s*\(|getConfig\s*\(|\.env\.",
                           r"keyVault|secretManager|vault|credentialsFromFile", r'@Value\s*\(\s*"\$\{'],
    "XXE": [r"setFeature\s*\(.*disallow-doctype|setFeature\s*\(.*external-general-entities",
            r"setFeature\s*\(.*external-parameter-entities|setFeature\s*\(.*load-external-dtd",
            r"XMLConstants\.FEATURE_SECURE_PROCESSING", r"setExpandEntityReferences\s*\(\s*false"],
    "CORS_MISCONFIGURATION": [r"ALLOWED_ORIGINS|allowedOrigins|CORS_ORIGIN_WHITELIST",
                              r"originWhitelist|corsWhitelist|corsAllowedOrigins",
                              r'@CrossOrigin\s*\(\s*origins\s*=\s*"[^"]+"', r"corsConfigurationSource\s*\("],
}
GUARD_LINES = 5
SAMPLE_PATH = (r"(?i)(vulnerable|exploit|insecure|unsafe|deliberate|intentional)_?"
               r"(code|sample|app|file|python|java|cpp|csharp|cs|dotnet)")


def by_type(vuln_type: Column, tests: dict[str, Column], default: Column | None = None) -> Column:
    chain = None
    for name, test in tests.items():
        chain = F.when(vuln_type == name, test) if chain is None else chain.when(vuln_type == name, test)
    return chain.otherwise(F.lit(False) if default is None else default)


def with_source_lines(findings: DataFrame, files: DataFrame, how: str = "left") -> DataFrame:
    """Findings with their file's lines, null when the file is unknown. One co-partitioned join on (project, file)."""
    keyed = findings.withColumn("_file", file_of(findings)).withColumn("_line", line_of(findings))
    keys = ["project"] if "project" in findings.columns and "project" in files.columns else []
    texts_ = files.select(*keys, F.col("path").alias("_file"), texts.lines_of(F.col("content")).alias("_lines"))
    return keyed.join(growing(texts_), keys + ["_file"], how)


def with_windows(findings: DataFrame, files: DataFrame, around: int) -> DataFrame:
    """Findings with up to `around` lines on both sides (`_around`, the first is line `_from`), null when the file is unknown.

    The lines asked of a file are gathered first (numbers only), so that each text meets one row and gives narrow windows;
    no row holds a text beside a finding. `_at` is the finding's line, 1 at least. The findings are worked out once and kept:
    both joins read them, and a scan of texts may stand behind them.
    """
    keyed = durable(findings.withColumn("_file", file_of(findings)).withColumn("_line", line_of(findings)).withColumn(
        "_at", F.greatest(F.col("_line"), F.lit(1))))
    keys = (["project"] if "project" in findings.columns and "project" in files.columns else []) + ["_file"]
    asked = keyed.groupBy(*keys).agg(F.collect_set("_at").alias("_ats"))
    whole = files.withColumn("_file", F.col("path")).select(*keys, "content").join(growing(asked), keys)
    rows = whole.select(*keys, "_ats", if_any(texts.lines_of(F.col("content"))).alias("_lines"))
    windows = rows.select(*keys, F.explode(F.transform("_ats", lambda a: F.struct(
        a.alias("_at"), F.greatest(a - around, F.lit(1)).alias("_from"),
        texts.line_window(F.col("_lines"), a, around, around).alias("_around")))).alias("w")).select(*keys, "w.*")
    return keyed.join(growing(windows), [*keys, "_at"], "left")


def guard_context(findings: DataFrame, files: DataFrame, snippet: bool = False) -> DataFrame:
    """`guard` struct and a confidence lowered by literals and guards within five lines, or by a test path.

    With `snippet` the lines around the finding come along, from the same join.
    """
    df = with_windows(findings, files, GUARD_LINES)
    if snippet:
        df = df.withColumn("snippet", texts.snippet(F.col("_at")))
    line = F.trim(F.coalesce(texts.near_line(F.col("_at")), F.lit("")))
    window = texts.near_text(F.col("_at"), GUARD_LINES, GUARD_LINES)
    literal = line.rlike(r"""^["'][^"'{}]*["']\s*$""") | line.rlike(r"""^\s*\w+\s*\(\s*["'][^"']*["']\s*\)\s*$""")
    guarded = by_type(F.col("vuln_type"), {t: texts.any_match(window, p, False) for t, p in GUARDS.items()})
    test = is_test_path(F.col("_file"), "directory")
    checked = (~test & ~F.col("_file").rlike(SAMPLE_PATH) & (F.col("_file") != "") & (F.col("_line") >= 1)
               & texts.near_line(F.col("_at")).isNotNull())
    limit = (F.when(F.col("_lit") & F.col("_grd"), 0.1).when(F.col("_lit"), 0.2).when(F.col("_grd"), 0.3).otherwise(1.0))
    notes = F.array_compact(F.array(
        F.when(F.col("_lit"), "argument_appears_to_be_string_literal"), F.when(F.col("_grd"), "security_guard_pattern_detected"),
        F.when(F.col("_lit") & ~F.col("_grd"), "probably_false_positive_string_arg"),
        F.when(F.col("_grd") & ~F.col("_lit"), "mitigated_by_guard"), F.when(F.col("_grd") & F.col("_lit"), "doubly_mitigated")))

    def guard(lit, grd, is_test, confidence, texts_):
        return F.struct(lit.alias("has_string_literal_arg"), grd.alias("has_guard_pattern"), F.lit(is_test).alias("is_test_file"),
                        confidence.alias("confidence"), texts_.alias("notes"))

    no = F.lit(False)
    df = df.withColumn("_test", test).withColumn("_checked", F.coalesce(checked, no))
    df = df.withColumn("_lit", F.col("_checked") & literal).withColumn("_grd", F.col("_checked") & guarded)
    given = F.coalesce(F.col("confidence"), F.lit(0.8)) if "confidence" in df.columns else F.lit(0.8)
    kept = F.col("confidence") if "confidence" in df.columns else F.lit(None).cast("double")
    df = df.withColumn("guard", F.when(F.col("_test"), guard(no, no, True, F.lit(0.15), F.array(F.lit("test_or_mock_file"))))
                       .when(F.col("_checked"), guard(F.col("_lit"), F.col("_grd"), False, limit, notes)))
    df = df.withColumn("confidence", F.when(F.col("_test"), F.least(given, F.lit(0.15)))
                       .when(F.col("_checked"), F.least(given, limit)).otherwise(kept))
    return df.drop("_file", "_line", "_at", "_around", "_from", "_test", "_checked", "_lit", "_grd")


# Signals looked for near a finding. (?i:...) marks those that ignore case.
SIGNALS = {
    "user_input": [r"\b(req|request|params|query|body|headers|cookies)\b", r"\b(input|userInput|formData)\b",
                   r"\b(getPost|getQuery|getParam)\b", r"\$_(GET|POST|REQUEST|COOKIES)"],
    "validation": [r"(?i:\b(validate|sanitize|escape|encode|decode|clean)\b)", r"(?i:\b(check|verify|assert)\b)",
                   r"(?i:\b(regex|pattern|match)\b)", r"(?i:\b(whitelist|blacklist|allowlist|blocklist)\b)"],
    "encoding": [r"\b(encodeURI|encodeURIComponent|escape|htmlEncode|entityEncode)\b", r"\b(btoa|Buffer\.from.*base64)\b"],
    "parameterization": [r"\?|\$\d|:\w", r"\b(query|execute|run)\s*\(", r"\b(bind|param|prepare)\s*\("],
    "orm": [r"(?i:\b(sequelize|typeorm|prisma|bookshelf|mongoose|ActiveRecord)\b)", r"(?i:\b\.find|\.create|\.update|\.delete\b)",
            r"(?i:\bwhere\(\)|\.where\()"],
    "auth_annotation": [r"@(PreAuthorize|Secured|RequiresPermissions|RolesAllowed)", r"@(Auth|Authenticated|Anonymous)",
                        r"#(auth|permission|role)", r"--\s*(auth|permission|role)"],
    "xss_sanitization": [r"(?i:\b(sanitize|DOMPurify|escapeHtml|htmlEscape)\b)", r"\b(textContent|innerText)\b",
                         r"(?i:\b(stripTags|removeHtml|stripHtml)\b)"],
    "url_validation": [r"(?i:\b(isValidUrl|validateUrl|checkUrl|verifyUrl)\b)", r"\b(hostname|port|protocol)\b",
                       r"(?i:\b(allowlist|blocklist)\b)"],
    "allowlist": [r"(?i:\b(allowlist|whitelist|approvedUrls)\b)", r"(?i:\b(validHosts|trustedDomains)\b)"],
    "path_validation": [r"\b(realpath|normalize|resolve)\b", r"(?i:\b(isInside|checkPath|validatePath)\b)",
                        r"\b(basename|dirname)\b"],
    "path_normalization": [r"\b(normalize|resolve|join)\b.*\b\.\.", r"\breadFileSync\s*\(\s*path\.join", r"\bpath\.normalize\b"],
    "xxe_protection": [r"(?i:disallow-doctype-decl)", r"(?i:external-general-entities)", r"(?i:external-parameter-entities)",
                       r"\bXMLConstants\b", r"\b_FEATURE_SECURE_PROCESSING\b"],
    "secure_parsing": [r"(?i:setFeature.*secure)", r"(?i:setProperty.*secure)", r"(?i:SAXParserFactory.*newInstance)",
                       r"(?i:DocumentBuilderFactory.*newInstance)"],
    "signature_validation": [r"(?i:\b(verify|validateSignature|checkSignature)\b)", r"\b(crypto\.createVerify)\b",
                             r"(?i:\b(hmac|mac)\b)"],
    "type_checking": [r"\b(instanceof|typeof|type)\b", r"(?i:\b(allowedClasses|whitelist)\b)"],
    "salt": [r"\b(salt|SALT)\b", r"\bcrypto\.randomBytes\b"],
    "secure_crypto": [r"(?i:\b(sha256|sha384|sha512|bcrypt|argon2|scrypt)\b)", r"\bcrypto\.randomUUID\b"],
    "owner_check": [r"checkOwner|checkTenant|validateOwnership|canAccess|canModify|isOwner|hasAccess"],
}
# Per family the lines before and after, the gain in confidence and the signals reported.
FAMILIES = {
    "injection": (["COMMAND_INJECTION", "CODE_INJECTION"], 10, 5, 0.10, ["user_input", "validation", "encoding"]),
    "sql": (["SQL_INJECTION"], 8, 5, 0.10, ["parameterization", "orm", "validation"]),
    "xss": (["XSS"], 8, 5, 0.10, ["user_input", "xss_sanitization", "encoding"]),
    "ssrf": (["SSRF"], 8, 5, 0.10, ["user_input", "url_validation", "allowlist"]),
    "path": (["PATH_TRAVERSAL"], 10, 5, 0.10, ["user_input", "path_validation", "path_normalization"]),
    "xml": (["XXE", "XSLT_INJECTION"], 8, 5, 0.10, ["xxe_protection", "secure_parsing"]),
    "deserialization": (["INSECURE_DESERIALIZATION"], 8, 5, 0.15, ["user_input", "signature_validation", "type_checking"]),
    "crypto": (["WEAK_CRYPTO", "INSECURE_RANDOM"], 5, 5, 0.05, ["salt", "secure_crypto"]),
    "access": ([], 15, 15, 0.05, ["auth_annotation", "owner_check"]),
    "generic": ([], 10, 5, 0.02, ["user_input", "validation"]),
}


# An injection finding is only judged when its evidence names one of these.
DANGEROUS_NAMES = ["eval", "exec", "system", "spawn", "execSync", "execFile", "sql.query", "sql.execute", "raw", "innerHTML",
                   "dangerouslySetInnerHTML", "document.write", "v-html", "innerText", "textContent", "execute", "run",
                   "loadStrings", "fetch", "axios", "http.request", "url.open", "request", "urllib", "httpx", "readFile",
                   "readFileSync", "readdir", "createReadStream", "XMLParser", "DocumentBuilder", "SAXParser", "SAXReader",
                   "XMLReader", "TransformerFactory", "XSLTProcessor", "pickle.loads", "pickle.load", "yaml.load",
                   "unserialize", "readObject", "ObjectInputStream", "md5", "sha1", "des", "rc4", "random", "Math.random"]


def family_of(vuln_type: Column, skill_id: Column) -> Column:
    chain = None
    for name, (types, *_rest) in FAMILIES.items():
        if types:
            chain = F.when(vuln_type.isin(types), name) if chain is None else chain.when(vuln_type.isin(types), name)
    return chain.when(skill_id == "access-control", "access").otherwise("generic")


def context_flags(findings: DataFrame, files: DataFrame, min_rows: int = 0) -> DataFrame:
    """`family`, `flags` (the signals present near the finding), `query_type`, and a raised confidence.

    The windows hold [line-before, line+after) lines. Findings whose file is unknown stay as they are.
    """
    df = with_windows(findings, files, max(max(f[1], f[2]) for f in FAMILIES.values()))
    skill = F.col("skill_id") if "skill_id" in df.columns else F.lit("")
    df = df.withColumn("family", family_of(F.col("vuln_type"), F.coalesce(skill, F.lit(""))))
    named = texts.any_match(F.coalesce("evidence", F.lit("")), [n.replace(".", r"\.") for n in DANGEROUS_NAMES])
    known = F.col("_around").isNotNull() & ((F.col("family") != "injection") | named)
    flags, query_type, gain = None, None, None
    for name, (_types, before, after, plus, signals) in FAMILIES.items():
        # lines before+1 .. after, counted as the half-open window of the scan
        text = texts.near_text(F.col("_at"), before - 1, after)
        present = F.array_compact(F.array(*[F.when(texts.any_match(text, SIGNALS[s], False), s) for s in signals]))
        here = F.col("family") == name
        flags = F.when(here, present) if flags is None else flags.when(here, present)
        gain = F.when(here, F.lit(plus)) if gain is None else gain.when(here, F.lit(plus))
        if name == "sql":
            query_type = F.when(here, F.when(text.rlike(r"(?i)\b(raw|query|execute)\s*\(\s*`|\.query\s*\("), "raw_sql")
                                .when(text.rlike(r"(?i)\b(find|create|update|delete|where)\s*\("), "orm")
                                .when(text.rlike(r"(?i)\b(prepare|bind|param)\s*\("), "parameterized").otherwise("unknown"))
    return (df.withColumn("flags", F.when(known, flags)).withColumn("query_type", F.when(known, query_type))
            .withColumn("confidence", F.when(known, F.least(F.col("confidence") + gain, F.lit(1.0))).otherwise(F.col("confidence")))
            .drop("_file", "_line", "_at", "_around", "_from"))


# Advice per family: when one of the listed signals is present, and otherwise.
ADVICE = {
    "injection": (["validation"], "Input checks found: make sure they cover every argument; avoid eval() and shell strings.",
                  "Avoid eval() and shell strings; pass arguments separately and add input validation."),
    "sql": (["parameterization", "orm"], "Bound parameters or an ORM are in use: make sure no condition is concatenated.",
            "Use parameterised queries or an ORM instead of building SQL text."),
    "xss": (["xss_sanitization"], "Sanitising found: check its version and configuration.",
            "Use textContent or encode output before it reaches HTML."),
    "ssrf": (["url_validation", "allowlist"], "URL checks found: make sure they are complete.",
             "Check protocol, host and port of the URL against an allow list."),
    "path": (["path_validation", "path_normalization"], "Path checks found: make sure every entry point is covered.",
             "Normalise the path with realpath() and check that it stays inside its base directory."),
    "xml": (["xxe_protection", "secure_parsing"], "Parser hardening found: make sure it takes effect.",
            "Disable external entities in the XML parser with setFeature()."),
    "deserialization": (["signature_validation", "type_checking"], "Signature or type checks found: make sure they suffice.",
                        "Use JSON, or verify a signature and allow only listed classes."),
    "crypto": (["secure_crypto"], "A stronger algorithm is present: remove the weak one.",
               "Use SHA-256 or Argon2, and crypto.randomBytes() for secrets."),
    "access": (["auth_annotation", "owner_check"], "Access checks found: make sure every entry point is covered.",
               "Add permission checks and verify that the caller owns the object."),
    "generic": ([], "", "Validate and encode user input."),
}


def recommend(df: DataFrame) -> DataFrame:
    """`recommendation` from family and flags."""
    chain = None
    for name, (signals, present, absent) in ADVICE.items():
        text = F.when(F.arrays_overlap("flags", F.array(*[F.lit(s) for s in signals])), present).otherwise(absent) if signals else F.lit(absent)
        chain = F.when(F.col("family") == name, text) if chain is None else chain.when(F.col("family") == name, text)
    return df.withColumn("recommendation", chain)


def project_recommendations(df: DataFrame) -> DataFrame:
    """The distinct advice per project."""
    return df.select("project", "recommendation").where(F.col("recommendation").isNotNull()).distinct()


# What the near-source check looks for.
NEAR_SINKS = [(r"eval\s*\(", "CODE_INJECTION", "critical"), (r"exec\s*\(", "COMMAND_INJECTION", "critical"),
              (r"system\s*\(", "COMMAND_INJECTION", "high"), (r"shell_exec\s*\(", "COMMAND_INJECTION", "high"),
              (r"innerHTML\s*=", "XSS", "high"), (r"document\.write\s*\(", "XSS", "high"),
              (r"\.query\s*\([^)]*\+", "SQL_INJECTION", "high"), (r"execute\s*\([^)]*\+", "SQL_INJECTION", "high"),
              (r"file_put_contents\s*\(", "PATH_TRAVERSAL", "medium"), (r"unserialize\s*\(", "INSECURE_DESERIALIZATION", "high")]
NEAR_SOURCES = [r"\$_(GET|POST|REQUEST|COOKIE)\[", r"input\(|readline\(", r"file_get_contents|file_put_contents|fopen|readfile",
                r"\$_(SERVER|ENV)", r"req\.(body|params|query)"]
NEAR_SANITIZERS = [r"htmlspecialchars\s*\(", r"htmlentities\s*\(", r"addslashes\s*\(", r"escapeshellarg\s*\(",
                   r"mysql_real_escape_string\s*\(", r"preg_replace\s*\(.*e\s*\)", r"intval\s*\(", r"floatval\s*\(",
                   r"json_decode\s*\(.*\)", r"parseInt\s*\(", r"Number\s*\("]


def near_source_sink(files: DataFrame) -> DataFrame:
    """Sinks with an input within the 30 lines up to them and no sanitizer from that input on.

    Confidence 0.80; one row per line and type. The sinks are found on whole texts, since a call
    may span lines. Only line numbers of inputs and sanitizers, not texts, are joined to them.
    """
    rules = [Rule(f"NEAR-{i:02d}", f"(?-i:{p})", vuln_type=t, severity=s) for i, (p, t, s) in enumerate(NEAR_SINKS)]
    sinks = scan_rules(files, rules).groupBy("project", "path", "line", "vuln_type").agg(
        F.min_by("severity", F.struct("rule_id", "offset")).alias("severity"))
    lines = texts.lines_of(F.col("content"))

    def numbers(patterns):
        return F.array_compact(F.transform(lines, lambda x, i: F.when(texts.any_match(x, patterns, False), i + 1)))

    marks = (files.where(texts.any_match(F.col("content"), NEAR_SOURCES, False))
             .select("project", "path", numbers(NEAR_SOURCES).alias("_src"), numbers(NEAR_SANITIZERS).alias("_san")))
    near = sinks.join(growing(marks), ["project", "path"]).withColumn(
        "source_line", F.try_element_at(F.filter("_src", lambda n: n.between(F.col("line") - 29, F.col("line"))), F.lit(1)))
    clean = ~F.exists("_san", lambda n: (n > F.col("source_line")) & (n <= F.col("line")))
    return near.where(F.col("source_line").isNotNull()).where(clean).select(
        "project", F.col("path").alias("file"), "line", F.concat_ws(":", "path", "line").alias("location"), "vuln_type",
        "severity", "source_line", F.lit(0.80).alias("confidence"), F.lit("taint").alias("source"))


# File-level rules. Each needs both contents, may need a path, and may be called off by a guard.
HEURISTICS = [
    ("access-control", "object access without an ownership check", "medium", 0.76,
     r"(req|request)\.(params|query)\.[a-zA-Z0-9_]+|\b(ctx|event)\.(params|query)\.[a-zA-Z0-9_]+", None,
     r"(controller|route|resolver|service|api)",
     r"(?i)\b(can|authorize|authorization|permission|permissions|policy|guard|rbac|ownership|tenant)\b"),
    ("access-control", "public role may hold too many permissions", "high", 0.79, r"(?i)\b(public|anonymous|guest)\b",
     r"(?i)\b(permission|permissions|role|roles|allow|grant|create|update|delete|read|find)\b",
     r"(permission|policy|role|acl|rbac|config)", None),
    ("bootstrap-config", "first-administrator entry needs a closing condition", "high", 0.82,
     r"(?i)\b(bootstrapAdmin|seedAdmin|createFirstAdmin|registerInitialAdmin|setupAdmin|initialAdmin)\b",
     r"(?i)\b(process\.env|config|if\s*\(!|allowBootstrap|enableBootstrap)\b", None, None),
    ("access-control", "route switches authentication off", "high", 0.80,
     r"(?i)\b(auth\s*:\s*false|skipAuth|bypassAuth|allowUnauthenticated|publicRoute)\b",
     r"(?i)\b(route|router|endpoint|admin|panel|plugin)\b", None, None),
    ("upload-storage", "upload reaches a public or file path", "medium", 0.71,
     r"(?i)\b(upload|multer|formidable|busboy|content-type|multipart)\b",
     r"\b(path\.join|fs\.writeFile|writeFileSync|createWriteStream|public/|static/)\b", None, None),
    ("secret-exposure", "default credential or placeholder key", "high", 0.74, r"(?i)\b(password|secret|token|api[_-]?key)\b",
     r"(?i)\b(default|example|changeme|admin123|test|demo|sample)\b", None, None),
    ("secret-exposure", "public build variable holds a secret", "medium", 0.68, r"\b(NEXT_PUBLIC_|PUBLIC_|VITE_)\b",
     r"(?i)\b(secret|token|api[_-]?key|admin|password)\b", None, None),
    ("query-safety", "query built from outside input", "medium", 0.64,
     r"(?i)\b(raw\(|sequelize\.query\(|knex\.raw\(|prisma\.[a-z]+Raw\(|SELECT\b|UPDATE\b|DELETE\b)\b",
     r"(?i)(`[^`]*\$\{|\+\s*(req|params|query|body)|\b(req|params|query|body)\b)", None, None),
]
OFF_SWITCH_PATH, OFF_SWITCH = r"(route|router|admin|plugin)", r"(?i)\bauth\s*:\s*false\b"


def skill_heuristics(files: DataFrame, skills: list[str] | None = None) -> DataFrame:
    """Findings of the file-level rules of the enabled skills."""
    content, path = F.col("content"), F.lower("path")
    tests = []
    for skill, title, sev, conf, first, second, where, guard in HEURISTICS:
        if skills is not None and skill not in skills:
            continue
        ok = content.rlike(first)
        if second:
            ok = ok & content.rlike(second)
        if where:
            ok = ok & path.rlike(where)
        if guard:
            ok = ok & ~content.rlike(guard)
        if "switches authentication off" in title:
            ok = ok | (path.rlike(OFF_SWITCH_PATH) & content.rlike(OFF_SWITCH))
        tests.append(F.when(ok, F.struct(F.lit(skill).alias("skill_id"), F.lit(title).alias("title"),
                                         F.lit(sev).alias("severity"), F.lit(conf).alias("confidence"))))
    return (files.select("project", "path", F.explode(F.array_compact(F.array(*tests))).alias("h"))
            .select("project", F.col("path").alias("file"), F.col("path").alias("location"), "h.*", F.lit("rule").alias("source")))
