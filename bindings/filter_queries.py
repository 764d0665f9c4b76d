"""Choosing files and findings, context of findings, repositories, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import (CODE, CODE_FINDINGS, CODE_RULES, DOC_RULES, FINDINGS, LANG_SQL, PAGES, SEV_RANK, code_files,
                             code_findings, doc_findings, page_files, table)
from riskloom.functions import texts
from riskloom.functions.joins import growing
from riskloom.operators import context, filters, fingerprint, hints, repos, scan
from riskloom.sources.rules import rules_frame

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def lst(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def alt(words):
    return "'" + "|".join(words).replace("'", "''") + "'"


NAME, DIR = "lower(regexp_replace(path, '^.*/', ''))", "CASE WHEN contains(path, '/') THEN lower(regexp_replace(path, '/[^/]*$', '')) ELSE '' END"
EXT = "lower(regexp_extract(path, '[.]([^./]*)$', 1))"
RISK = f"""risk AS (SELECT *, CASE WHEN list_contains({lst(filters.LOW_RISK_EXTENSIONS)}, {EXT}) THEN 'low_risk_extension'
   WHEN regexp_matches({NAME}, {alt(filters.LOW_RISK_NAMES)}) THEN 'test_file'
   WHEN regexp_matches(concat('/', {DIR}, '/'), '/(test|tests|spec)/') THEN 'test_directory'
   WHEN regexp_matches(concat('/', {DIR}, '/'), '/(node_modules|vendor|dist|build)/') THEN 'third_party_code'
   WHEN regexp_matches(concat('/', {DIR}, '/'), '/(docs|documentation)/') THEN 'documentation' END AS skip,
  least(5e-1 + CASE WHEN list_contains({lst(filters.HIGH_RISK_EXTENSIONS)}, {EXT}) THEN 3e-1 ELSE 0e0 END + CASE WHEN regexp_matches({NAME}, {alt(filters.HIGH_RISK_NAMES)}) THEN 2e-1 ELSE 0e0 END
   + CASE WHEN regexp_matches({DIR}, {alt(filters.HIGH_RISK_NAMES)}) THEN 1e-1 ELSE 0e0 END, 95e-2) AS sc FROM code),
 rk AS (SELECT project, path, skip IS NULL AND sc >= 6e-1 AS should_audit, coalesce(skip, CASE WHEN sc >= 8e-1 THEN 'high_risk' WHEN sc >= 6e-1 THEN 'medium_risk' ELSE 'low_risk' END) AS reason,
  CASE WHEN skip IS NULL THEN sc END AS risk_score FROM risk)"""
TIER = ("CASE " + " ".join(f"WHEN regexp_matches({NAME}, {alt(w)}) OR regexp_matches({DIR}, {alt(w)}) THEN '{t}'" for t, w in filters.TIER_NAMES.items()) + " ELSE 'T2' END")


@query("file_risk", f"WITH {CODE}, {RISK} SELECT path, should_audit, reason, risk_score FROM rk")
def _(spark, sf):
    return code_files(spark, sf).select("path", filters.file_risk(F.col("path")).alias("r")).select("path", "r.*")


@query("filter_files", f"WITH {CODE}, {RISK} SELECT project, path, should_audit, reason, risk_score FROM rk ORDER BY should_audit DESC, risk_score DESC, project, path")
def _(spark, sf):
    return filters.filter_files(code_files(spark, sf)).drop("content", "size")


@query("audit_time_estimate", f"""WITH {CODE}, {RISK}, s AS (SELECT count(*) AS total, count(*) FILTER (should_audit) AS to_audit, count(*) FILTER (NOT should_audit) AS skipped,
   floor(avg(risk_score) FILTER (should_audit) * 1e2 + 5e-1) / 1e2 AS avg_risk FROM rk), b AS (SELECT *, CAST(ceil(to_audit / 5e0) AS BIGINT) AS batches FROM s),
 e AS (SELECT *, to_audit * 3000 + batches * 1000 AS estimated_ms FROM b)
 SELECT *, CAST(floor(estimated_ms / 1e3 + 5e-1) AS BIGINT) AS estimated_seconds, CAST(floor(estimated_ms / 6e4 + 5e-1) AS BIGINT) AS estimated_minutes FROM e""")
def _(spark, sf):
    return filters.audit_time_estimate(code_files(spark, sf))


@query("file_tier", f"WITH {CODE} SELECT path, {TIER} AS tier FROM code")
def _(spark, sf):
    return code_files(spark, sf).select("path", filters.file_tier(F.col("path")).alias("tier"))


@query("effective_loc", f"""WITH {CODE}, t AS (SELECT project, {TIER} AS tier, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n FROM code),
 s AS (SELECT project, coalesce(sum(n) FILTER (tier = 'T1'), 0) AS t1, coalesce(sum(n) FILTER (tier = 'T2'), 0) AS t2, coalesce(sum(n) FILTER (tier = 'T3'), 0) AS t3 FROM t GROUP BY project),
 e AS (SELECT project, CAST(t1 AS BIGINT) AS t1, CAST(t2 AS BIGINT) AS t2, CAST(t3 AS BIGINT) AS t3, CAST(ceil(t1 * 1e0 + t2 * 5e-1 + t3 * 1e-1) AS BIGINT) AS effective_loc FROM s)
 SELECT *, CAST(ceil(effective_loc / 15e3) AS BIGINT) AS agents FROM e""")
def _(spark, sf):
    return filters.effective_loc(code_files(spark, sf), F.size(texts.lines_of(F.col("content"))))


@query("is_test_path", f"""WITH {CODE} SELECT path, regexp_matches(lower(path), '[\\\\/](test|tests|__tests__|spec|mock|fixture|example|sample|demo|stub|placeholder|dummy)[\\\\/]')
  OR regexp_matches(lower(path), '\\.(test|spec|mock)\\.') AS in_directory, regexp_matches(path, '(?i)test|spec') AS by_name,
  regexp_matches(path, '(?i)test|spec|mock|fixture|example|sample|demo|stub|placeholder|dummy') AS by_words FROM code""")
def _(spark, sf):
    p = F.col("path")
    return code_files(spark, sf).select("path", filters.is_test_path(p).alias("in_directory"), filters.is_test_path(p, "name").alias("by_name"),
                                        filters.is_test_path(p, "words").alias("by_words"))


@query("false_positive_rules", f"""WITH {CODE_FINDINGS} SELECT file, line, rule_id, CASE WHEN regexp_matches(file, '(?i)test|spec|mock|fixture|example|demo|stub|placeholder|dummy') THEN 'test_file'
  WHEN regexp_matches(file, {alt(filters.FRAMEWORK_PATHS)}) THEN 'framework_code'
  WHEN regexp_matches(text, 'logger[.](error|warn|info|debug)|console[.](log|debug|info)|(?i:skip)|(?i:todo)') THEN 'safe_pattern'
  WHEN regexp_matches(trim(text), '^//|^/[*]|^[*]|#|<!--') THEN 'comment_line'
  WHEN regexp_matches(text, 'assert|expect|should[.]be|should[.]eq|jest[.]fn|sinon') THEN 'test_assertion' END AS reason FROM cf""")
def _(spark, sf):
    found = scan.scan_lines(code_files(spark, sf), [r for r in CODE_RULES if r.kind == "sink"])
    r = filters.false_positive_rules(F.col("path"), F.col("text"), F.col("vuln_type"))
    return found.select(F.col("path").alias("file"), "line", "rule_id", r["reason"].alias("reason"))


@query("heuristic_fp_filter", f"""WITH {CODE_FINDINGS}, w AS (SELECT cf.*, array_to_string(string_split(content, chr(10))[greatest(1, line - 3):line + 3], ' ') AS around FROM cf JOIN code ON cf.file = code.path)
 SELECT file, line, rule_id FROM w WHERE NOT regexp_matches(file, '(?i)test|spec') AND NOT regexp_matches(around, '(?i)test|spec|mock|fixture|example|sample|demo|stub|placeholder|dummy')
  AND NOT regexp_matches(lower(text), 'ping')""")
def _(spark, sf):
    files = code_files(spark, sf)
    found = scan.scan_lines(files, [r for r in CODE_RULES if r.kind == "sink"], around=3)
    f = found.withColumn("context", texts.context_lines(F.col("line"))).withColumn("confidence", F.lit(0.75))
    return filters.heuristic_fp_filter(f, 0.5, ["ping"], path="path").select(F.col("path").alias("file"), "line", "rule_id")


@query("title_fp_filter", """SELECT o_orderkey, title FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'No security issue in order' WHEN 1 THEN 'Reviewed and PASSED' WHEN 2 THEN 'SQL injection' ELSE 'Safe defaults' END AS title FROM orders)
 WHERE NOT regexp_matches(title, '(?i)no direct vulnerability|no executable code|reviewed and passed|no vulnerability found|no security issue|safe implementation')""")
def _(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'No security issue in order' WHEN 1 THEN 'Reviewed and PASSED' WHEN 2 THEN 'SQL injection' ELSE 'Safe defaults' END AS title")
    return filters.title_fp_filter(o)


@query("confidence_filter", "SELECT event_id, least(value / 1e2, 1e0) AS confidence FROM events WHERE least(value / 1e2, 1e0) >= 55e-2")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"))
    return filters.confidence_filter(e, 0.55)


@query("type_supported", f"""WITH {CODE_FINDINGS} SELECT file, line, rule_id, vuln_type, CASE language WHEN 'java' THEN vuln_type NOT IN ('HARD_CODE_PASSWORD') WHEN 'python' THEN TRUE WHEN 'go' THEN TRUE ELSE TRUE END AS supported FROM cf""")
def _(spark, sf):
    return code_findings(spark, sf).select("file", "line", "rule_id", "vuln_type", filters.type_supported(F.col("vuln_type"), F.col("language")).alias("supported"))


@query("finding_issues", f"""WITH {FINDINGS}, g AS (SELECT *, CASE WHEN line % 3 = 0 THEN '' WHEN line % 3 = 1 THEN concat(file, ':x') ELSE location END AS loc, CASE WHEN line % 2 = 0 THEN 0.2 ELSE 0.75 END AS conf FROM f),
 i AS (SELECT file, line, rule_id, list_filter([CASE WHEN loc = '' THEN 'missing_location' END, CASE WHEN loc <> '' AND NOT regexp_matches(split_part(loc, ':', 2), '[0-9]') THEN 'invalid_line_number' END,
   CASE WHEN len(match) < 20 THEN 'evidence_too_short' END, 'remediation_too_short', CASE WHEN conf < 0.3 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS issues FROM g)
 SELECT file, line, rule_id, array_to_string(issues, ',') AS issues, len(issues) = 0 AS is_valid, len(list_filter(issues, lambda x: x <> 'low_confidence')) = 0 AS is_actionable FROM i""")
def _(spark, sf):
    f = doc_findings(spark, sf).withColumn("location", F.when(F.col("line") % 3 == 0, "").when(F.col("line") % 3 == 1, F.concat("file", F.lit(":x"))).otherwise(F.col("location")))
    f = f.withColumn("confidence", F.when(F.col("line") % 2 == 0, 0.2).otherwise(0.75)).withColumn("remediation", F.lit("")).withColumn("evidence", F.col("match"))
    return filters.finding_issues(f).select("file", "line", "rule_id", F.array_join("issues", ",").alias("issues"), "is_valid", "is_actionable")


REMEDY = "CASE p_partkey % 4 WHEN 0 THEN 'Improve security' WHEN 1 THEN concat('Replace string building with PreparedStatement in ', p_name) WHEN 2 THEN 'Use tokens' ELSE concat('Pay attention to the item named ', p_name, ' here') END"


@query("remediation_quality", f"""WITH r AS (SELECT p_partkey, {REMEDY} AS t FROM part),
 q AS (SELECT p_partkey, regexp_matches(t, concat('(?i)', {alt(filters.VAGUE_ADVICE)})) AS is_vague, len(t) >= 30 AS long_enough, regexp_matches(t, concat('(?i)', {alt(filters.ACTION_VERBS)})) AS has_action,
   regexp_matches(t, '[A-Za-z_]\\w*\\s*\\(|[A-Za-z_]\\w*\\.[A-Za-z_]\\w+|[A-Z][a-z]+[A-Z]\\w*|\\d+\\.\\d+') AS has_api FROM r)
 SELECT *, NOT is_vague AND long_enough AND has_action AND has_api AS is_good FROM q""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(REMEDY).alias("t")).select(
        "p_partkey", filters.remediation_quality(F.col("t")).alias("q")).select("p_partkey", "q.*")


@query("incremental_skip", f"""WITH {CODE}, n AS (SELECT project, path, content AS a, CASE p_partkey % 3 WHEN 0 THEN content WHEN 1 THEN replace(content, '    ', chr(9)) ELSE replace(content, 'items', 'rows') END AS b FROM code),
 d AS (SELECT project, path, b, list_filter(generate_series(1, greatest(len(string_split(a, chr(10))), len(string_split(b, chr(10))))), lambda i: string_split(a, chr(10))[i] IS DISTINCT FROM string_split(b, chr(10))[i]) AS ch,
   regexp_replace(a, '\\s+', '', 'g') = regexp_replace(b, '\\s+', '', 'g') AS ws FROM n)
 SELECT project, path, CAST(len(ch) AS INTEGER) AS n_changed, CASE WHEN len(ch) = 0 THEN 'no changed lines in file'
  WHEN ws AND len(list_filter(ch, lambda i: trim(string_split(b, chr(10))[i]) <> '')) = 0 THEN 'only whitespace changes' END AS skip_reason FROM d""")
def _(spark, sf):
    old = code_files(spark, sf)
    new = table(spark, sf, "part").select("p_partkey").join(growing(_code_with_key(spark, sf)), "p_partkey").withColumn("content", F.expr(
        "CASE p_partkey % 3 WHEN 0 THEN content WHEN 1 THEN replace(content, '    ', chr(9)) ELSE replace(content, 'items', 'rows') END")).drop("p_partkey")
    return filters.incremental_skip(new, filters.changed_lines(old, new)).select("project", "path", F.size("changed_lines").alias("n_changed"), "skip_reason")


def _code_with_key(spark, sf):
    from bindings.common import CODE_PATH, CODE_PROJECT, _case

    return table(spark, sf, "part").selectExpr("p_partkey", f"{CODE_PROJECT} AS project", f"{CODE_PATH} AS path", f"{_case(1)} AS content")


@query("skills_by_profile", f"""WITH {CODE_FINDINGS}, r AS (SELECT * FROM (VALUES {", ".join(f"('{r.rule_id}', '{r.category}')" for r in CODE_RULES if r.kind == 'sink')}) AS t(rule_id, category)),
 hit AS (SELECT rule_id, category, CASE WHEN category = 'sql_injection' THEN 'category:sql_injection' ELSE 'cwe:78' END AS label FROM r WHERE category IN ('sql_injection', 'command_exec'))
 SELECT hit.rule_id, label AS matched, count(*) AS findings FROM hit JOIN cf ON cf.rule_id = hit.rule_id GROUP BY ALL""")
def _(spark, sf):
    rules = [type(r)(**{**r.__dict__, "guidelines": {"cwe": [r.cwe[4:]]}, "profiles": ["security"]}) for r in CODE_RULES if r.kind == "sink"]
    chosen = filters.rules_by(rules_frame(spark, rules), profile="security", labels=["category:sql_injection", "cwe:78"])
    # the rule table is bounded by the rule set
    joined = code_findings(spark, sf).join(F.broadcast(chosen.select("rule_id", F.array_join("matched_labels", ",").alias("matched"))), "rule_id")
    return joined.groupBy("rule_id", "matched").agg(F.count("*").alias("findings"))


def _hint_sql(group, key="ext", text="content"):
    def n(pats):
        return " + ".join("CAST(regexp_matches(%s, '(?i)%s') AS INTEGER)" % (text, p.replace("'", "''")) for p in pats)
    arms = " ".join(f"WHEN '{e}' THEN {n(g[group])}" for e, g in hints.BY_EXTENSION.items())
    return f"CASE WHEN {key} IN ({', '.join(repr(e) for e in hints.BY_EXTENSION)}) THEN (CASE {key} {arms} END) + {n(hints.COMMON[group])} ELSE 0 END"


HINTS = f"""h AS (SELECT path, content, {", ".join(f"{_hint_sql(g)} AS {g}_count" for g in hints.GROUPS)} FROM (SELECT *, {EXT} AS ext FROM code))"""


@query("hint_profile", f"WITH {CODE}, {HINTS} SELECT path, input_count, sink_count, safety_count, validation_count, input_count * 8 + sink_count * 10 + validation_count * 3 + safety_count * 2 AS hint_score FROM h")
def _(spark, sf):
    from riskloom.functions import paths

    p = hints.hint_profile(F.col("content"), paths.extension(F.col("path")))
    return code_files(spark, sf).select("path", p.alias("p")).select("path", "p.*", hints.hint_score(F.col("p")).alias("hint_score"))


SCORED = f"""ev AS (SELECT *, text AS ev, CASE language WHEN 'python' THEN 'py' WHEN 'javascript' THEN 'js' ELSE language END AS ext FROM cf),
 hp AS (SELECT *, {", ".join(f"{_hint_sql(g, 'ext', 'ev')} AS {g[:2]}" for g in hints.GROUPS)} FROM ev),
 sc AS (SELECT *, greatest({SEV_RANK}, 1) * 5 + "in" * 8 + si * 10 + va * 3 + sa * 2 + CASE WHEN "in" > 0 THEN 25 ELSE 0 END + CASE WHEN si > 0 THEN 35 ELSE 0 END
   + CASE WHEN "in" > 0 AND si > 0 THEN 200 ELSE 0 END + CASE WHEN "in" > 0 AND si > 0 AND va = 0 AND sa = 0 THEN 150 ELSE 0 END
   + CASE WHEN regexp_matches(location, '(?i)\\b(api|auth|admin|login|upload|download|user|password|token|secret)\\b') THEN 8 ELSE 0 END AS audit_score FROM hp)"""


def _scored(spark, sf, mode):
    found = scan.scan_lines(code_files(spark, sf), [r for r in CODE_RULES if r.kind == "sink"])
    f = scan.make_findings(found, "quick_scan").join(found.select(F.col("path").alias("file"), "line", "rule_id", "text"), ["file", "line", "rule_id"])
    return filters.candidate_filter(f, mode, 30, evidence="text").select("file", "line", "rule_id", "audit_score", "audit_priority", "passed")


PRIORITY = "CASE WHEN audit_score >= 50 THEN 'high' WHEN audit_score >= 20 THEN 'medium' ELSE 'low' END"
MUST = f"list_contains({lst(filters.MUST_PASS_TYPES)}, vuln_type)"


@query("candidate_score", f"WITH {CODE_FINDINGS}, {SCORED} SELECT file, line, rule_id, audit_score, {PRIORITY} AS audit_priority, audit_score >= 30 OR {MUST} AS passed FROM sc")
def _(spark, sf):
    return _scored(spark, sf, "strict")


@query("candidate_filter", f"WITH {CODE_FINDINGS}, {SCORED} SELECT file, line, rule_id, audit_score, {PRIORITY} AS audit_priority, audit_score >= 50 OR (audit_score >= 20 AND audit_score >= 30) OR {MUST} AS passed FROM sc")
def _(spark, sf):
    return _scored(spark, sf, "lenient")


# ---------------------------------------------------------------- context
def _any(col, pats):
    return "regexp_matches(%s, '%s')" % (col, "|".join(f"(?:{p})" for p in pats).replace("'", "''"))


GUARD = "CASE vuln_type " + " ".join(f"WHEN '{t}' THEN {_any('win', p)}" for t, p in context.GUARDS.items()) + " ELSE FALSE END"


@query("guard_context", f"""WITH {CODE_FINDINGS}, w AS (SELECT cf.*, trim(text) AS t, array_to_string(string_split(content, chr(10))[greatest(1, line - 5):line + 5], chr(10)) AS win FROM cf JOIN code ON cf.file = code.path),
 g AS (SELECT file, line, rule_id, regexp_matches(lower(file), '[\\\\/](test|tests|__tests__|spec|mock|fixture|example|sample|demo|stub|placeholder|dummy)[\\\\/]') AS is_test,
   regexp_matches(t, '^["''][^"''{{}}]*["'']\\s*$') OR regexp_matches(t, '^\\s*\\w+\\s*\\(\\s*["''][^"'']*["'']\\s*\\)\\s*$') AS lit, {GUARD} AS grd FROM w)
 SELECT file, line, rule_id, is_test AS is_test_file, NOT is_test AND lit AS has_string_literal_arg, NOT is_test AND grd AS has_guard_pattern,
  CASE WHEN is_test THEN 15e-2 WHEN lit AND grd THEN 1e-1 WHEN lit THEN 2e-1 WHEN grd THEN 3e-1 ELSE 75e-2 END AS confidence FROM g""")
def _(spark, sf):
    return context.guard_context(code_findings(spark, sf), code_files(spark, sf)).select(
        "file", "line", "rule_id", "guard.is_test_file", "guard.has_string_literal_arg", "guard.has_guard_pattern", "confidence")


def _family_sql():
    arms = " ".join(f"WHEN vuln_type IN ({', '.join(repr(t) for t in v[0])}) THEN '{k}'" for k, v in context.FAMILIES.items() if v[0])
    return f"CASE {arms} ELSE 'generic' END"


def _flags_sql():
    out = []
    for fam, (_t, before, after, plus, sigs) in context.FAMILIES.items():
        win = f"array_to_string(ls[greatest(1, line - {before - 1}):line + {after}], chr(10))"
        parts = ", ".join(f"CASE WHEN {_any(win, context.SIGNALS[s])} THEN '{s}' END" for s in sigs)
        out.append(f"WHEN '{fam}' THEN list_filter([{parts}], lambda x: x IS NOT NULL)")
    return "CASE family " + " ".join(out) + " END"


FLAGS = f"""fl AS (SELECT cf.*, {_family_sql()} AS family, string_split(content, chr(10)) AS ls FROM cf JOIN code ON cf.file = code.path),
 fg AS (SELECT file, line, rule_id, vuln_type, project, confidence, family, family <> 'injection' OR regexp_matches(evidence, concat('(?i)', {alt([n.replace('.', '[.]') for n in context.DANGEROUS_NAMES])})) AS known, {_flags_sql()} AS flags FROM fl)"""
GAIN = "CASE family " + " ".join(f"WHEN '{k}' THEN {v[3]}::DOUBLE" for k, v in context.FAMILIES.items()) + " END"


@query("context_flags", f"""WITH {CODE_FINDINGS}, {FLAGS} SELECT file, line, rule_id, family, CASE WHEN known THEN array_to_string(flags, ',') END AS flags,
  round(CASE WHEN known THEN least(confidence + {GAIN}, 1e0) ELSE confidence END, 6) AS confidence FROM fg""")
def _(spark, sf):
    return context.context_flags(code_findings(spark, sf), code_files(spark, sf)).select(
        "file", "line", "rule_id", "family", F.array_join("flags", ",").alias("flags"), F.round("confidence", 6).alias("confidence"))


ADVICE = "CASE family " + " ".join(
    f"WHEN '{k}' THEN CASE WHEN list_has_any(flags, {lst(v[0])}) THEN '{v[1]}' ELSE '{v[2]}' END" if v[0] else f"WHEN '{k}' THEN '{v[2]}'" for k, v in context.ADVICE.items()) + " END"


@query("recommendations", f"""WITH {CODE_FINDINGS}, {FLAGS} SELECT DISTINCT project, {ADVICE} AS recommendation FROM fg WHERE known""")
def _(spark, sf):
    f = context.context_flags(code_findings(spark, sf), code_files(spark, sf)).where(F.col("flags").isNotNull())
    return context.project_recommendations(context.recommend(f))


NEAR = ", ".join("(%d, '%s', '%s', '%s')" % (i, p, t, s) for i, (p, t, s) in enumerate(context.NEAR_SINKS))


@query("near_source_sink", f"""WITH {CODE}, n AS (SELECT * FROM (VALUES {NEAR}) AS t(ord, pat, vuln_type, severity)),
 h AS (SELECT project, path, ord, vuln_type, severity, content, string_split_regex(content, pat) AS pieces, regexp_extract_all(content, pat) AS hits FROM code, n WHERE regexp_matches(content, pat)),
 e AS (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM h),
 o AS (SELECT project, path, ord, vuln_type, severity, string_split(content, chr(10)) AS ls, len(string_split(substr(content, 1, CAST(list_sum(list_transform(pieces[1:i], lambda x: len(x)))
   + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0) AS BIGINT)), chr(10))) AS line FROM e),
 d AS (SELECT project, path, vuln_type, line, first(severity ORDER BY ord) AS severity, first(ls) AS ls FROM o GROUP BY ALL),
 s AS (SELECT *, list_filter(generate_series(greatest(1, line - 29), line), lambda k: {_any('ls[k]', context.NEAR_SOURCES)})[1] AS src FROM d)
 SELECT project, path AS file, CAST(line AS INTEGER) AS line, vuln_type, severity, CAST(src AS INTEGER) AS source_line FROM s
 WHERE src IS NOT NULL AND len(list_filter(generate_series(src + 1, line), lambda k: {_any('ls[k]', context.NEAR_SANITIZERS)})) = 0""")
def _(spark, sf):
    return context.near_source_sink(code_files(spark, sf)).select("project", "file", "line", "vuln_type", "severity", "source_line")


def _heur_sql():
    rows = []
    for skill, title, sev, conf, a, b, where, guard in context.HEURISTICS:
        cond = _rx("content", a)
        if b:
            cond += " AND " + _rx("content", b)
        if where:
            cond += " AND " + _rx("lower(path)", where)
        if guard:
            cond += " AND NOT " + _rx("content", guard)
        if "switches authentication off" in title:
            cond = f"({cond}) OR ({_rx('lower(path)', context.OFF_SWITCH_PATH)} AND {_rx('content', context.OFF_SWITCH)})"
        rows.append(f"SELECT project, path AS file, '{skill}' AS skill_id, '{title}' AS title, '{sev}' AS severity, {conf}::DOUBLE AS confidence FROM code WHERE {cond}")
    return " UNION ALL ".join(rows)


def _rx(col, pat):
    return "regexp_matches(%s, '%s')" % (col, pat.replace("'", "''"))


@query("skill_heuristics", f"WITH {CODE} {_heur_sql()}")
def _(spark, sf):
    return context.skill_heuristics(code_files(spark, sf)).drop("location", "source")


# ---------------------------------------------------------------- repositories (suppliers and customers stand for projects)
REPO_SQL = """CAST(c_custkey AS BIGINT) AS key, concat('org', c_nationkey, '/', lower(c_mktsegment), c_custkey % 700) AS full_name,
  CASE c_custkey % 5 WHEN 0 THEN 'A headless CMS' WHEN 1 THEN 'Blog publishing platform' WHEN 2 THEN 'Shop and catalog' WHEN 3 THEN 'Learning portal' ELSE 'Utilities' END AS description"""


def _repos(spark, sf):
    c = table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS id", "concat('org', c_nationkey, '/', lower(c_mktsegment), c_custkey % 700) AS full_name",
        "CASE c_custkey % 5 WHEN 0 THEN 'A headless CMS' WHEN 1 THEN 'Blog publishing platform' WHEN 2 THEN 'Shop and catalog' WHEN 3 THEN 'Learning portal' ELSE 'Utilities' END AS description",
        "CASE WHEN c_custkey % 2 = 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) END AS stargazers_count",
        "named_struct('stars', CAST(floor(abs(c_acctbal) / 2) AS BIGINT), 'forks', c_custkey % 90) AS adoptionSignals",
        "CASE WHEN c_custkey % 3 = 0 THEN 'Java' END AS language",
        "concat('2024-0', 1 + c_custkey % 6, '-15 00:00:00') AS pushedAt", "array(lower(c_mktsegment)) AS topics")
    return repos.normalize_projects(c, F.lit("2024-06-30 00:00:00"))


REPOS = """rp AS (SELECT CAST(c_custkey AS VARCHAR) AS id, concat('org', c_nationkey, '/', lower(c_mktsegment), c_custkey % 700) AS full_name,
  CASE c_custkey % 5 WHEN 0 THEN 'A headless CMS' WHEN 1 THEN 'Blog publishing platform' WHEN 2 THEN 'Shop and catalog' WHEN 3 THEN 'Learning portal' ELSE 'Utilities' END AS description,
  CAST(CASE WHEN c_custkey % 2 = 0 THEN floor(abs(c_acctbal)) ELSE floor(abs(c_acctbal) / 2) END AS BIGINT) AS stars, c_custkey % 90 AS forks,
  CASE WHEN c_custkey % 3 = 0 THEN 'Java' ELSE 'Unknown' END AS language, CAST(concat('2024-0', 1 + c_custkey % 6, '-15 00:00:00') AS TIMESTAMP) AS pushed_at, lower(c_mktsegment) AS topic FROM customer)"""
RTEXT = "lower(concat(full_name, ' ', description, ' ', topic))"
RSCORE = (f"rs AS (SELECT *, stars * 105e-2 + forks * 215e-2 + " + " + ".join(f"CASE WHEN contains({RTEXT}, '{w}') THEN 2000 ELSE 0 END" for w in repos.PLATFORM_WORDS)
          + " + CASE WHEN date_diff('day', pushed_at, TIMESTAMP '2024-06-30') <= 14 THEN 4000 WHEN date_diff('day', pushed_at, TIMESTAMP '2024-06-30') <= 45 THEN 2200 WHEN date_diff('day', pushed_at, TIMESTAMP '2024-06-30') <= 90 THEN 900 ELSE 0 END AS score, "
          + "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({RTEXT}, {w!r})' for w in ws)} THEN '{k}'" for k, ws in repos.KIND_WORDS.items()) + " ELSE 'generic' END AS kind, "
          + "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains({RTEXT}, {w!r})' for w in ws)} THEN '{k}' END" for k, ws in repos.INDUSTRY_WORDS.items()) + "], lambda x: x IS NOT NULL) AS ind0, "
          + f"CAST(floor(stars * 18e-3 + forks * 28e-2 + CASE WHEN {' OR '.join(f'contains({RTEXT}, {w!r})' for w in repos.PLATFORM_WORDS)} THEN 40 ELSE 0 END + 5e-1) AS BIGINT) AS estimated_use FROM rp),"
          + " rt AS (SELECT *, CASE WHEN len(ind0) = 0 THEN ['general'] ELSE ind0 END AS industries FROM rs)")


@query("normalize_projects", f"WITH {REPOS} SELECT id, full_name, description, language, stars, forks, strftime(pushed_at, '%Y-%m-%d') AS pushed, 'main' AS default_branch FROM rp")
def _(spark, sf):
    return _repos(spark, sf).select("id", "full_name", "description", "language", "stars", "forks", F.date_format("pushed_at", "yyyy-MM-dd").alias("pushed"), "default_branch")


@query("repo_score", f"WITH {REPOS}, {RSCORE} SELECT id, round(score, 4) AS score FROM rt")
def _(spark, sf):
    return repos.score_repos(_repos(spark, sf), F.lit("2024-06-30 00:00:00")).select("id", F.round("score", 4).alias("score"))


@query("repo_traits", f"WITH {REPOS}, {RSCORE} SELECT id, kind, array_to_string(industries, ',') AS industries, array_to_string(list_distinct([topic, kind] || industries).list_sort(), ',') AS tags, estimated_use FROM rt")
def _(spark, sf):
    return repos.score_repos(_repos(spark, sf), F.lit("2024-06-30 00:00:00")).select(
        "id", "kind", F.array_join("industries", ",").alias("industries"), F.array_join(F.sort_array("tags"), ",").alias("tags"), "estimated_use")


@query("best_repo_per_name", f"""WITH {REPOS}, {RSCORE}, k AS (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY score DESC, id) AS rn FROM rt)
 SELECT full_name, id, round(score, 4) AS score FROM k WHERE rn = 1""")
def _(spark, sf):
    return repos.best_repos(repos.score_repos(_repos(spark, sf), F.lit("2024-06-30 00:00:00"))).select("full_name", "id", F.round("score", 4).alias("score"))


@query("match_project_filters", f"WITH {REPOS}, {RSCORE} SELECT id, kind, estimated_use FROM rt WHERE estimated_use >= 60 AND kind = 'blog' AND list_contains(industries, 'media')")
def _(spark, sf):
    return repos.match_project_filters(repos.score_repos(_repos(spark, sf), F.lit("2024-06-30 00:00:00")), "blog", "media", 60).select("id", "kind", "estimated_use")


def _inc(words):
    return (f"NOT ({' OR '.join(f'contains(lower(path), {w!r})' for w in repos.IGNORED)}) AND list_contains({lst(repos.REVIEWABLE)}, {EXT}) AND ("
            + " OR ".join(f"contains(lower(path), '{w}')" for w in words) + ")")


RANK = """CASE WHEN regexp_matches(lower(path), 'auth|permission|policy|access|role') THEN 90 ELSE 0 END + CASE WHEN regexp_matches(lower(path), 'upload|storage|asset') THEN 75 ELSE 0 END
 + CASE WHEN regexp_matches(lower(path), 'admin|route|controller|middleware|graphql|api') THEN 60 ELSE 0 END + CASE WHEN regexp_matches(lower(path), 'config|bootstrap|seed|schema') THEN 40 ELSE 0 END
 - CASE WHEN regexp_matches(lower(path), 'test|spec') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(lower(path), 'users-permissions|authentication|graphql') THEN 45 ELSE 0 END"""


@query("path_include", f"WITH {CODE} SELECT path, {_inc(repos.PATH_WORDS)} AS included, {_inc(repos.MIRROR_WORDS)} AS mirrored, {RANK} AS path_rank FROM code")
def _(spark, sf):
    p = F.col("path")
    return code_files(spark, sf).select("path", repos.path_include(p).alias("included"), repos.mirror_path(p).alias("mirrored"), repos.rank_mirror_path(p).alias("path_rank"))


@query("mirror_select", f"""WITH RECURSIVE {CODE}, c AS (SELECT project, path, CAST(octet_length(encode(content)) AS BIGINT) AS size, {RANK} AS rank,
   row_number() OVER (PARTITION BY project ORDER BY {RANK} DESC, octet_length(encode(content)), path) AS rn FROM code WHERE {_inc(repos.MIRROR_WORDS)}),
 w AS (SELECT project, 0 AS rn, CAST(0 AS BIGINT) AS bytes, 0 AS taken, FALSE AS took FROM (SELECT DISTINCT project FROM c)
  UNION ALL SELECT c.project, w.rn + 1, CASE WHEN w.taken >= 5 OR (w.taken > 0 AND w.bytes + c.size > 3000) THEN w.bytes ELSE w.bytes + c.size END,
   CASE WHEN w.taken >= 5 OR (w.taken > 0 AND w.bytes + c.size > 3000) THEN w.taken ELSE w.taken + 1 END, NOT (w.taken >= 5 OR (w.taken > 0 AND w.bytes + c.size > 3000))
  FROM w JOIN c ON c.project = w.project AND c.rn = w.rn + 1)
 SELECT w.project, CAST(w.taken AS INTEGER) AS ord, c.path, c.size, c.rank FROM w JOIN c ON c.project = w.project AND c.rn = w.rn WHERE took""")
def _(spark, sf):
    return repos.mirror_select(code_files(spark, sf), 5, 180_000, 3000)


@query("language_share", f"""WITH {CODE}, l AS (SELECT project, CASE WHEN path LIKE '%.gradle' OR path LIKE '%.json' THEN 'unknown' ELSE {LANG_SQL} END AS language, count(*) AS n, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM code GROUP BY ALL)
 SELECT project, CAST(sum(n) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, first(language ORDER BY n DESC, language) AS top_language FROM l GROUP BY project""")
def _(spark, sf):
    return repos.language_share(code_files(spark, sf))


# ---------------------------------------------------------------- fingerprints
def _labels(tab, agg=True):
    return "list_filter([" + ", ".join(
        f"CASE WHEN bool_or(regexp_matches(concat(path, chr(10), content), '(?i){'|'.join(f'(?:{p})' for p in pats)}')) THEN '{label}' END" for label, pats in tab.items()) + "], lambda x: x IS NOT NULL)"


@query("fingerprint", f"""WITH {PAGES}, p AS (SELECT project, path, content FROM pg UNION ALL SELECT project, path, content FROM code),
 h AS (SELECT DISTINCT project, concat('/', array_to_string(string_split(regexp_replace(path, '^src/', ''), '/')[1:3], '/')) AS hint FROM p WHERE regexp_matches(lower(path), '(api|graphql|content-api|rest)')),
 hk AS (SELECT *, 1 AS one FROM h), ha AS (SELECT project, string_agg(hint, ',' ORDER BY hint) AS api_paths FROM hk GROUP BY project)
 SELECT p.project, count(*) AS file_count, array_to_string({_labels(fingerprint.PLATFORMS)}, ',') AS platforms, array_to_string({_labels(fingerprint.TECHNOLOGIES)}, ',') AS technologies,
  coalesce(first(api_paths), '') AS api_paths FROM p LEFT JOIN ha ON ha.project = p.project GROUP BY p.project""".replace("WITH ", f"WITH {CODE}, ", 1))
def _(spark, sf):
    files = page_files(spark, sf).unionByName(code_files(spark, sf))
    return fingerprint.fingerprint(files).select("project", "file_count", F.array_join("platforms", ",").alias("platforms"),
                                                 F.array_join("technologies", ",").alias("technologies"), F.array_join("api_paths", ",").alias("api_paths"))


@query("match_assets", f"""WITH {CODE}, h AS (SELECT DISTINCT project, lower(concat('/', array_to_string(string_split(regexp_replace(path, '^src/', ''), '/')[1:2], '/'))) AS token FROM code),
 t AS (SELECT project, token FROM (SELECT project, 'v' || substr(project, 5) AS token FROM code) GROUP BY ALL), a AS (SELECT DISTINCT trim(url) AS asset FROM pages)
 SELECT '/en/' AS token, asset FROM a WHERE contains(lower(asset), '/en/') UNION ALL SELECT '.example.o' AS token, asset FROM a WHERE contains(lower(asset), '.example.o')
 UNION ALL SELECT 'm' AS token, asset FROM a WHERE contains(lower(asset), 'm')""")
def _(spark, sf):
    prints = table(spark, sf, "pages").selectExpr("'x' AS project").distinct().selectExpr(
        "project", "array('M') AS platforms", "array('/en/') AS technologies", "array('.example.O') AS admin_paths", "CAST(array() AS array<string>) AS api_paths")
    out = fingerprint.match_assets(table(spark, sf, "pages").select(F.col("url").alias("asset")), prints)
    return out.select(F.explode("hit_tokens").alias("token"), "asset")
