"""Comments, taint, validation, merging, enrichment, coverage, chains, summaries, call logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import (CODE, CODE_FINDINGS, CODE_LINES, CODE_RULES, DOCS, FINDINGS, LANG_SQL, LINES, REVIEWS, SEV_RANK, code_files,
                             code_findings, code_rule_values, doc_findings, document_files, line_findings, review_findings, table)
from bindings.filter_queries import TIER, alt, lst
from riskloom.functions.joins import growing
from riskloom.operators import chains, comments, coverage, enrich, merge, monitor, risk, summary, taint, validate
from riskloom.sources.rules import Rule

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


# ---------------------------------------------------------------- comments
MARK = "CASE WHEN lg IN ('python', 'php') THEN '#' WHEN lg = 'xml' THEN '<!--' ELSE '//' END"
SUPP = ("upper(list_filter([" + ", ".join("regexp_extract(body, '(?i)%s', 1)" % p for p in comments.SUPPRESSIONS) + "], lambda x: x <> '')[1])")
COMMENTS = CODE_LINES + f""",
cl AS (SELECT *, {LANG_SQL} AS lg FROM code_lines),
st AS (SELECT project, path, line_no AS s FROM cl WHERE lg IN ('java', 'javascript', 'go') AND contains(line, '/*')),
blk AS (SELECT st.project, st.path, s, min(line_no) AS e FROM st JOIN cl ON cl.path = st.path AND cl.project = st.project AND cl.line_no >= s AND contains(cl.line, '*/') GROUP BY ALL),
mc AS (SELECT blk.project, blk.path, 'multi' AS kind, s AS start_line, e AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS body FROM blk JOIN cl ON cl.path = blk.path AND cl.project = blk.project AND line_no BETWEEN s AND e GROUP BY ALL),
sc AS (SELECT project, path, 'single' AS kind, line_no AS start_line, line_no AS end_line, substr(line, instr(line, {MARK}) + len({MARK})) AS body FROM cl
  WHERE contains(line, {MARK}) AND NOT EXISTS (SELECT 1 FROM blk WHERE blk.path = cl.path AND blk.project = cl.project AND line_no >= s AND line_no < e)),
cm AS (SELECT project, path, kind, start_line, end_line, CASE kind WHEN 'single' THEN trim(body) ELSE body END AS content, {SUPP} AS rule FROM (SELECT * FROM mc UNION ALL BY NAME SELECT * FROM sc))"""


def _comments(spark, sf):
    return comments.parse_comments(code_files(spark, sf))


@query("parse_comments", f"WITH {COMMENTS} SELECT project, path, kind, start_line, end_line, content, coalesce(rule, '') AS rules, FALSE AS unclosed FROM cm")
def _(spark, sf):
    return _comments(spark, sf).withColumn("rules", F.array_join("suppressions", ",")).drop("suppressions")


@query("comment_ranges", f"WITH {COMMENTS} SELECT project, path, kind, start_line, end_line FROM cm")
def _(spark, sf):
    return comments.comment_ranges(_comments(spark, sf)).drop("suppressions")


@query("suppressed_rules", f"WITH {COMMENTS} SELECT DISTINCT project, path, rule FROM cm WHERE rule <> ''")
def _(spark, sf):
    return comments.suppressed_rules(_comments(spark, sf))


ANY_LINE = [Rule("ANY-SQL", r"first pass|gbt: ignore", language="java", vuln_type="SQL_INJECTION", severity="high"),
            Rule("ANY-XSS", r"ignore: xss|gbt: disable", language="*", vuln_type="XSS", severity="high"),
            Rule("ANY-IDOR", r"gbt: disable", language="java", vuln_type="IDOR", severity="high")]


@query("suppress_findings", f"""WITH {COMMENTS}, fd AS (SELECT project, path, line_no, rule_id, vuln_type FROM cl, (VALUES ('ANY-SQL', '(?i)first pass|gbt: ignore', 'SQL_INJECTION', 'java'), ('ANY-XSS', '(?i)ignore: xss|gbt: disable', 'XSS', '*'), ('ANY-IDOR', '(?i)gbt: disable', 'IDOR', 'java')) AS r(rule_id, pat, vuln_type, rl)
  WHERE (rl = '*' OR rl = lg) AND regexp_matches(line, pat))
 SELECT project, path AS file, line_no AS line, rule_id, EXISTS (SELECT 1 FROM cm WHERE cm.path = fd.path AND cm.project = fd.project AND line_no BETWEEN start_line AND end_line AND cm.rule = fd.vuln_type) AS suppressed FROM fd""")
def _(spark, sf):
    f = line_findings(code_files(spark, sf), ANY_LINE, "quick_scan")
    return comments.suppress_findings(f, _comments(spark, sf)).select("project", "file", "line", "rule_id", "suppressed")


# ---------------------------------------------------------------- taint
SANS = "|".join(r.pattern for r in CODE_RULES if r.kind == "sanitizer" and r.language == "php")
SANJ = "|".join(r.pattern for r in CODE_RULES if r.kind == "sanitizer" and r.language == "java")
TAINT = CODE_LINES + f""",
cl AS (SELECT *, {LANG_SQL} AS lg FROM code_lines),
hit AS (SELECT DISTINCT project, path, line_no, kind, category, line FROM cl, {code_rule_values([r for r in CODE_RULES if r.kind in ('source', 'sink')])} WHERE rlang = lg AND regexp_matches(line, pat)),
nm AS (SELECT project, path, line_no AS sl, category AS sc, unnest(regexp_extract_all(line, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\b', 1)) AS name FROM hit WHERE kind = 'source'),
us AS (SELECT nm.project, nm.path, sl, sc, name, cl.line_no, CASE WHEN contains(cl.line, '+') OR contains(cl.line, concat('$', '{{')) THEN 15e-2 ELSE 0e0 END + CASE WHEN contains(cl.line, '(') AND contains(cl.line, ')') THEN 1e-1 ELSE 0e0 END
   - CASE WHEN (lg = 'php' AND regexp_matches(cl.line, '(?i){SANS}')) OR (lg = 'java' AND regexp_matches(cl.line, '(?i){SANJ}')) THEN 3e-1 ELSE 0e0 END AS delta,
   (lg = 'php' AND regexp_matches(cl.line, '(?i){SANS}')) OR (lg = 'java' AND regexp_matches(cl.line, '(?i){SANJ}')) AS san
   FROM nm JOIN cl ON cl.project = nm.project AND cl.path = nm.path AND cl.line_no > sl AND contains(cl.line, name) AND list_contains(regexp_extract_all(cl.line, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\b', 1), name)),
tp AS (SELECT us.project, us.path AS file, sl AS source_line, sc AS source_category, h.line_no AS sink_line, h.category AS sink_category, count(*) AS steps, bool_or(san) AS is_sanitized,
   round(least(1e0, greatest(0e0, 7e-1 + sum(delta))), 6) AS confidence, array_to_string(list_sort(list_distinct(list(name))), ',') AS variables
   FROM us JOIN (SELECT DISTINCT project, path, line_no, category FROM hit WHERE kind = 'sink') h ON h.project = us.project AND h.path = us.path AND h.line_no > sl AND us.line_no <= h.line_no GROUP BY ALL)"""


@query("taint_paths", f"WITH {TAINT} SELECT project, file, source_line, source_category, sink_line, sink_category, CAST(steps AS INTEGER) AS steps, is_sanitized, confidence, variables FROM tp")
def _(spark, sf):
    p = taint.taint_paths(code_files(spark, sf), CODE_RULES)
    return p.withColumn("variables", F.array_join(F.sort_array("variables"), ",")).withColumn("confidence", F.round("confidence", 6))


SINKSEV = "CASE sink_category WHEN 'command_exec' THEN 'critical' WHEN 'code_injection' THEN 'critical' WHEN 'deserialization' THEN 'critical' WHEN 'sql_injection' THEN 'high' WHEN 'xss' THEN 'high' ELSE 'medium' END"


@query("taint_findings", f"WITH {TAINT} SELECT project, file, sink_line AS line, concat_ws('-', 'TAINT', source_category, sink_category, source_line, sink_line) AS rule_id, {SINKSEV} AS severity FROM tp WHERE NOT is_sanitized AND confidence >= 5e-1")
def _(spark, sf):
    return taint.taint_findings(taint.taint_paths(code_files(spark, sf), CODE_RULES)).select("project", "file", "line", "rule_id", "severity")


@query("taint_summary", f"""WITH {TAINT}, g AS (SELECT *, {SINKSEV} AS sev, NOT is_sanitized AND confidence >= 5e-1 AS ok FROM tp)
 SELECT project, count(*) AS paths, count(*) FILTER (ok) AS findings, count(*) FILTER (ok AND sev = 'critical') AS critical, count(*) FILTER (ok AND sev = 'high') AS high, count(*) FILTER (ok AND sev = 'medium') AS medium, CAST(0 AS BIGINT) AS low FROM g GROUP BY project""")
def _(spark, sf):
    p = taint.taint_paths(code_files(spark, sf), CODE_RULES)
    return taint.taint_summary(p, taint.taint_findings(p))


@query("sanitizer_between", f"""WITH {TAINT} SELECT tp.project, tp.file, source_line, sink_line, sink_category, count(cl.line_no) AS n FROM tp LEFT JOIN cl ON cl.project = tp.project AND cl.path = tp.file AND cl.line_no >= source_line AND cl.line_no < sink_line
  AND ((lg = 'php' AND regexp_matches(cl.line, '(?i){SANS}')) OR (lg = 'java' AND regexp_matches(cl.line, '(?i){SANJ}'))) GROUP BY ALL""")
def _(spark, sf):
    files = code_files(spark, sf)
    s = taint.sanitizer_between(taint.taint_paths(files, CODE_RULES), files, CODE_RULES)
    return s.select("project", "file", "source_line", "sink_line", "sink_category", F.size("sanitizer_lines").cast("long").alias("n"))


# ---------------------------------------------------------------- validation
SHIFT = """sh AS (SELECT cf.*, trim(text) AS snip, CASE line % 4 WHEN 0 THEN line WHEN 1 THEN line + 3 WHEN 2 THEN greatest(line - 2, 1) ELSE line END AS claimed, CASE WHEN line % 7 = 3 THEN 'gone/none.java' ELSE file END AS cfile FROM cf)"""


def _shifted(spark, sf):
    f = code_findings(spark, sf)
    from riskloom.operators import scan

    t = scan.scan_lines(code_files(spark, sf), [r for r in CODE_RULES if r.kind == "sink"]).select(
        "project", F.col("path").alias("file"), "line", "rule_id", F.trim("text").alias("snippet"))
    f = f.join(growing(t), ["project", "file", "line", "rule_id"]).withColumn("orig", F.col("line"))
    f = f.withColumn("file", F.when(F.col("orig") % 7 == 3, "gone/none.java").otherwise(F.col("file")))
    f = f.withColumn("line", F.expr("CASE orig % 4 WHEN 0 THEN orig WHEN 1 THEN orig + 3 WHEN 2 THEN greatest(orig - 2, 1) ELSE orig END"))
    return f.withColumn("location", F.concat_ws(":", "file", "line"))


LISTED = "NOT (language = 'java' AND vuln_type = 'HARD_CODE_PASSWORD')"
VALID = f"""{SHIFT}, v AS (SELECT sh.*, code.content IS NULL AS gone, string_split(code.content, chr(10)) AS ls FROM sh LEFT JOIN code ON code.project = sh.project AND code.path = sh.cfile),
 w AS (SELECT *, list_filter(generate_series(1, len(ls)), lambda i: contains(lower(ls[i]), lower(snip))) AS hits FROM v),
 x AS (SELECT *, CASE WHEN gone OR claimed > len(ls) OR NOT ({LISTED}) THEN NULL WHEN list_contains(hits, claimed) THEN claimed ELSE hits[1] END AS fnd FROM w)"""


@query("validate_snippet", f"""WITH {CODE_FINDINGS}, {VALID} SELECT project, cfile AS file, line AS orig, rule_id, CAST(CASE WHEN fnd IS NOT NULL AND fnd <> claimed THEN fnd ELSE claimed END AS INTEGER) AS line,
  CASE WHEN gone THEN 'hallucination' WHEN fnd IS NOT NULL AND fnd <> claimed THEN 'corrected' ELSE 'valid' END AS validation FROM x""")
def _(spark, sf):
    return validate.validate_snippet(_shifted(spark, sf), code_files(spark, sf)).select("project", "file", "orig", "rule_id", "line", "validation")


def _win(n):
    return f"array_to_string(string_split(content, chr(10))[greatest(1, line - {n}):line + {n}], chr(10))"


SAN_HIT = ("CASE WHEN contains(vuln_type, 'SQL') THEN regexp_matches(%s, '%s') WHEN contains(vuln_type, 'XSS') THEN regexp_matches(%s, '%s') WHEN contains(vuln_type, 'COMMAND') THEN regexp_matches(%s, '%s') "
           "WHEN contains(vuln_type, 'PATH') THEN regexp_matches(%s, '%s') ELSE FALSE END") % sum(((_win(30), "|".join(validate.SANITIZERS[k])) for k in ("sql", "xss", "cmd", "path")), ())
DIM3 = """CASE WHEN contains(vuln_type, 'XSS') OR contains(vuln_type, 'OPEN_REDIRECT') THEN 3 ELSE 1 END AS rs, CASE WHEN vuln_type IN ('COMMAND_INJECTION', 'CODE_INJECTION', 'DESERIALIZATION') THEN 3 WHEN vuln_type IN ('SQL_INJECTION', 'PATH_TRAVERSAL') THEN 2
  WHEN vuln_type IN ('XSS', 'HARD_CODE_PASSWORD') THEN 1 ELSE 0 END AS im, CASE WHEN vuln_type IN ('SQL_INJECTION', 'COMMAND_INJECTION', 'PATH_TRAVERSAL') THEN 3 WHEN vuln_type IN ('XSS', 'OPEN_REDIRECT') THEN 2 ELSE 0 END AS cx"""
DOWN = "CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END"
VERIFY = f"""vp AS (SELECT cf.project, file, line, rule_id, vuln_type, severity, source, {SAN_HIT} OR regexp_matches({_win(30)}, '{"|".join(validate.SANITIZERS["general"])}') AS san, {DIM3},
  regexp_matches({_win(100)}, {alt(validate.SOURCE_MARKS)}) AS src, regexp_matches({_win(50)}, {alt(validate.SINK_MARKS)}) AS snk FROM cf JOIN code ON code.project = cf.project AND code.path = cf.file),
 vv AS (SELECT *, CASE WHEN NOT src OR NOT snk THEN 'false_positive' WHEN san THEN 'downgraded' ELSE 'confirmed' END AS verdict, CAST(floor(rs * 40 / 3e0 + im * 35 / 3e0 + cx * 25 / 3e0 + 5e-1) AS BIGINT) AS overall_score FROM vp)"""


@query("verify_path", f"WITH {CODE_FINDINGS}, {VERIFY} SELECT project, file, line, rule_id, verdict, CASE WHEN verdict = 'downgraded' THEN {DOWN} END AS adjusted_severity, overall_score FROM vv")
def _(spark, sf):
    return validate.verify_path(code_findings(spark, sf), code_files(spark, sf), strict=True).select(
        "project", "file", "line", "rule_id", "verdict", "adjusted_severity", "overall_score")


@query("verdict_stats", f"""WITH {CODE_FINDINGS}, {VERIFY} SELECT project, count(*) AS total, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'false_positive') AS false_positive,
  count(*) FILTER (verdict = 'downgraded') AS downgraded, CAST(0 AS BIGINT) AS needs_review, CAST(0 AS BIGINT) AS hallucinations, CAST(0 AS BIGINT) AS corrected FROM vv GROUP BY project""")
def _(spark, sf):
    return validate.verdict_stats(validate.verify_path(code_findings(spark, sf), code_files(spark, sf), strict=True))


@query("final_counts", f"""WITH {CODE_FINDINGS}, {VERIFY} SELECT project, count(*) AS total, count(*) FILTER (verdict <> 'false_positive') AS confirmed, CAST(0 AS BIGINT) AS model, count(*) FILTER (verdict <> 'false_positive') AS scan,
  CAST(1 AS BIGINT) AS calls, CAST(0 AS BIGINT) AS skipped FROM vv GROUP BY project""")
def _(spark, sf):
    f = validate.verify_path(code_findings(spark, sf), code_files(spark, sf), strict=True)
    calls = code_files(spark, sf).select("project").distinct().withColumn("called", F.lit(True))
    return merge.final_counts(f, calls)


@query("verify_chain", f"""WITH {CODE} SELECT project, path AS file, CAST(p_partkey % 30 AS INTEGER) AS line, CAST(CASE WHEN p_partkey % 30 BETWEEN 1 AND len(string_split(content, chr(10))) THEN p_partkey % 30
  ELSE list_filter(generate_series(1, len(string_split(content, chr(10)))), lambda i: contains(lower(string_split(content, chr(10))[i]), 'item'))[1] END AS INTEGER) AS verified_line FROM code""")
def _(spark, sf):
    from bindings.filter_queries import _code_with_key

    nodes = _code_with_key(spark, sf).select("project", F.col("path").alias("file"), (F.col("p_partkey") % 30).cast("int").alias("line"), F.lit("Item").alias("method"))
    return validate.verify_chain(nodes, code_files(spark, sf)).select("project", "file", "line", "verified_line")


NEED = "CASE vuln_type " + " ".join(f"WHEN '{t}' THEN {lst(e)}" for t, e in [(t, v[1]) for t, v in __import__('riskloom.dims', fromlist=['SINKS']).SINKS.items()]) + " END"
EVID = f"""ev AS (SELECT *, CASE WHEN line % 2 = 0 THEN {NEED}[1:2] ELSE {NEED} END AS have, {NEED} AS need FROM cf), em AS (SELECT *, list_filter(coalesce(need, []), lambda x: NOT list_contains(have, x)) AS miss FROM ev)"""


def _with_evidence(spark, sf):
    from riskloom import dims

    f = code_findings(spark, sf)
    need = F.broadcast(dims.sink_dim(spark).select("vuln_type", F.col("required_evidence").alias("need")))
    return f.join(need, "vuln_type", "left").withColumn("evidence_points", F.when(F.col("line") % 2 == 0, F.slice("need", 1, 2)).otherwise(F.col("need"))).drop("need")


@query("missing_evidence", f"WITH {CODE_FINDINGS}, {EVID} SELECT file, line, rule_id, array_to_string(miss, ',') AS missing, CASE WHEN need IS NULL THEN 'N/A' WHEN len(miss) > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness FROM em")
def _(spark, sf):
    return validate.missing_evidence(_with_evidence(spark, sf)).select("file", "line", "rule_id", F.array_join("missing_evidence", ",").alias("missing"), "completeness")


RISKS = f"""{EVID}, rk AS (SELECT em.*, {DIM3}, CASE line % 3 WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'PARTIAL' END AS ts FROM em),
 rs AS (SELECT *, CAST(least(floor(rs * 40 / 3e0 + im * 35 / 3e0 + cx * 25 / 3e0 + CASE ts WHEN 'UNRESOLVED' THEN 40 WHEN 'PARTIAL' THEN 20 ELSE 0 END + CASE WHEN need IS NOT NULL THEN len(miss) * 15 ELSE 0 END + 30
   + CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 WHEN 'low' THEN 5 ELSE 0 END + 5e-1), 100) AS BIGINT) AS risk_score FROM rk),
 re AS (SELECT *, CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS priority FROM rs)"""


def _risks(spark, sf):
    f = _with_evidence(spark, sf)
    traces = f.select("project", "location", F.expr("CASE line % 3 WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'PARTIAL' END AS trace_status")).distinct()
    return risk.risk_entries(f, traces)


@query("risk_entries", f"WITH {CODE_FINDINGS}, {RISKS} SELECT file, line, rule_id, risk_score, priority FROM re")
def _(spark, sf):
    return _risks(spark, sf).select("file", "line", "rule_id", "risk_score", "priority")


@query("risk_pool", f"""WITH {CODE_FINDINGS}, {RISKS} SELECT project, count(*) AS total, count(*) FILTER (priority = 'high') AS high_count, count(*) FILTER (priority = 'medium') AS medium_count, count(*) FILTER (priority = 'low') AS low_count,
  CAST(floor(avg(risk_score) + 5e-1) AS BIGINT) AS avg_score FROM re GROUP BY project""")
def _(spark, sf):
    return risk.risk_pool(_risks(spark, sf))


# ---------------------------------------------------------------- merging and enrichment
def _both(spark, sf):
    return merge.union_detectors([doc_findings(spark, sf), review_findings(spark, sf)])


BOTH = f"{FINDINGS}, {REVIEWS}, u AS (SELECT * FROM f UNION ALL BY NAME SELECT * FROM rv)"


@query("union_detectors", f"WITH {BOTH} SELECT source, rule_id, file, line FROM u")
def _(spark, sf):
    return _both(spark, sf).select("source", "rule_id", "file", "line")


@query("normalize_type", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'SQL_INJECTION' WHEN 1 THEN 'XXE_INJECTION' WHEN 2 THEN 'CSRF' WHEN 3 THEN 'SSRF' ELSE 'CODE_INJECTION' END AS canonical_type FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN 'SQL_INJECTION_HQL' WHEN 1 THEN 'XXE' WHEN 2 THEN 'CSRF_MISSING' WHEN 3 THEN 'SSRF' ELSE 'SPEL_INJECTION' END AS vuln_type")
    return merge.normalize_type(o).select("o_orderkey", "canonical_type")


NORM = "CASE vuln_type WHEN 'HARD_CODE_PASSWORD' THEN 'HARDCODED_CREDENTIALS' ELSE vuln_type END"
MERGED = f"""n AS (SELECT *, lower(regexp_replace(file, '^.*/', '')) AS bn, {NORM} AS nt FROM u), m AS (SELECT *, row_number() OVER (ORDER BY {SEV_RANK} DESC, confidence DESC, source, file, line, vuln_type, rule_id) AS ord FROM n WHERE source = 'llm'),
 hit AS (SELECT s.project, s.source, s.file, s.line, s.rule_id, s.vuln_type, min(m.ord) AS ord FROM n s LEFT JOIN m ON m.project = s.project AND m.bn = s.bn AND m.nt = s.nt AND abs(m.line - s.line) <= 5 WHERE s.source = 'quick_scan' GROUP BY ALL)"""


@query("cross_source_merge", f"""WITH {BOTH}, {MERGED}, kept AS (SELECT m.project, m.source, m.file, m.line, m.rule_id, m.vuln_type, m.severity, m.confidence, (SELECT count(*) FROM hit WHERE hit.ord = m.ord) AS merged_count FROM m
   UNION ALL SELECT n.project, n.source, n.file, n.line, n.rule_id, n.vuln_type, n.severity, n.confidence, 0 FROM n JOIN hit ON hit.file = n.file AND hit.line = n.line AND hit.rule_id = n.rule_id AND n.source = 'quick_scan' WHERE hit.ord IS NULL),
 d AS (SELECT *, row_number() OVER (PARTITION BY project, file, line, vuln_type ORDER BY CASE WHEN source = 'llm' THEN 0 ELSE 1 END, {SEV_RANK} DESC, confidence DESC, source, rule_id) AS rn FROM kept)
 SELECT source, file, line, rule_id, merged_count FROM d WHERE rn = 1""")
def _(spark, sf):
    kept, _merged = merge.cross_source_merge(_both(spark, sf))
    return kept.select("source", "file", "line", "rule_id", "merged_count")


@query("merged_from", f"WITH {BOTH}, {MERGED} SELECT m.file AS into_file, m.line AS into_line, m.rule_id AS into_rule, hit.source, hit.file AS dropped_file, hit.line AS dropped_line FROM hit JOIN m ON m.ord = hit.ord")
def _(spark, sf):
    from riskloom.functions import paths

    _kept, merged = merge.cross_source_merge(_both(spark, sf))
    at = paths.split_location(F.col("location"))
    return merged.select(F.col("into.file").alias("into_file"), F.col("into.line").alias("into_line"), F.col("into.rule_id").alias("into_rule"),
                         "source", at["file"].alias("dropped_file"), at["line"].alias("dropped_line"))


PRIO = f"""{FINDINGS}, {REVIEWS}, u0 AS (SELECT * FROM f UNION ALL BY NAME SELECT * FROM rv),
 u1 AS (SELECT *, row_number() OVER (PARTITION BY project, vuln_type, lower(regexp_replace(file, '^.*/', '')), line // 5, source ORDER BY line, file, rule_id) AS r0 FROM u0), u AS (SELECT * EXCLUDE (r0) FROM u1 WHERE r0 = 1)"""


@query("merge_prioritize", f"""WITH {PRIO}, {MERGED}, kept AS (SELECT m.project, m.source, m.file, m.line, m.rule_id, m.vuln_type, m.severity, m.cwe, m.confidence, (SELECT count(*) FROM hit WHERE hit.ord = m.ord) AS merged_count FROM m
   UNION ALL SELECT n.project, n.source, n.file, n.line, n.rule_id, n.vuln_type, n.severity, n.cwe, n.confidence, 0 FROM n JOIN hit ON hit.file = n.file AND hit.line = n.line AND hit.rule_id = n.rule_id AND n.source = 'quick_scan' WHERE hit.ord IS NULL),
 d AS (SELECT *, row_number() OVER (PARTITION BY project, file, line, vuln_type ORDER BY CASE WHEN source = 'llm' THEN 0 ELSE 1 END, {SEV_RANK} DESC, confidence DESC, source, rule_id) AS rn FROM kept)
 SELECT project, source, file, line, rule_id, CASE vuln_type WHEN 'INFO_LEAK' THEN 'INFORMATION_DISCLOSURE' ELSE vuln_type END AS vuln_type, cwe, CASE vuln_type WHEN 'INFO_LEAK' THEN 'A01:2021' ELSE '' END AS owasp, 'GB/T39412-2020' AS gbt,
  CASE severity WHEN 'critical' THEN 95e-1 WHEN 'high' THEN 75e-1 WHEN 'medium' THEN 5e0 WHEN 'low' THEN 25e-1 WHEN 'info' THEN 1e-1 END AS cvss, confidence, merged_count FROM d WHERE rn = 1""")
def _(spark, sf):
    return merge.merge_prioritize(_both(spark, sf)).select("project", "source", "file", "line", "rule_id", "vuln_type", "cwe", "owasp", "gbt", "cvss", "confidence", "merged_count")


@query("type_gap_map", f"""WITH {BOTH}, g AS (SELECT project, file AS gap_file, {NORM} AS norm_type, max_by(severity, {SEV_RANK}) AS max_severity, count(*) AS findings, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line, severity) AS lines FROM u s WHERE source = 'quick_scan'
  AND NOT EXISTS (SELECT 1 FROM rv WHERE rv.file = s.file AND rv.vuln_type = s.vuln_type) GROUP BY ALL HAVING max({SEV_RANK}) >= 3)
 SELECT project, gap_file, norm_type, max_severity, findings, lines FROM g""")
def _(spark, sf):
    g = merge.type_gap_map(_both(spark, sf))
    return g.select("project", "gap_file", "norm_type", "max_severity", "findings", F.array_join(F.transform("members", lambda m: m["line"].cast("string")), ",").alias("lines"))


@query("group_members", f"WITH {FINDINGS} SELECT project, file, vuln_type, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line, location, severity, title) AS lines FROM f GROUP BY ALL")
def _(spark, sf):
    g = merge.group_members(doc_findings(spark, sf), ["project", "file", "vuln_type"])
    return g.select("project", "file", "vuln_type", F.size("members").cast("long").alias("n"), F.array_join(F.transform("members", lambda m: m["line"].cast("string")), ",").alias("lines"))


@query("unverified_flag", f"WITH {BOTH} SELECT source, file, line, rule_id, source = 'quick_scan' AND severity IN ('critical', 'high') AND NOT EXISTS (SELECT 1 FROM rv WHERE rv.file = u.file AND rv.vuln_type = u.vuln_type) AS unverified FROM u")
def _(spark, sf):
    return merge.unverified_flag(_both(spark, sf)).select("source", "file", "line", "rule_id", "unverified")


@query("uncovered_files", f"""WITH {BOTH}, h AS (SELECT project, file AS path, bool_or(source = 'llm') AS m FROM u GROUP BY ALL), x AS (SELECT project, path FROM docs WHERE path NOT IN (SELECT path FROM h))
 SELECT project, path, 'no_model_finding' AS reason FROM h WHERE NOT m UNION ALL SELECT project, path, 'never_reported' FROM x""")
def _(spark, sf):
    return merge.uncovered_files(document_files(spark, sf), _both(spark, sf))


ETYPE = "CASE vuln_type WHEN 'HARD_CODE_PASSWORD' THEN 'HARDCODED_CREDENTIALS' ELSE vuln_type END"


@query("enrich_findings", f"""WITH {CODE_FINDINGS}, e AS (SELECT *, {ETYPE} AS t FROM cf) SELECT file, line, rule_id, t AS vuln_type, CASE WHEN line % 2 = 0 THEN CASE t WHEN 'SQL_INJECTION' THEN 'CWE-89' WHEN 'COMMAND_INJECTION' THEN 'CWE-78' WHEN 'PATH_TRAVERSAL' THEN 'CWE-22' WHEN 'OPEN_REDIRECT' THEN 'CWE-601'
   WHEN 'HARDCODED_CREDENTIALS' THEN 'CWE-798' WHEN 'DESERIALIZATION' THEN 'CWE-502' WHEN 'XSS' THEN 'CWE-79' WHEN 'CODE_INJECTION' THEN 'CWE-94' END ELSE cwe END AS cwe,
  CASE t WHEN 'PATH_TRAVERSAL' THEN 'A01:2021' WHEN 'OPEN_REDIRECT' THEN 'A01:2021' WHEN 'HARDCODED_CREDENTIALS' THEN 'A07:2021' WHEN 'DESERIALIZATION' THEN 'A08:2021' ELSE 'A03:2021' END AS owasp,
  CASE WHEN t = 'SQL_INJECTION' AND language = 'java' THEN 'J-1' ELSE CASE t WHEN 'SQL_INJECTION' THEN 'D-1' ELSE 'GB/T39412-2020' END END AS gbt,
  CASE severity WHEN 'critical' THEN 95e-1 WHEN 'high' THEN 75e-1 WHEN 'medium' THEN 5e0 ELSE 25e-1 END AS cvss FROM e""")
def _(spark, sf):
    f = code_findings(spark, sf).withColumn("cwe", F.when(F.col("line") % 2 == 0, "unknown").otherwise(F.col("cwe")))
    return enrich.enrich_findings(f, {"SQL_INJECTION": {"java": "J-1", "default": "D-1"}}).select("file", "line", "rule_id", "vuln_type", "cwe", "owasp", "gbt", "cvss")


@query("fix_location", f"""WITH {CODE_FINDINGS}, b AS (SELECT project, lower(regexp_replace(path, '^.*/', '')) AS bn, max(path) AS full_path FROM code GROUP BY ALL)
 SELECT cf.project, rule_id, cf.line, coalesce(concat(full_path, ':', line), location) AS location FROM cf LEFT JOIN b ON b.project = cf.project AND b.bn = lower(regexp_replace(file, '^.*/', ''))""")
def _(spark, sf):
    from riskloom.functions import paths

    f = code_findings(spark, sf).withColumn("location", F.concat_ws(":", F.upper(paths.basename(F.col("file"))), "line"))
    return enrich.fix_location(f, code_files(spark, sf)).select("project", "rule_id", "line", "location")


REVIEW_TEXT = """CASE conv_id % 3 WHEN 0 THEN concat_ws(chr(10), 'Summary', '| File | Endpoint | Issue |', '|---|---|---|', concat('| App', turn, '.java | /a | SQL injection risk in turn ', turn, ' |'), '| Readme | /b | fine |', 'done')
  WHEN 1 THEN concat('Please check Service', turn, '.py: possible XSS in the page writer', chr(10), text) ELSE text END"""


@query("findings_from_text", f"""WITH t AS (SELECT concat(conv_id, '-', turn) AS doc_id, conv_id, turn, {REVIEW_TEXT} AS text FROM conversations)
 SELECT doc_id, concat('App', turn, '.java') AS location, concat('SQL injection risk in turn ', turn) AS title FROM t WHERE conv_id % 3 = 0
 UNION ALL SELECT doc_id, concat('Service', turn, '.py:?'), 'possible XSS in the page writer' FROM t WHERE conv_id % 3 = 1""")
def _(spark, sf):
    t = table(spark, sf, "conversations").selectExpr("concat(conv_id, '-', turn) AS doc_id", f"{REVIEW_TEXT} AS text")
    return enrich.findings_from_text(t, head_words=["issue", "file"], row_words=["injection", "risk"]).select("doc_id", "location", "title")


JSON_TEXT = """CASE conv_id % 4 WHEN 0 THEN concat('Here it is: ```json', chr(10), '{"findings":[{"title":"T', turn, '","severity":"HIGH","location":"a/b.java:', turn, '","vulnType":"xss","confidence":0.9,"cvssScore":"7.77"}]}', chr(10), '```')
  WHEN 1 THEN concat('Result {"findings":[{"title":"","severity":"odd","location":"x.py","vulnType":"IDOR","confidence":2},{"title":"low","confidence":0.2}]} end') WHEN 2 THEN '{"findings":[{"title": broken' ELSE text END"""


@query("parse_finding_json", """WITH t AS (SELECT * FROM conversations) SELECT concat(conv_id, '-', turn) AS doc_id, concat('T', turn) AS title, 'high' AS severity, concat('a/b.java:', turn) AS location, 'XSS' AS vuln_type, 9e-1 AS confidence, 78e-1 AS cvss FROM t WHERE conv_id % 4 = 0
 UNION ALL SELECT concat(conv_id, '-', turn), 'Reviewer finding', 'medium', 'x.py', 'IDOR', 1e0, 5e0 FROM t WHERE conv_id % 4 = 1""")
def _(spark, sf):
    t = table(spark, sf, "conversations").selectExpr("concat(conv_id, '-', turn) AS doc_id", f"{JSON_TEXT} AS text")
    good, _bad = enrich.parse_finding_json(t)
    return good.select("doc_id", "title", "severity", "location", "vuln_type", "confidence", "cvss")


@query("unparsed_reviews", "SELECT concat(conv_id, '-', turn) AS doc_id FROM conversations WHERE conv_id % 4 > 1")
def _(spark, sf):
    t = table(spark, sf, "conversations").selectExpr("concat(conv_id, '-', turn) AS doc_id", f"{JSON_TEXT} AS text")
    return enrich.parse_finding_json(t)[1].select("doc_id")


# ---------------------------------------------------------------- coverage
CODE_EXT = "regexp_matches(path, '[.](java|py|js|ts|go|php|rb|cs|cpp|c|rs|kt|swift|scala)$')"
from riskloom.functions.paths import PLUMBING  # noqa: E402

SUB = f"""CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT contains(x, '.') AND NOT list_contains({lst(PLUMBING)}, lower(x)))) > 0
    THEN array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT contains(x, '.') AND NOT list_contains({lst(PLUMBING)}, lower(x)))[1:2], '/') ELSE split_part(path, '/', 1) END"""
# findings of two rules only, so that some files stay unreviewed
FEW = "few AS (SELECT * FROM cf WHERE rule_id IN ('JAVA-EXEC', 'PHP-DES', 'JS-EVAL'))"
COVER = f"{FEW}, wr AS (SELECT code.project, code.path, {SUB} AS sub, EXISTS (SELECT 1 FROM few WHERE few.project = code.project AND few.file = code.path) AS reviewed FROM code)"


def _few(spark, sf):
    return code_findings(spark, sf).where(F.col("rule_id").isin("JAVA-EXEC", "PHP-DES", "JS-EVAL"))


@query("coverage_report", f"""WITH {CODE_FINDINGS}, {COVER}, a AS (SELECT project, count(DISTINCT vuln_type) AS n FROM few GROUP BY project)
 SELECT wr.project, count(*) AS total_files, count(*) FILTER (reviewed) AS reviewed_files, count(*) FILTER (NOT reviewed AND {CODE_EXT}) AS unreviewed_files, coalesce(first(a.n), 0) AS attack_classes,
  CAST(floor(count(*) FILTER (reviewed) * 1e2 / count(*) + 5e-1) AS BIGINT) AS coverage_percent FROM wr LEFT JOIN a ON a.project = wr.project GROUP BY wr.project""")
def _(spark, sf):
    return coverage.coverage_report(code_files(spark, sf), _few(spark, sf))


@query("subsystem_coverage", f"WITH {CODE_FINDINGS}, {COVER} SELECT project, sub AS subsystem, count(*) AS total, count(*) FILTER (reviewed) AS reviewed FROM wr GROUP BY ALL")
def _(spark, sf):
    return coverage.subsystem_coverage(code_files(spark, sf), _few(spark, sf))


GAPS = f"""{COVER}, gp AS (SELECT project, path, {TIER} AS tier FROM wr WHERE NOT reviewed AND {CODE_EXT})"""


@query("gap_targets", f"""WITH {CODE_FINDINGS}, {GAPS}, t2 AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY path) AS rn FROM gp WHERE tier = 'T2' AND project NOT IN (SELECT project FROM gp WHERE tier = 'T1'))
 SELECT project, path, tier, tier = 'T1' OR path IN (SELECT path FROM t2 WHERE t2.project = gp.project) AS urgent FROM gp""")
def _(spark, sf):
    return coverage.gap_targets(code_files(spark, sf), _few(spark, sf))


@query("gap_summary", f"""WITH {CODE_FINDINGS}, {GAPS}, s AS (SELECT project, count(*) FILTER (tier = 'T1') AS missed_t1, count(*) FILTER (tier = 'T2') AS missed_t2, count(*) FILTER (tier = 'T3') AS missed_t3 FROM gp GROUP BY project)
 SELECT *, missed_t1 > 0 OR missed_t2 > 0 AS needs_gapfill, CASE WHEN missed_t1 > 0 THEN concat(missed_t1, ' entry files not covered') WHEN missed_t2 > 0 THEN concat(missed_t2, ' service files not covered') ELSE 'all priority files covered' END AS summary FROM s""")
def _(spark, sf):
    return coverage.gap_summary(coverage.gap_targets(code_files(spark, sf), _few(spark, sf)))


EXTC = "CASE regexp_extract(path, '[.]([a-z]+)$', 1) " + " ".join(f"WHEN '{e}' THEN {lst(c)}" for e, c in coverage.CLASSES_BY_EXTENSION.items()) + f" ELSE {lst(coverage.OTHER_CLASSES)} END"
SPOTS = f"""{COVER}, ac AS (SELECT unnest({lst(coverage.ATTACK_CLASSES)}) AS attack_class, unnest(generate_series(0, {len(coverage.ATTACK_CLASSES) - 1})) AS ord),
 nv AS (SELECT s.project, s.sub, attack_class, ord, 0 AS pass, CAST(NULL AS VARCHAR) AS target_file FROM (SELECT DISTINCT project, sub FROM wr) s, ac WHERE NOT EXISTS (SELECT 1 FROM few JOIN wr w ON w.project = few.project AND w.path = few.file WHERE w.project = s.project AND w.sub = s.sub AND few.vuln_type = attack_class)),
 un AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) AS rn FROM wr WHERE NOT reviewed AND {CODE_EXT} AND regexp_matches(lower(path), '{coverage.HIGH_SIGNAL}')),
 ft AS (SELECT project, sub, unnest({EXTC}) AS attack_class, unnest(generate_series(0, len({EXTC}) - 1)) AS ord, 1 AS pass, path AS target_file FROM un),
 al AS (SELECT *, row_number() OVER (PARTITION BY project, sub, attack_class ORDER BY pass, target_file, ord) AS r1 FROM (SELECT * FROM nv UNION ALL SELECT * FROM ft)),
 bs AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY pass, sub, ord, attack_class) AS r2 FROM al WHERE r1 = 1)"""


@query("blind_spots", f"WITH {CODE_FINDINGS}, {SPOTS} SELECT project, sub AS subsystem, attack_class, CASE pass WHEN 0 THEN 'never_checked' ELSE 'unreviewed_file' END AS reason FROM bs")
def _(spark, sf):
    return coverage.blind_spots(code_files(spark, sf), _few(spark, sf)).drop("target_file")


KW = "CASE attack_class " + " ".join("WHEN '%s' THEN list_filter(%s, lambda w: contains(content, w))[1]" % (c, lst(w)) for c, w in coverage.SINK_WORDS.items()) + " END"


@query("gap_tasks", f"""WITH {CODE_FINDINGS}, {SPOTS}, sp AS (SELECT * FROM bs), tg AS (SELECT code.project, code.path, content FROM code JOIN un ON un.project = code.project AND un.path = code.path),
 h AS (SELECT sp.project, sp.sub AS subsystem, attack_class, tg.path AS target, content, {KW} AS keyword FROM sp JOIN tg ON tg.project = sp.project AND (target_file IS NULL OR target_file = tg.path)),
 k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY subsystem, attack_class, target) AS rn FROM h WHERE keyword IS NOT NULL)
 SELECT project, subsystem, attack_class, target, keyword, CAST(len(string_split(substr(content, 1, instr(content, keyword) - 1), chr(10))) AS INTEGER) AS line FROM k""")
def _(spark, sf):
    files, few = code_files(spark, sf), _few(spark, sf)
    return coverage.gap_tasks(coverage.blind_spots(files, few), files, few)


# ---------------------------------------------------------------- chains and summaries
FAM = "CASE vuln_type " + " ".join(f"WHEN '{t}' THEN '{v[0]}'" for t, v in __import__('riskloom.dims', fromlist=['SINKS']).SINKS.items()) + " ELSE vuln_type END"
W_ = f"greatest({SEV_RANK}, 1)"
CHAIN = f"""cc AS (SELECT *, concat(regexp_replace(file, '/[^/]*$', ''), ':', vuln_type) AS cluster, {FAM} AS fam, {W_} AS w, row_number() OVER (ORDER BY project, file, line, rule_id) AS id FROM cf WHERE contains(file, '/')
   UNION ALL SELECT *, concat('root:', vuln_type), {FAM}, {W_}, -row_number() OVER (ORDER BY project, file, line, rule_id) FROM cf WHERE NOT contains(file, '/')),
 ed AS (SELECT a.project, a.cluster, a.fam AS from_sink, b.fam AS to_sink, CASE WHEN {" OR ".join(f"(a.fam = '{s}' AND b.fam IN ({', '.join(repr(t) for t in ts)}))" for s, ts in chains.FLOWS.items())} THEN 'data_flow' ELSE 'control_flow' END AS link, count(*) AS n, CAST(sum(a.w) AS BIGINT) AS from_points
   FROM cc a JOIN cc b ON a.project = b.project AND a.cluster = b.cluster AND a.id <> b.id GROUP BY ALL),
 cb AS (SELECT project, cluster, CAST(sum(n) AS BIGINT) AS connections, sum(from_points * CASE link WHEN 'data_flow' THEN 1e0 ELSE 8e-1 END * 3e-1) AS bonus FROM ed GROUP BY ALL),
 cs AS (SELECT project, cluster, count(*) AS length, sum(w) AS pts, count(DISTINCT file) AS files FROM cc GROUP BY ALL),
 ch AS (SELECT cs.project, cs.cluster, length, files, connections, CAST(least(floor((pts + least(length * 10, 30) + least(bonus, 2e1)) / length + 5e-1), 100) AS BIGINT) AS raw_risk,
   CAST(least(100, floor(pts * 1e1 / length + 5e-1) + floor(least(length * 10, 30) + least(bonus, 2e1) + 5e-1)) AS BIGINT) AS risk FROM cs JOIN cb ON cb.project = cs.project AND cb.cluster = cs.cluster WHERE length >= 2)"""
CSEV = "CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 60 THEN 'high' WHEN risk >= 40 THEN 'medium' ELSE 'low' END"


@query("chain_edges", f"WITH {CODE_FINDINGS}, {CHAIN} SELECT project, cluster, from_sink, to_sink, link, n, from_points FROM ed")
def _(spark, sf):
    return chains.chain_edges(code_findings(spark, sf))


@query("chains", f"WITH {CODE_FINDINGS}, {CHAIN} SELECT project, cluster, length, files, connections, raw_risk, risk, {CSEV} AS severity FROM ch")
def _(spark, sf):
    return chains.chains(code_findings(spark, sf)).drop("exploitability")


@query("chain_report", f"""WITH {CODE_FINDINGS}, {CHAIN}, s AS (SELECT *, {CSEV} AS sev FROM ch) SELECT project, count(*) AS total_chains, count(*) FILTER (sev = 'critical') AS critical_count, count(*) FILTER (sev = 'high') AS high_count,
  count(*) FILTER (sev = 'medium') AS medium_count, CAST(floor(avg(risk) + 5e-1) AS BIGINT) AS avg_risk FROM s GROUP BY project""")
def _(spark, sf):
    return chains.chain_report(chains.chains(code_findings(spark, sf)))


@query("shared_evidence", """SELECT o_orderkey, list_has_any([o_orderpriority, o_orderstatus], ['1-URGENT', 'F']) AS shared FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", chains.shared_evidence(F.array("o_orderpriority", "o_orderstatus"), F.array(F.lit("1-URGENT"), F.lit("F"))).alias("shared"))


@query("summary_by", f"""WITH {BOTH}, x AS (SELECT project, severity, CASE WHEN confidence >= 8e-1 THEN 'high' WHEN confidence >= 5e-1 THEN 'medium' ELSE 'low' END AS band, source, vuln_type FROM u)
 SELECT project, 'severity' AS dimension, severity AS value, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT project, 'confidence_band', band, count(*) FROM x GROUP BY ALL
 UNION ALL SELECT project, 'source', source, count(*) FROM x GROUP BY ALL UNION ALL SELECT project, 'vuln_type', vuln_type, count(*) FROM x GROUP BY ALL""")
def _(spark, sf):
    return summary.summary_by(_both(spark, sf))


@query("project_summary", f"""WITH {FINDINGS}, g AS (SELECT project, count(DISTINCT file) AS fw, count(*) AS tf, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM f GROUP BY project)
 SELECT d.project, count(*) AS total_files, coalesce(first(fw), 0) AS files_with_findings, coalesce(first(tf), 0) AS total_findings, coalesce(first(c), 0) AS critical, coalesce(first(h), 0) AS high, coalesce(first(m), 0) AS medium, coalesce(first(l), 0) AS low
 FROM docs d LEFT JOIN g ON g.project = d.project GROUP BY d.project""")
def _(spark, sf):
    return summary.project_summary(document_files(spark, sf), doc_findings(spark, sf))


@query("rule_fp_rate", f"""WITH {FINDINGS}, v AS (SELECT rule_id, quality = 0 AS is_fp FROM f JOIN docs ON docs.path = f.file JOIN labels USING (doc_id))
 SELECT rule_id, count(*) AS total, count(*) FILTER (is_fp) AS false_positives, round(avg(CAST(is_fp AS INTEGER)), 6) AS fp_rate FROM v GROUP BY rule_id""")
def _(spark, sf):
    verdicts = table(spark, sf, "labels").join(table(spark, sf, "documents").selectExpr("doc_id", "concat(source, '/', lang, '/doc_', doc_id, '.txt') AS file"), "doc_id")
    v = doc_findings(spark, sf).join(verdicts, "file").select("rule_id", (F.col("quality") == 0).alias("is_fp"))
    return summary.rule_fp_rate(v).withColumn("fp_rate", F.round("fp_rate", 6))


SIM = "1e0 - levenshtein(a.t, b.t) / greatest(len(a.t), len(b.t)) >= 8e-1"


@query("cluster_similar", f"""WITH RECURSIVE {CODE_FINDINGS}, t AS (SELECT rule_id, match AS t, min((file, line)) AS o, count(*) AS n FROM cf WHERE match <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY o, t) AS i FROM t),
 e AS (SELECT a.rule_id, a.i AS ai, b.i AS bi FROM k a JOIN k b ON a.rule_id = b.rule_id AND a.i < b.i AND {SIM}),
 w AS (SELECT DISTINCT rule_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders FROM k
   UNION ALL SELECT w.rule_id, w.i + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.rule_id = w.rule_id AND e.bi = w.i + 1 AND list_contains(w.leaders, e.ai)) THEN w.leaders ELSE list_append(w.leaders, w.i + 1) END
   FROM w WHERE EXISTS (SELECT 1 FROM k WHERE k.rule_id = w.rule_id AND k.i = w.i + 1)),
 z AS (SELECT rule_id, unnest(leaders) AS li FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY i DESC) AS r FROM w) WHERE r = 1),
 m AS (SELECT k.rule_id, k.n, CASE WHEN z.li IS NOT NULL THEN k.i ELSE (SELECT min(e.ai) FROM e JOIN z y ON y.rule_id = e.rule_id AND y.li = e.ai WHERE e.rule_id = k.rule_id AND e.bi = k.i) END AS l FROM k LEFT JOIN z ON z.rule_id = k.rule_id AND z.li = k.i)
 SELECT m.rule_id, k.t AS leader, CAST(sum(m.n) AS BIGINT) AS members, count(*) AS texts FROM m JOIN k ON k.rule_id = m.rule_id AND k.i = m.l GROUP BY ALL HAVING sum(m.n) > 1""")
def _(spark, sf):
    return summary.similar_clusters(code_findings(spark, sf))


# ---------------------------------------------------------------- call logs
def _calls(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id AS id", "ts", "user_id AS key", "event_type <> 'error' AS ok", "value AS duration")


@query("failure_stats", """WITH s AS (SELECT user_id AS key, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL), e AS (SELECT user_id AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'error'),
 l AS (SELECT key, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS recent FROM e WHERE rn <= 5 GROUP BY key)
 SELECT s.key, total, failed, round(failed / total, 6) AS failure_rate, failed / total >= 3e-1 AS above_threshold, recent FROM s LEFT JOIN l ON l.key = s.key""")
def _(spark, sf):
    out = monitor.failure_stats(_calls(spark, sf), ["key"])
    return out.withColumn("recent", F.array_join("recent_errors", ",")).drop("recent_errors").withColumn("failure_rate", F.round("failure_rate", 6))


@query("request_metrics", "SELECT user_id AS key, count(*) AS n, round(sum(value), 4) AS total_duration, count(*) FILTER (event_type <> 'error') AS successful FROM events GROUP BY ALL")
def _(spark, sf):
    return monitor.request_metrics(_calls(spark, sf)).withColumn("total_duration", F.round("total_duration", 4))


ROLL = """c AS (SELECT event_id AS id, ts, {key} AS key, event_type <> 'error' AS ok FROM events),
 r AS (SELECT *, count(*) OVER w AS window_calls, count(*) FILTER (NOT ok) OVER w AS window_failures, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY key ORDER BY ts, id) AS g FROM c
   WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL {sec} SECONDS PRECEDING AND CURRENT ROW)),
 s AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY key, g ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS consecutive_failures FROM r)
 SELECT id, window_calls, window_failures, CASE WHEN ok THEN 0 ELSE consecutive_failures END AS consecutive_failures, (NOT ok AND consecutive_failures >= 5) OR (n >= 10 AND window_failures / window_calls >= 5e-1) AS alarm FROM s"""


@query("rolling_failure_rate", "WITH " + ROLL.format(key="user_id % 3", sec="3599.999999"))
def _(spark, sf):
    log = _calls(spark, sf).withColumn("key", F.col("key") % 3)
    return monitor.rolling_failure_rate(log, 3600, slice_seconds=86400).select("id", "window_calls", "window_failures", "consecutive_failures", "alarm")
