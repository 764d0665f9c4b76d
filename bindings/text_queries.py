"""Scanning, findings, ids and scores over documents and derived code."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import *  # noqa: F403
from bindings.common import (CODE, CODE_FINDINGS, CODE_LINES, CODE_RULES, CODE_SINKS, DOC_RULES, DOCS, FINDINGS, LANG_SQL, LINES,
                             REVIEWS, SEV_RANK, code_files, code_findings, code_rule_values, doc_findings, document_files,
                             review_findings, rule_values, table)
from riskloom.functions import paths, severity, texts
from riskloom.operators import dedup, scan, scoring
from riskloom.operators.scan_sql import register_scan
from riskloom.sources import corpus
from riskloom.sources.rules import Rule

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("read_corpus_table", f"WITH {DOCS} SELECT project, path, CAST(octet_length(encode(content)) AS BIGINT) AS size, md5(content) AS content_md5 FROM docs")
def _(spark, sf):
    return document_files(spark, sf).select("project", "path", "size", F.md5("content").alias("content_md5"))


@query("explode_lines", f"WITH {LINES} SELECT project, path, line_no, md5(line) AS line_md5 FROM lines")
def _(spark, sf):
    return corpus.explode_lines(document_files(spark, sf)).select("project", "path", "line_no", F.md5("line").alias("line_md5"))


OFFSETS = f"""m AS (SELECT project, path, rule_id, string_split_regex(content, pat) AS pieces, regexp_extract_all(content, pat) AS hits
   FROM docs, {rule_values(DOC_RULES)} WHERE regexp_matches(content, pat)),
 e AS (SELECT project, path, rule_id, unnest(hits) AS match, unnest(generate_series(1, len(hits))) AS i, pieces, hits FROM m),
 o AS (SELECT project, path, rule_id, match,
   list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0) AS off FROM e)"""


@query("scan_rules", f"""WITH {DOCS}, {OFFSETS}
SELECT o.project, o.path, rule_id, match, CAST(off AS INTEGER) AS match_offset,
  CAST(1 + len(string_split(substr(content, 1, CAST(off AS BIGINT)), chr(10))) - 1 AS INTEGER) AS line
FROM o JOIN docs ON o.path = docs.path""")
def _(spark, sf):
    return scan.scan_rules(document_files(spark, sf), DOC_RULES).select(
        "project", "path", "rule_id", "match", F.col("offset").alias("match_offset"), "line")


@query("scan_rules_sql", ORACLES["scan_rules"])
def _(spark, sf):
    register_scan(spark, DOC_RULES)
    return spark.sql("SELECT project, path, rule_id, match, `offset` AS match_offset, line FROM scan_rules(TABLE({files}))", files=document_files(spark, sf))


@query("line_of_offset", f"""WITH {DOCS} SELECT path, CAST(len(string_split(substr(content, 1, len(content) // 2), chr(10))) AS INTEGER) AS middle_line FROM docs""")
def _(spark, sf):
    c = F.col("content")
    return document_files(spark, sf).select("path", texts.line_of_offset(c, F.floor(F.length(c) / 2).cast("int")).alias("middle_line"))


@query("rule_text_join", f"""WITH {FINDINGS} SELECT project, file AS path, line, rule_id, vuln_type, match FROM f""")
def _(spark, sf):
    return scan.rule_text_join(document_files(spark, sf), DOC_RULES).drop("language")


@query("scan_findings", f"""WITH {FINDINGS} SELECT project, source, rule_id, file, line, location, vuln_type, cwe, severity, confidence, title, match, evidence FROM f""")
def _(spark, sf):
    return doc_findings(spark, sf).select("project", "source", "rule_id", "file", "line", "location", "vuln_type", "cwe", "severity",
                                          "confidence", "title", "match", "evidence")


@query("detect_language", f"WITH {CODE} SELECT path, CASE WHEN path LIKE '%.gradle' OR path LIKE '%.json' THEN 'unknown' ELSE {LANG_SQL} END AS language FROM code")
def _(spark, sf):
    return code_files(spark, sf).select("path", paths.detect_language(F.col("path")).alias("language"))


PLUMB = ", ".join(f"'{p}'" for p in paths.PLUMBING)


@query("path_parts", f"""WITH {PAGES} SELECT path, regexp_replace(path, '^.*/', '') AS basename, regexp_replace(path, '/[^/]*$', '') AS directory,
  CAST(len(string_split(path, '/')) AS INTEGER) AS depth, split_part(regexp_replace(path, '^.*/', ''), '.', 1) AS stem,
  lower(array_to_string(string_split(path, '/')[-3:], '/')) AS tail,
  CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT contains(x, '.') AND NOT list_contains([{PLUMB}], lower(x)))) > 0
    THEN array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT contains(x, '.') AND NOT list_contains([{PLUMB}], lower(x)))[1:2], '/')
    ELSE split_part(path, '/', 1) END AS subsystem FROM pg""")
def _(spark, sf):
    p = paths.path_parts(F.col("path"))
    return page_files(spark, sf).select("path", p.alias("p")).select(
        "path", *[F.col(f"p.{c}").alias(c) for c in ("basename", "directory", "depth", "stem", "tail", "subsystem")])


@query("split_location", f"""WITH {FINDINGS} SELECT location, regexp_replace(location, ':.*$', '') AS loc_file,
  CAST(regexp_extract(location, ':([0-9]+)', 1) AS INTEGER) AS loc_line FROM f""")
def _(spark, sf):
    return doc_findings(spark, sf).select("location", paths.split_location(F.col("location")).alias("s")).select(
        "location", F.col("s.file").alias("loc_file"), F.col("s.line").alias("loc_line"))


@query("snippet", f"""WITH {FINDINGS} SELECT f.file, f.line, rule_id,
  md5(array_to_string(string_split(content, chr(10))[greatest(f.line - 2, 1):f.line + 2], chr(10))) AS snippet_md5
  FROM f JOIN docs ON f.file = docs.path""")
def _(spark, sf):
    found = scan.scan_lines(document_files(spark, sf), DOC_RULES, around=2)
    return found.select(F.col("path").alias("file"), "line", "rule_id", F.md5(texts.snippet(F.col("line"))).alias("snippet_md5"))


@query("context_lines", f"""WITH {FINDINGS} SELECT f.file, f.line, rule_id, l.line_no AS ctx_line, md5(l.line) AS ctx_md5, l.line_no = f.line AS is_target
  FROM f JOIN lines l ON f.file = l.path AND l.line_no BETWEEN f.line - 3 AND f.line + 3""")
def _(spark, sf):
    found = scan.scan_lines(document_files(spark, sf), DOC_RULES, around=3)
    return found.select(F.col("path").alias("file"), "line", "rule_id",
                        F.explode(texts.context_lines(F.col("line"))).alias("c")).select(
        "file", "line", "rule_id", F.col("c.line").alias("ctx_line"), F.md5("c.content").alias("ctx_md5"), F.col("c.is_target").alias("is_target"))


PROFILE_RULES = [
    Rule("sql_injection", r"executeQuery\s*\(", kind="profile", language="java", vuln_type="SQL_INJECTION", cwe="CWE-89", severity="high", safe_patterns=["PreparedStatement"]),
    Rule("command_injection", r"\.exec\s*\(", kind="profile", language="java", vuln_type="COMMAND_INJECTION", cwe="CWE-78", severity="critical"),
    Rule("php_exec", r"system\s*\(", kind="profile", language="php", vuln_type="COMMAND_INJECTION", cwe="CWE-78", severity="critical", safe_patterns=["escapeshellarg", "intval"]),
    Rule("php_des", r"unserialize\s*\(", kind="profile", language="php", vuln_type="DESERIALIZATION", cwe="CWE-502", severity="high", safe_patterns=["allowed_classes"]),
]


@query("scan_profiles", f"""WITH {CODE},
pr AS (SELECT * FROM (VALUES ('sql_injection', 'java', '(?i)executeQuery\\s*\\(', '(?i)PreparedStatement'), ('command_injection', 'java', '(?i)\\.exec\\s*\\(', NULL),
  ('php_exec', 'php', '(?i)system\\s*\\(', '(?i)escapeshellarg|intval'), ('php_des', 'php', '(?i)unserialize\\s*\\(', '(?i)allowed_classes')) AS t(rule_id, rlang, pat, safe)),
h AS (SELECT project, path, rule_id, safe, content, string_split_regex(content, pat) AS pieces, regexp_extract_all(content, pat) AS hits
  FROM code, pr WHERE rlang = {LANG_SQL} AND regexp_matches(content, pat)),
e AS (SELECT *, unnest(hits) AS match, unnest(generate_series(1, len(hits))) AS i FROM h),
o AS (SELECT project, path, rule_id, safe, content, match, CAST(list_sum(list_transform(pieces[1:i], lambda x: len(x)))
  + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS off FROM e)
SELECT project, path, rule_id, match, CAST(off AS INTEGER) AS match_offset FROM o
WHERE safe IS NULL OR NOT regexp_matches(substr(content, greatest(off - 150, 0) + 1, least(off, 150) + len(match) + 150), safe)""")
def _(spark, sf):
    return scan.scan_profiles(code_files(spark, sf), PROFILE_RULES).select("project", "path", "rule_id", "match", F.col("offset").alias("match_offset"))


def _complexity_sql(text):
    return (f"CASE WHEN {text} = '' THEN 0e0 ELSE least(1e0, len(regexp_extract_all({text}, '[-+*/%=<>!&|]+')) * 1e-1 "
            f"+ len(regexp_extract_all({text}, '[(]')) * 1e-1 + least(len({text}) / 1e2, 5e-1)) END")


CONF_SQL = f"""least(1e0, greatest(0e0, ((((6e-1 + 0e0) + CASE WHEN len(t) > 0 THEN 5e-2 ELSE 0e0 END) + CASE WHEN len(t) > 50 THEN 5e-2 ELSE 0e0 END)
  + CASE WHEN regexp_matches(t, '(?i)test|spec|mock|fixture|example|sample|demo|stub|placeholder|dummy') THEN 0e0 ELSE 1e-1 END)
  - CASE WHEN {_complexity_sql('t')} > 5e-1 THEN 1e-1 ELSE 0e0 END - CASE WHEN cc < 3e-1 THEN 5e-2 ELSE 0e0 END))"""
FILE_CC = """fc AS (SELECT path, CASE WHEN len(ne) = 0 THEN 0e0 ELSE least(1e0, (list_sum(list_transform(ne, lambda x: len(x))) / len(ne) / 8e1
  + len(regexp_extract_all(content, '(?i)\\b(function|class|if|else|for|while|switch|case|return)\\b')) / len(ne)) / 2e0) END AS cc
  FROM (SELECT path, content, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS ne FROM code))"""


@query("match_confidence", f"""WITH {CODE_FINDINGS}, {FILE_CC},
 x AS (SELECT cf.*, trim(text) AS t, cc FROM cf JOIN fc ON cf.file = fc.path)
 SELECT file, line, rule_id, round({CONF_SQL}, 6) AS confidence FROM x""")
def _(spark, sf):
    files = code_files(spark, sf)
    found = scan.scan_lines(files, CODE_SINKS, carry={"complexity": scan.text_complexity(F.col("content"))})
    conf = scan.match_confidence(F.col("text"), F.col("complexity"))
    return found.select(F.col("path").alias("file"), "line", "rule_id", F.round(conf, 6).alias("confidence"))


CTX_RULES = [r for r in CODE_RULES if r.kind in ("source", "sink")]


@query("scan_with_context", f"""WITH {CODE_LINES}, {FILE_CC},
 m AS (SELECT l.path, line_no, l.line, rule_id, kind, len(regexp_extract_all(l.line, pat)) AS n FROM code_lines l, {code_rule_values(CTX_RULES)}
   WHERE rlang = {LANG_SQL} AND regexp_matches(l.line, pat)),
 x AS (SELECT m.*, trim(m.line) AS t, cc FROM m JOIN fc USING (path))
 SELECT path, line_no AS line, rule_id, kind, round({CONF_SQL}, 6) AS confidence, least(len(string_split(content, chr(10))), line_no + 3) - greatest(1, line_no - 3) + 1 AS context_size
 FROM x JOIN code USING (path), generate_series(1, n)""")
def _(spark, sf):
    return scan.scan_with_context(code_files(spark, sf), CTX_RULES).select(
        "path", "line", "rule_id", "kind", F.round("confidence", 6).alias("confidence"), F.size("context").cast("long").alias("context_size"))


@query("search_text", f"WITH {LINES} SELECT project, path, line_no, trim(line) AS content FROM lines WHERE contains(lower(line), 'license')")
def _(spark, sf):
    return scan.search_text(corpus.explode_lines(document_files(spark, sf)), "LICENSE")


@query("search_patterns", f"""WITH {LINES} SELECT project, path, line_no, CASE WHEN regexp_matches(line, '(?i)token\\s*=') THEN 'token\\s*=' ELSE '[0-9]{{16}}' END AS pattern,
  trim(line) AS content FROM lines WHERE (regexp_matches(line, '(?i)token\\s*=') OR regexp_matches(line, '[0-9]{{16}}')) AND lang <> 'de'""")
def _(spark, sf):
    return scan.search_patterns(corpus.explode_lines(document_files(spark, sf)), [r"token\s*=", r"[0-9]{16}"], include=["**.txt"], exclude=["*/de/*"])


@query("project_structure", f"""WITH {DOCS} SELECT project, path, substr(content, 1, 500) AS preview, CAST(len(string_split(content, chr(10))) AS INTEGER) AS line_count,
  CAST(len(content) AS INTEGER) AS chars FROM docs""")
def _(spark, sf):
    return scan.project_structure(document_files(spark, sf))


# ---------------------------------------------------------------- de-duplication and ids
BEST = "row_number() OVER (PARTITION BY project, {k} ORDER BY {o}) AS rn"


@query("dedup_findings", f"""WITH RECURSIVE {CODE_FINDINGS},
 k AS (SELECT cf.*, concat(vuln_type, '::', lower(regexp_replace(file, '^.*/', '')), '::', (line // 5) * 5) AS key, len(string_split(file, '/')) AS depth,
   row_number() OVER (PARTITION BY project, vuln_type, lower(regexp_replace(file, '^.*/', '')), line // 5 ORDER BY line, confidence DESC, file, rule_id) AS rn FROM cf),
 w AS (SELECT project, key, rn, depth, confidence, rule_id, file, line FROM k WHERE rn = 1
   UNION ALL
   SELECT k.project, k.key, k.rn, CASE WHEN k.depth > w.depth OR k.confidence > w.confidence THEN k.depth ELSE w.depth END,
     CASE WHEN k.depth > w.depth OR k.confidence > w.confidence THEN k.confidence ELSE w.confidence END,
     CASE WHEN k.depth > w.depth OR k.confidence > w.confidence THEN k.rule_id ELSE w.rule_id END,
     CASE WHEN k.depth > w.depth OR k.confidence > w.confidence THEN k.file ELSE w.file END,
     CASE WHEN k.depth > w.depth OR k.confidence > w.confidence THEN k.line ELSE w.line END
   FROM w JOIN k ON k.project = w.project AND k.key = w.key AND k.rn = w.rn + 1),
 z AS (SELECT *, row_number() OVER (PARTITION BY project, key ORDER BY rn DESC) AS last FROM w)
 SELECT project, rule_id, file, line FROM z WHERE last = 1""")
def _(spark, sf):
    return dedup.dedup_findings(code_findings(spark, sf)).select("project", "rule_id", "file", "line")


@query("dedup_best_confidence", f"""WITH {FINDINGS}, {REVIEWS}, u AS (SELECT * FROM f UNION ALL BY NAME SELECT * FROM rv),
 k AS (SELECT *, {BEST.format(k="lower(regexp_replace(file, '^.*/', '')), vuln_type, line // 5", o='confidence DESC, line, file, rule_id')} FROM u)
 SELECT project, source, rule_id, file, line, confidence FROM k WHERE rn = 1""")
def _(spark, sf):
    both = doc_findings(spark, sf).unionByName(review_findings(spark, sf))
    return dedup.dedup_best_confidence(both).select("project", "source", "rule_id", "file", "line", "confidence")


@query("dedup_best_severity", f"""WITH {FINDINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY project, vuln_type, line, evidence ORDER BY {SEV_RANK} DESC, file, rule_id) AS rn FROM f)
 SELECT project, rule_id, file, line, vuln_type FROM k WHERE rn = 1""")
def _(spark, sf):
    return dedup.dedup_best_severity(doc_findings(spark, sf)).select("project", "rule_id", "file", "line", "vuln_type")


@query("exact_distinct", f"""WITH {FINDINGS}, {REVIEWS}, u AS (SELECT * FROM f UNION ALL BY NAME SELECT * FROM rv),
 k AS (SELECT *, row_number() OVER (PARTITION BY project, file, line, vuln_type ORDER BY CASE WHEN source = 'llm' THEN 0 ELSE 1 END, {SEV_RANK} DESC, confidence DESC, source, rule_id) AS rn FROM u)
 SELECT project, source, rule_id, file, line FROM k WHERE rn = 1""")
def _(spark, sf):
    both = doc_findings(spark, sf).unionByName(review_findings(spark, sf))
    return dedup.exact_distinct(both).select("project", "source", "rule_id", "file", "line")


CODE_OF = ("CASE vuln_type WHEN 'HARD_CODE_SECRET' THEN 'SEC' WHEN 'CREDENTIAL_EXPOSURE' THEN 'CRED' WHEN 'PERSONAL_INFO_EXPOSURE' THEN 'PII' "
           "WHEN 'INFO_LEAK' THEN 'INFO' ELSE 'VULN' END")
PREFIX = "CASE severity WHEN 'critical' THEN 'C' WHEN 'high' THEN 'H' WHEN 'medium' THEN 'M' ELSE 'L' END"
IDS = f"""ids AS (SELECT f.*, row_number() OVER (PARTITION BY project, {PREFIX}, {CODE_OF}
   ORDER BY regexp_replace(file, '/[^/]*$', ''), regexp_replace(file, '^.*/', ''), line, rule_id, match) AS nr FROM f)"""


@query("assign_ids", f"""WITH {FINDINGS}, {IDS} SELECT file, line, rule_id, concat({PREFIX}, '-', {CODE_OF}, '-', lpad(CAST(nr AS VARCHAR), CAST(greatest(3, len(CAST(nr AS VARCHAR))) AS INTEGER), '0')) AS vuln_id FROM ids""")
def _(spark, sf):
    return dedup.assign_ids(doc_findings(spark, sf)).select("file", "line", "rule_id", "vuln_id")


@query("sort_by_severity", f"WITH {FINDINGS} SELECT file, line, rule_id, severity FROM f ORDER BY {SEV_RANK} DESC, confidence DESC, file, line")
def _(spark, sf):
    return dedup.sort_by_severity(doc_findings(spark, sf)).select("file", "line", "rule_id", "severity")


@query("severity_floor_cap", f"""WITH {FINDINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY project, file ORDER BY {SEV_RANK} DESC, confidence DESC, line, rule_id) AS rn
  FROM f WHERE {SEV_RANK} >= 1) SELECT file, line, rule_id, severity FROM k WHERE rn <= 2""")
def _(spark, sf):
    return dedup.severity_floor_cap(doc_findings(spark, sf), "low", 2).select("file", "line", "rule_id", "severity")


@query("new_only", f"""WITH {FINDINGS}, {REVIEWS} SELECT rule_id, file, line FROM f WHERE NOT EXISTS
  (SELECT 1 FROM rv WHERE f.location = rv.location AND left(f.title, 40) = left(rv.title, 40))""")
def _(spark, sf):
    return dedup.new_only(doc_findings(spark, sf), review_findings(spark, sf)).select("rule_id", "file", "line")


@query("existing_keys", f"""WITH {FINDINGS}, {REVIEWS} SELECT rule_id, file, line FROM f WHERE NOT EXISTS
  (SELECT 1 FROM rv WHERE f.file = rv.file AND f.vuln_type = rv.vuln_type)""")
def _(spark, sf):
    return dedup.existing_keys(doc_findings(spark, sf), review_findings(spark, sf), ["file", "vuln_type"]).select("rule_id", "file", "line")


@query("update_status", f"""WITH {FINDINGS} SELECT file, line, rule_id, CASE WHEN EXISTS (SELECT 1 FROM f g WHERE g.file = f.file AND g.line = f.line AND g.vuln_type = f.vuln_type
   AND g.severity = 'critical') THEN 'valid' ELSE 'open' END AS status FROM f""")
def _(spark, sf):
    f = doc_findings(spark, sf)
    valid = f.where("severity = 'critical'").withColumn("status", F.lit("valid"))
    return dedup.update_status(f, valid).select("file", "line", "rule_id", "status")


# ---------------------------------------------------------------- scores
RIC = {"HARD_CODE_SECRET": (3, 3, 3), "CREDENTIAL_EXPOSURE": (3, 2, 2), "PERSONAL_INFO_EXPOSURE": (2, 2, 2), "INFO_LEAK": (2, 1, 1)}


def _ric(i):
    return "CASE vuln_type " + " ".join(f"WHEN '{t}' THEN {v[i]}" for t, v in RIC.items()) + " ELSE 2 END"


MULT = "CASE severity WHEN 'critical' THEN 1e0 WHEN 'high' THEN 9e-1 WHEN 'medium' THEN 7e-1 WHEN 'low' THEN 5e-1 ELSE 7e-1 END"


@query("cvss_3d", f"""WITH {FINDINGS}, r AS (SELECT *, {_ric(0)} AS r, {_ric(1)} AS i, {_ric(2)} AS c, {MULT} AS mult FROM f),
 s AS (SELECT *, r * 4e-1 + i * 35e-2 + c * 25e-2 AS score FROM r)
 SELECT file, line, rule_id, floor(score * 1e2 + 5e-1) / 1e2 AS score_raw, floor(score / 3e0 * 1e1 * mult * 1e1 + 5e-1) / 1e1 AS cvss,
  concat(CAST(floor(r * mult + 5e-1) AS BIGINT), '/', CAST(floor(i * mult + 5e-1) AS BIGINT), '/', CAST(floor(c * mult + 5e-1) AS BIGINT)) AS cvss_breakdown FROM s""")
def _(spark, sf):
    return scoring.cvss_3d(doc_findings(spark, sf)).select("file", "line", "rule_id", "score_raw", "cvss", "cvss_breakdown")


CBASE = ("CASE vuln_type WHEN 'SQL_INJECTION' THEN 98e-1 WHEN 'COMMAND_INJECTION' THEN 98e-1 WHEN 'CODE_INJECTION' THEN 98e-1 WHEN 'PATH_TRAVERSAL' THEN 75e-1 "
         "WHEN 'XSS' THEN 61e-1 WHEN 'HARD_CODE_PASSWORD' THEN 75e-1 WHEN 'DESERIALIZATION' THEN 88e-1 ELSE 5e0 END")


@query("cvss_base", f"""WITH {CODE_FINDINGS} SELECT file, line, rule_id, floor({CBASE} * {MULT} * 1e1 + 5e-1) / 1e1 AS cvss_base FROM cf""")
def _(spark, sf):
    return scoring.cvss_base(code_findings(spark, sf)).select("file", "line", "rule_id", "cvss_base")


@query("rank_findings", f"""WITH {CODE_FINDINGS} SELECT file, line, rule_id, floor({CBASE} * {MULT} * 1e1 + 5e-1) / 1e1 AS cvss_base FROM cf
""")
def _(spark, sf):
    return dedup.rank_findings(scoring.cvss_base(code_findings(spark, sf)), "cvss_base").select("file", "line", "rule_id", "cvss_base")


@query("component_cvss", f"""WITH {FINDINGS} SELECT file, line, rule_id, CASE severity WHEN 'critical' THEN 98e-1 WHEN 'high' THEN 8e0 WHEN 'medium' THEN 59e-1 WHEN 'low' THEN 31e-1 ELSE 5e0 END AS cvss,
  CASE severity WHEN 'critical' THEN '3/3/1' WHEN 'high' THEN '3/2/1' WHEN 'medium' THEN '2/2/1' WHEN 'low' THEN '1/1/1' ELSE '2/2/1' END AS breakdown FROM f""")
def _(spark, sf):
    return doc_findings(spark, sf).withColumn("c", scoring.component_cvss(F.col("severity"))).select(
        "file", "line", "rule_id", F.col("c.cvss").alias("cvss"), F.col("c.breakdown").alias("breakdown"))


VULN_IN = """v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'SQL_INJECTION' WHEN l_returnflag = 'N' THEN 'XXE' ELSE 'SSRF' END AS vuln_type,
  CAST(l_linenumber % 4 AS INTEGER) AS r, CAST(l_partkey % 4 AS INTEGER) AS i, CAST(l_suppkey % 4 AS INTEGER) AS c FROM lineitem)"""


@query("score_vulnerability", f"""WITH {VULN_IN}, s AS (SELECT *, floor((r * 4e-1 + i * 35e-2 + c * 25e-2) * 1e2 + 5e-1) / 1e2 AS sc FROM v),
 t AS (SELECT *, concat(vuln_type, ':', r, ':', i, ':', c) AS k FROM s),
 o AS (SELECT t.*, ty.score AS ts, ty.cvss AS tc, ty.level AS tl FROM t LEFT JOIN (VALUES {", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, '{v[2]}')" for k, v in scoring.TYPICAL.items())}) AS ty(key, score, cvss, level) ON ty.key = t.k)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(ts, sc) AS score, coalesce(tc, floor(sc / 3e0 * 1e1 * 1e1 + 5e-1) / 1e1) AS cvss,
  coalesce(tl, CASE WHEN sc BETWEEN 27e-1 AND 3e0 THEN 'C' WHEN sc BETWEEN 21e-1 AND 269e-2 THEN 'H' WHEN sc BETWEEN 12e-1 AND 209e-2 THEN 'M' ELSE 'L' END) AS level FROM o""")
def _(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CASE WHEN l_returnflag = 'A' THEN 'SQL_INJECTION' WHEN l_returnflag = 'N' THEN 'XXE' ELSE 'SSRF' END AS vuln_type",
        "CAST(l_linenumber % 4 AS INT) AS reachability", "CAST(l_partkey % 4 AS INT) AS impact_level", "CAST(l_suppkey % 4 AS INT) AS complexity")
    return scoring.score_vulnerability(v).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "score", "cvss", "level")


@query("dktss", f"""WITH {VULN_IN}, d AS (SELECT *, CASE r WHEN 0 THEN 0 WHEN 1 THEN -2 ELSE -4 END + CASE i WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE -3 END + CASE c WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -2 END AS adj,
   CASE vuln_type WHEN 'SQL_INJECTION' THEN 7 WHEN 'SSRF' THEN 7 ELSE 6 END AS base FROM v), e AS (SELECT *, CAST(greatest(0, least(10, base + adj)) AS DOUBLE) AS dktss FROM d)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dktss, CASE WHEN dktss >= 7 THEN 'critical' WHEN dktss >= 5 THEN 'high' WHEN dktss >= 3 THEN 'medium' ELSE 'low' END AS dktss_level FROM e""")
def _(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CASE WHEN l_returnflag = 'A' THEN 'SQL_INJECTION' WHEN l_returnflag = 'N' THEN 'XXE' ELSE 'SSRF' END AS vuln_type",
        "CASE l_linenumber % 4 WHEN 0 THEN 'internet' WHEN 1 THEN 'intranet' ELSE 'physical' END AS access_path",
        "CASE l_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'lowPrivilege' ELSE 'highPrivilege' END AS auth_required",
        "CASE l_suppkey % 4 WHEN 0 THEN 'matureExp' WHEN 1 THEN 'pocOnly' ELSE 'theoretical' END AS weapon_level")
    return scoring.dktss(v).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "dktss", "dktss_level")


COUNTS = """count(*) FILTER (severity = 'critical') AS blocker, count(*) FILTER (severity = 'high') AS major, count(*) FILTER (severity = 'medium') AS minor,
  count(*) FILTER (severity NOT IN ('critical', 'high', 'medium')) AS info"""
GATE = """x AS (SELECT *, CAST(greatest(0, 100 - blocker * 25 - major * 5 - minor - least(3, greatest(0, info - 5))) AS BIGINT) AS score FROM c)"""
GATE_COLS = """score, array_to_string(list_filter([CASE WHEN blocker > 0 THEN concat('blocker:', blocker, '>0') END, CASE WHEN major > 3 THEN concat('major:', major, '>3') END,
   CASE WHEN score < 70 THEN concat('score:', score, '<70') END], lambda z: z IS NOT NULL), ',') AS reasons,
  NOT (blocker > 0 OR major > 3 OR score < 70) AS gate_passed, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS rating"""


@query("score_project", f"""WITH {FINDINGS}, a AS (SELECT project, severity FROM f), c AS (SELECT d.project, count(severity) FILTER (severity = 'critical') AS blocker,
   count(severity) FILTER (severity = 'high') AS major, count(severity) FILTER (severity = 'medium') AS minor, count(severity) FILTER (severity NOT IN ('critical','high','medium')) AS info, count(severity) AS findings_count
   FROM (SELECT DISTINCT project FROM docs) d LEFT JOIN a ON a.project = d.project GROUP BY d.project), {GATE}
 SELECT project, blocker, major, minor, info, findings_count, {GATE_COLS} FROM x""")
def _(spark, sf):
    projects = document_files(spark, sf).select("project").distinct()
    return scoring.score_project(doc_findings(spark, sf), projects=projects).withColumn(
        "reasons", F.array_join("gate_reasons", ",")).drop("gate_reasons")


@query("score_by_source", f"""WITH {FINDINGS}, {REVIEWS}, u AS (SELECT project, severity, CASE source WHEN 'quick_scan' THEN 'scan' ELSE 'model' END AS source_group FROM (SELECT * FROM f UNION ALL BY NAME SELECT * FROM rv)),
 c AS (SELECT project, CASE WHEN grouping(source_group) = 1 THEN 'overall' ELSE source_group END AS source_group, {COUNTS}, count(*) AS findings_count FROM u
   GROUP BY GROUPING SETS ((project), (project, source_group))), {GATE} SELECT project, source_group, blocker, major, minor, info, findings_count, {GATE_COLS} FROM x""")
def _(spark, sf):
    both = doc_findings(spark, sf).unionByName(review_findings(spark, sf))
    return scoring.score_by_source(both).withColumn("reasons", F.array_join("gate_reasons", ",")).drop("gate_reasons")


@query("severity_table", f"WITH {FINDINGS}, {IDS} SELECT {PREFIX} AS level, count(*) AS n FROM ids GROUP BY 1")
def _(spark, sf):
    return scoring.severity_table(dedup.assign_ids(doc_findings(spark, sf)))


@query("severity_map", f"""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS mapped,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'low' END AS lowered,
  CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS sev_rank,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'blocker' WHEN '2-HIGH' THEN 'major' WHEN '3-MEDIUM' THEN 'minor' ELSE 'info' END AS level FROM orders""")
def _(spark, sf):
    raw = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN '严重' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN '中危' ELSE 'LOW' END")
    m = severity.severity_map(F.col("raw"))
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).select(
        "o_orderkey", m.alias("mapped"), severity.downgrade(m).alias("lowered"), severity.severity_rank(m).alias("sev_rank"),
        severity.severity_level(F.col("raw")).alias("level"))


@query("clamp_values", """SELECT event_id, CASE WHEN event_type = 'view' THEN 65e-2 ELSE greatest(0e0, least(1e0, value / 2e1)) END AS confidence,
  CASE WHEN event_type = 'view' THEN 5e0 ELSE floor(greatest(0e0, least(1e1, value)) * 1e1 + 5e-1) / 1e1 END AS cvss,
  CASE WHEN event_type = 'view' THEN 'n/a' ELSE event_type END AS label FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "view", F.lit("unknown"))
    return e.select("event_id", severity.clamp_confidence(F.coalesce(raw, (F.col("value") / 20.0).cast("string"))).alias("confidence"),
                    severity.clamp_cvss(F.coalesce(raw, F.col("value").cast("string"))).alias("cvss"),
                    severity.safe_string(F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("event_type")), "n/a").alias("label"))


@query("mask_secrets", f"""WITH {FINDINGS} SELECT file, line, rule_id, CASE WHEN len(match) <= 8 THEN repeat('*', len(match)) ELSE concat(left(match, 4), '***', right(match, 4)) END AS masked FROM f""")
def _(spark, sf):
    return doc_findings(spark, sf).select("file", "line", "rule_id", texts.mask_secret(F.col("match")).alias("masked"))
