"""Manifests, components, tool reports, exports, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import (CODE, CODE_FINDINGS, DOCS, FINDINGS, SEV_RANK, code_files, code_findings, doc_findings, document_files, table)
from riskloom.operators import components
from riskloom.sources import exports, history, manifests, reports

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


POM = """pom0 AS (SELECT project, path, p_size, unnest(regexp_extract_all(replace(content, chr(10), ' '), '<dependency>(.*?)</dependency>', 1)) AS d FROM (SELECT code.*, part.p_size FROM code JOIN part USING (p_partkey)) WHERE path LIKE '%pom.xml'),
 pom AS (SELECT project, path, 'maven' AS ecosystem, regexp_extract(d, '<groupId>([^<]+)<', 1) AS group_id, regexp_extract(d, '<artifactId>([^<]+)<', 1) AS artifact,
   replace(regexp_extract(d, '<version>([^<]+)<', 1), concat('$', '{log4j.version}'), concat('2.', p_size, '.0')) AS version, 'compile' AS scope, FALSE AS dev FROM pom0 WHERE regexp_extract(d, '<scope>([^<]+)<', 1) NOT IN ('test', 'provided'))"""
GRADLE = """gr AS (SELECT project, path, string_split(replace(unnest(regexp_extract_all(content, '(?:implementation|api|compile|runtimeOnly|annotationProcessor)\\s*\\(?\\s*["'']([^"'']+)["'']', 1)), '$springVersion', concat('5.2.', p_size)), ':') AS c
   FROM (SELECT code.*, part.p_size FROM code JOIN part USING (p_partkey)) WHERE path LIKE '%build.gradle'),
 gradle AS (SELECT project, path, 'gradle' AS ecosystem, c[1] AS group_id, c[2] AS artifact, c[3] AS version, 'compile' AS scope, FALSE AS dev FROM gr WHERE len(c) >= 3)"""
NPM = """npm AS (SELECT project, path, 'npm' AS ecosystem, '' AS group_id, v.artifact, v.version, 'compile' AS scope, v.dev FROM (SELECT code.*, p_size FROM code JOIN part USING (p_partkey)) c,
   LATERAL (SELECT 'express' AS artifact, concat('^4.', c.p_size, '.0') AS version, FALSE AS dev UNION ALL SELECT 'lodash', concat('4.17.', c.p_size), FALSE UNION ALL SELECT 'mocha', '10.0.0', TRUE) v WHERE path LIKE '%package.json')"""
DEPS = f"{CODE}, {POM}, {GRADLE}, {NPM}, deps AS (SELECT * FROM pom UNION ALL BY NAME SELECT * FROM gradle UNION ALL BY NAME SELECT * FROM npm), dp AS (SELECT *, concat_ws(':', nullif(group_id, ''), artifact, version) AS coordinate FROM deps)"


@query("parse_pom", f"WITH {CODE}, {POM} SELECT * FROM pom")
def _(spark, sf):
    return manifests.parse_pom(code_files(spark, sf))


@query("parse_gradle", f"WITH {CODE}, {GRADLE} SELECT * FROM gradle")
def _(spark, sf):
    return manifests.parse_gradle(code_files(spark, sf))


@query("parse_manifests", f"WITH {CODE}, {NPM} SELECT * FROM npm")
def _(spark, sf):
    return manifests.parse_manifests(code_files(spark, sf))


@query("parse_dependencies", f"WITH {DEPS} SELECT * FROM dp")
def _(spark, sf):
    return manifests.parse_dependencies(code_files(spark, sf))


CRULES = ", ".join("('%s', '%s', '%s', '%s', '%s', '%s')" % (r.name, r.cve, r.component, r.pattern.replace("'", "''"), r.severity, r.fix) for r in components.COMPONENT_RULES)
CHITS = f"""ch AS (SELECT project, path AS file, concat_ws(':', nullif(group_id, ''), artifact) AS component, version, r.* FROM dp, (VALUES {CRULES}) AS r(rule_name, cve, comp, pat, severity, fix_version)
  WHERE contains(lower(coordinate), comp) AND regexp_matches(coordinate, pat)), cu AS (SELECT *, row_number() OVER (PARTITION BY project, component, cve ORDER BY file, version, rule_name) AS rn FROM ch)"""


@query("match_components", f"WITH {DEPS}, {CHITS} SELECT project, file, component, version, cve, severity, fix_version, concat(rule_name, ' - ', component) AS title FROM cu WHERE rn = 1")
def _(spark, sf):
    return components.match_components(manifests.parse_dependencies(code_files(spark, sf))).select(
        "project", "file", "component", "version", "cve", "severity", "fix_version", "title")


@query("component_stats", f"""WITH {DEPS}, {CHITS}, d AS (SELECT project, count(DISTINCT path) AS files_scanned, count(*) AS dependencies FROM dp GROUP BY project),
 f AS (SELECT project, count(*) AS vulnerabilities, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM cu WHERE rn = 1 GROUP BY project)
 SELECT d.*, coalesce(vulnerabilities, 0) AS vulnerabilities, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low FROM d LEFT JOIN f USING (project)""")
def _(spark, sf):
    deps = manifests.parse_dependencies(code_files(spark, sf))
    return components.component_stats(deps, components.match_components(deps))


@query("import_tool_findings", """WITH p AS (SELECT * FROM part), g AS (SELECT concat('secret-', p_brand) AS rule_id, 'high' AS severity, 0.9::DOUBLE AS confidence, concat('src/', p_partkey, '.py') AS file, p_size AS line, 'HARD_CODED_SECRET' AS vuln_type, 'CWE-798' AS cwe, 8.5::DOUBLE AS cvss, 'unknown' AS language FROM p WHERE p_partkey % 3 = 0),
 b AS (SELECT concat('B6', lpad(CAST(p_size % 12 AS VARCHAR), 2, '0')) AS rule_id, CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'medium' END AS severity, 0.85::DOUBLE AS confidence, concat('lib/', p_partkey, '.py') AS file, p_size AS line,
   CASE p_size % 12 WHEN 1 THEN 'PARAMETERIZED_COMMAND' WHEN 2 THEN 'SUBPROCESS_SHELL_TRUE' WHEN 3 THEN 'SUBPROCESS_WITHOUT_SHELL' WHEN 4 THEN 'ANY_INSECURE_FUNCTION' WHEN 5 THEN 'OS_STARTFILE_WITH_SHELL' WHEN 6 THEN 'START_PROCESS_WITH_SHELL' WHEN 7 THEN 'START_PROCESS_WITH_PARTIAL_PATH' WHEN 8 THEN 'HARDCODED_SQL' WHEN 9 THEN 'LINUX_COMMAND_WILDCARD_INJECTION' WHEN 10 THEN 'DJANGO_EXTRA' WHEN 11 THEN 'DJANGO_RAW_SQL' ELSE 'UNKNOWN' END AS vuln_type,
   CASE WHEN p_size % 5 = 0 THEN 'CWE-unknown' ELSE 'CWE-78' END AS cwe, CASE p_size % 4 WHEN 0 THEN 85e-1 WHEN 1 THEN 55e-1 WHEN 2 THEN 3e0 ELSE 55e-1 END AS cvss, 'python' AS language FROM p WHERE p_partkey % 3 = 1),
 s AS (SELECT concat('rules.', CASE p_size % 5 WHEN 0 THEN 'sql-concat' WHEN 1 THEN 'dom-xss' WHEN 2 THEN 'os-exec' WHEN 3 THEN 'weak-crypto' ELSE 'other' END) AS rule_id, CASE p_size % 2 WHEN 0 THEN 'high' ELSE 'low' END AS severity, 0.85::DOUBLE AS confidence, concat('app/', p_partkey, '.go') AS file, p_size AS line,
   CASE p_size % 5 WHEN 0 THEN 'SQL_INJECTION' WHEN 1 THEN 'XSS' WHEN 2 THEN 'COMMAND_INJECTION' WHEN 3 THEN 'WEAK_CRYPTO' ELSE 'UNKNOWN' END AS vuln_type, CASE p_size % 5 WHEN 0 THEN 'CWE-89' ELSE 'CWE-unknown' END AS cwe, CASE p_size % 2 WHEN 0 THEN 85e-1 ELSE 3e0 END AS cvss, 'go' AS language FROM p WHERE p_partkey % 3 = 2)
 SELECT * FROM g UNION ALL BY NAME SELECT * FROM b UNION ALL BY NAME SELECT * FROM s""")
def _(spark, sf):
    p = table(spark, sf, "part")
    # reports as JSON text, parsed with the schemas of the reader
    g = p.where("p_partkey % 3 = 0").selectExpr("to_json(named_struct('RuleID', concat('secret-', p_brand), 'File', concat('./src/', p_partkey, '.py'), 'StartLine', p_size, 'Secret', p_name)) AS j")
    b = p.where("p_partkey % 3 = 1").selectExpr("""to_json(named_struct('results', array(named_struct('test_id', concat('B6', lpad(CAST(p_size % 12 AS STRING), 2, '0')), 'issue_text', p_name,
        'issue_severity', CASE p_size % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'NONE' END, 'issue_cwe', named_struct('id', CASE WHEN p_size % 5 = 0 THEN '' ELSE '78' END),
        'filename', concat('lib/', p_partkey, '.py'), 'line_number', p_size)))) AS j""")
    s = p.where("p_partkey % 3 = 2").selectExpr("""to_json(named_struct('results', array(named_struct('check_id', concat('rules.', CASE p_size % 5 WHEN 0 THEN 'sql-concat' WHEN 1 THEN 'dom-xss' WHEN 2 THEN 'os-exec' WHEN 3 THEN 'weak-crypto' ELSE 'other' END),
        'path', concat('app/', p_partkey, '.go'), 'start', named_struct('line', p_size), 'message', CASE p_size % 5 WHEN 0 THEN 'Concatenated query (CWE-89)' ELSE 'Check this' END, 'severity', CASE p_size % 2 WHEN 0 THEN 'ERROR' ELSE 'INFO' END)))) AS j""")
    items = {"gitleaks": g.select(F.from_json("j", reports.SCHEMAS["gitleaks"]).alias("r")).select("r.*")}
    for name, df in (("bandit", b), ("semgrep", s)):
        items[name] = df.select(F.explode(F.from_json("j", reports.SCHEMAS[name])["results"]).alias("r")).select("r.*")
    out = None
    for name, df in items.items():
        part = reports.import_tool_findings(df, name)
        out = part if out is None else out.unionByName(part)
    return out.select("rule_id", "severity", "confidence", "file", "line", "vuln_type", "cwe", "cvss", "language")


# ---------------------------------------------------------------- exports
ORD = "row_number() OVER (PARTITION BY project ORDER BY regexp_replace(file, '/[^/]*$', ''), regexp_replace(file, '^.*/', ''), line, rule_id, vuln_type, match)"


@query("export_findings", f"""WITH {FINDINGS}, v AS (SELECT *, CASE WHEN severity = 'info' THEN 'false_positive' WHEN severity = 'low' THEN NULL ELSE 'confirmed' END AS verdict FROM f)
 SELECT project, file, line, rule_id FROM v WHERE verdict IS DISTINCT FROM 'false_positive'""")
def _(spark, sf):
    f = doc_findings(spark, sf).withColumn("verdict", F.when(F.col("severity") == "info", "false_positive").when(F.col("severity") != "low", "confirmed"))
    return exports.exportable(f).select("project", "file", "line", "rule_id")


@query("export_markdown", f"""WITH {FINDINGS}, o AS (SELECT *, {ORD} AS ord FROM f) SELECT project, CAST(1 AS INTEGER) AS section, ord,
  concat('| ', upper(severity), ' | ', vuln_type, ' | ', file, ' | ', line, ' | ', left(replace(title, '|', concat(chr(92), '|')), 60), ' |') AS line FROM o""")
def _(spark, sf):
    return exports.export_markdown(doc_findings(spark, sf)).where("section = 1")


LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"


@query("sarif_results", f"""WITH {FINDINGS}, o AS (SELECT *, {ORD} AS ord FROM f), s AS (SELECT project, vuln_type, min(ord) AS first FROM o GROUP BY ALL),
 i AS (SELECT project, vuln_type, row_number() OVER (PARTITION BY project ORDER BY first) - 1 AS rule_index FROM s)
 SELECT o.project, o.ord, o.vuln_type AS rule, CAST(i.rule_index AS INTEGER) AS rule_index, {LEVEL} AS level, file AS uri, CAST(line AS VARCHAR) AS start_line FROM o JOIN i ON i.project = o.project AND i.vuln_type = o.vuln_type""")
def _(spark, sf):
    r = exports.sarif_results(doc_findings(spark, sf))
    place = "$.locations[0].physicalLocation"
    return r.select("project", "ord", "rule", "rule_index", "level", F.get_json_object("result", f"{place}.artifactLocation.uri").alias("uri"),
                    F.get_json_object("result", f"{place}.region.startLine").alias("start_line"))


@query("export_sarif", f"""WITH {FINDINGS}, o AS (SELECT *, {ORD} AS ord FROM f) SELECT project, (ord - 1) // 4 AS page, count(*) AS results FROM o GROUP BY ALL""")
def _(spark, sf):
    docs = exports.export_sarif(doc_findings(spark, sf), page_size=4)
    n = F.size(F.from_json(F.get_json_object("sarif", "$.runs[0].results"), "array<struct<ruleId:string>>"))
    return docs.select("project", "page", n.cast("long").alias("results"))


@query("sarif_summary", f"""WITH {FINDINGS}, x AS (SELECT project, {LEVEL} AS level, vuln_type FROM f)
 SELECT project, 'level' AS kind, level AS value, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT project, 'rule', vuln_type, count(*) FROM x GROUP BY ALL""")
def _(spark, sf):
    return exports.sarif_summary(doc_findings(spark, sf))


# ---------------------------------------------------------------- history
@query("append_run_history", """WITH r AS (SELECT user_id AS agent, event_id AS run_id, ts AS created_at FROM events),
 k AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, run_id) AS rn FROM r) SELECT agent, run_id FROM k WHERE rn <= 8""")
def _(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id AS agent", "event_id AS run_id", "ts AS created_at", "array(event_type) AS learned")
    return history.append_run_history(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["agent"]).select("agent", "run_id")


@query("learned_patterns", """WITH r AS (SELECT user_id AS agent, ts, concat(event_type, '-', CAST(floor(value) AS BIGINT) % 10) AS pattern FROM events),
 m AS (SELECT agent, pattern, max(ts) AS ts FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts DESC, pattern) AS rn FROM m) SELECT agent, pattern FROM k WHERE rn <= 12""")
def _(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id AS agent", "ts AS created_at", "array(concat(event_type, '-', CAST(floor(value) AS BIGINT) % 10)) AS learned")
    return history.learned_patterns(e, ["agent"])


@query("latest_checkpoint", """SELECT user_id AS agent, max_by(event_id, ts) AS checkpoint FROM events GROUP BY user_id""")
def _(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id AS agent", "ts AS modified", "event_id AS name")
    return history.latest_checkpoint(e).select("agent", F.col("name").alias("checkpoint"))


@query("expire_checkpoints", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAYS")
def _(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "ts AS modified")
    return history.expire_checkpoints(e, F.lit("2024-01-20 00:00:00")).select("event_id")


@query("remaining_projects", "SELECT DISTINCT source AS project FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars > 20000)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return history.remaining_projects(d.select(F.col("source").alias("project")).distinct(), d.where("n_chars > 20000").select(F.col("source").alias("project")))


SNAP = "last AS (SELECT project, path, left(sha256(CASE WHEN doc_id % 3 = 0 THEN concat(content, 'x') ELSE content END), 16) AS hash FROM docs WHERE doc_id % 5 <> 0)"


def _last(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 5 <> 0")
    old = d.selectExpr("source AS project", "concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path", "CASE WHEN doc_id % 3 = 0 THEN concat(text, 'x') ELSE text END AS content")
    return history.snapshot(old)


@query("changed_files", f"WITH {DOCS}, {SNAP} SELECT project, path, left(sha256(content), 16) AS hash FROM docs WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.path = docs.path AND last.hash = left(sha256(docs.content), 16))")
def _(spark, sf):
    return history.changed_files(document_files(spark, sf), _last(spark, sf)).select("project", "path", "hash")


@query("merge_cached", f"""WITH {FINDINGS}, {SNAP}, same AS (SELECT docs.path FROM docs JOIN last ON last.path = docs.path AND last.hash = left(sha256(docs.content), 16))
 SELECT file, line, rule_id, file IN (SELECT path FROM same) AS cached FROM f""")
def _(spark, sf):
    files, last = document_files(spark, sf), _last(spark, sf)
    f = doc_findings(spark, sf)
    fresh = history.changed_files(files, last).select("project", F.col("path").alias("file"))
    new = f.join(fresh, ["project", "file"], "left_semi").withColumn("cached", F.lit(False))
    return history.merge_cached(files, last, f.withColumn("cached", F.lit(True)), new).select("file", "line", "rule_id", "cached")


@query("project_hash", f"""WITH {DOCS} SELECT project, 'flat' AS hash_kind, left(sha256(string_agg(concat(path, ':', left(sha256(content), 16)), '|' ORDER BY concat(path, ':', left(sha256(content), 16)))), 32) AS hash FROM docs GROUP BY project""")
def _(spark, sf):
    return history.project_hash(document_files(spark, sf))


@query("project_hash_tree", f"""WITH {DOCS}, b AS (SELECT project, left(md5(path), 3) AS b, string_agg(concat(path, ':', left(sha256(content), 16)), '|' ORDER BY concat(path, ':', left(sha256(content), 16))) AS t FROM docs GROUP BY ALL)
 SELECT project, 'tree' AS hash_kind, left(sha256(string_agg(concat(b, ':', sha256(t)), '|' ORDER BY concat(b, ':', sha256(t)))), 32) AS hash FROM b GROUP BY project""")
def _(spark, sf):
    return history.project_hash_tree(document_files(spark, sf))
