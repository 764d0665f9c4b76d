"""Inputs shared by the driver queries: the given tables seen as files, lines, messages and calls.

Source code is not among the given tables, so code files are derived from `part`: each row becomes
one file of a project, and their number grows with the table. The same expressions run in Spark
and in the checking SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import scan
from riskloom.sources.corpus import read_corpus_table, spread
from riskloom.sources.rules import Rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark, sf_dir) -> DataFrame:
    return read_corpus_table(spread(table(spark, sf_dir, "documents")), {
        "project": "source", "path": "concat(source, '/', lang, '/doc_', doc_id, '.txt')", "content": "text"})


DOCS = "docs AS (SELECT source AS project, concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, text AS content, doc_id, lang FROM documents)"
LINES = DOCS + """,
lines AS (SELECT project, path, doc_id, lang, unnest(string_split(content, chr(10))) AS line,
                 CAST(unnest(generate_series(1, len(string_split(content, chr(10))))) AS INTEGER) AS line_no FROM docs)"""


def page_files(spark, sf_dir) -> DataFrame:
    return read_corpus_table(spread(table(spark, sf_dir, "pages")), {
        "project": "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)",
        "path": "concat('site/', regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/', page_id, '.html')",
        "content": "html"})


PAGES = """pg AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS project,
  concat('site/', regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/', page_id, '.html') AS path, html AS content, url FROM pages)"""

DOC_RULES = [
    Rule("TXT-TOKEN", r'token\s*=\s*"[0-9a-f]{20,}"', category="hard_coded_secret", vuln_type="HARD_CODE_SECRET", cwe="CWE-798", severity="critical"),
    Rule("TXT-CARD", r"[3-6][0-9]{15}", category="info_leak", vuln_type="CREDENTIAL_EXPOSURE", cwe="CWE-522", severity="high"),
    Rule("TXT-EMAIL", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", category="info_leak", vuln_type="PERSONAL_INFO_EXPOSURE", cwe="CWE-359", severity="medium"),
    Rule("TXT-PHONE", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", category="info_leak", vuln_type="PERSONAL_INFO_EXPOSURE", cwe="CWE-359", severity="medium"),
    Rule("TXT-IPV4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", category="info_leak", vuln_type="INFO_LEAK", cwe="CWE-200", severity="low"),
    Rule("TXT-LICENSE", r"(?:licensed under|released under|license, version)", category="other", vuln_type="UNKNOWN", cwe="CWE-NONE", severity="info"),
]
# A second, coarser detector that stands for reviewer output.
REVIEW_RULES = [
    Rule("REV-SECRET", r"token = ", vuln_type="HARD_CODE_SECRET", cwe="CWE-798", severity="high"),
    Rule("REV-CONTACT", r"@[a-z0-9.-]+", vuln_type="PERSONAL_INFO_EXPOSURE", cwe="CWE-359", severity="low"),
]


def line_findings(files: DataFrame, rules, source: str, confidence: float = 0.75) -> DataFrame:
    return scan.make_findings(scan.scan_lines(files, rules), source, confidence)


def doc_findings(spark, sf_dir) -> DataFrame:
    return line_findings(document_files(spark, sf_dir), DOC_RULES, "quick_scan")


def review_findings(spark, sf_dir) -> DataFrame:
    return line_findings(document_files(spark, sf_dir), REVIEW_RULES, "llm", 0.9)


SEV_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def rule_values(rules) -> str:
    rows = ", ".join("('%s', '(?i)%s', '%s', '%s', '%s')" % (r.rule_id, r.pattern.replace("'", "''"), r.vuln_type, r.cwe, r.severity)
                     for r in rules)
    return f"(VALUES {rows}) AS r(rule_id, pat, vuln_type, cwe, severity)"


def findings_cte(name: str, rules, source: str, confidence: str, lines: str = "lines") -> str:
    return f"""{name} AS (SELECT project, '{source}' AS source, rule_id, path AS file, line_no AS line,
  concat(path, ':', line_no) AS location, vuln_type, cwe, severity, CAST({confidence} AS DOUBLE) AS confidence,
  concat('Possible ', vuln_type) AS title, regexp_extract(l.line, pat, 0) AS match,
  concat('Found at ', path, ':', line_no, ': ', regexp_extract(l.line, pat, 0)) AS evidence
  FROM {lines} l, {rule_values(rules)} WHERE regexp_matches(l.line, pat))"""


FINDINGS = LINES + ",\n" + findings_cte("f", DOC_RULES, "quick_scan", "0.75")
REVIEWS = findings_cte("rv", REVIEW_RULES, "llm", "0.9")

# ---------------------------------------------------------------- code derived from `part`
G = "CAST(floor(p_partkey / 12) AS BIGINT)"
TEMPLATES = {
    0: ("src/main/java/com/acme/web/Item<<G>>Controller.java", '''package com.acme.web;
import org.springframework.web.bind.annotation.*;
@RestController
@RequestMapping("/api/items<<G>>")
public class Item<<G>>Controller extends BaseController {
    @Autowired
    private Item<<G>>Service item<<G>>Service;
    // gbt: disable XSS
    @GetMapping("/find")
    public String find(@RequestParam("name") String name, @RequestHeader String token) {
        String query = "SELECT * FROM items WHERE name = " + name;
        return item<<G>>Service.search(query);
    }
    /* first pass
       gbt: ignore SQL_INJECTION
    */
    @PostMapping(value = "/admin/<<p_size>>")
    public String save(@RequestBody Item<<G>> item) {
        logger.info("saving " + item.getId());
        return item<<G>>Service.store(item);
    }
}
'''),
    1: ("src/main/java/com/acme/service/Item<<G>>Service.java", '''package com.acme.service;
@Service
public class Item<<G>>Service implements ItemApi {
    @Autowired
    private Item<<G>>Dao item<<G>>Dao;
    private String password = "Pa55word<<p_size>>";
    public String search(String query) {
        Statement stmt = conn.createStatement();
        ResultSet rs = stmt.executeQuery(query + " LIMIT <<p_size>>");
        return item<<G>>Dao.load(query);
    }
    public String store(Item<<G>> item) {
        Runtime.getRuntime().exec("sync " + item.getId());
        return "ok";
    }
}
'''),
    2: ("src/main/java/com/acme/dao/Item<<G>>Dao.java", '''package com.acme.dao;
public class Item<<G>>Dao extends BaseDao {
    public String load(String id) {
        PreparedStatement ps = conn.prepareStatement("SELECT * FROM items WHERE id = ?");
        ps.setString(1, id);
        return ps.executeQuery().toString();
    }
}
'''),
    3: ("src/main/java/com/acme/legacy/Legacy<<G>>Servlet.java", '''package com.acme.legacy;
@WebServlet("/legacy/<<G>>")
public class Legacy<<G>>Servlet extends HttpServlet {
    protected void doGet(HttpServletRequest request, HttpServletResponse response) {
        String path = request.getParameter("path");
        File file = new File("/data/" + path);
        response.sendRedirect(path);
    }
}
'''),
    4: ("src/main/java/com/acme/rest/Rest<<G>>Resource.java", '''package com.acme.rest;
@Path("/rest/<<G>>")
public class Rest<<G>>Resource extends Item<<G>>Dao {
    @GET
    @Path("/item/{id}")
    public String item(@PathParam("id") String id, @QueryParam("page") int page) {
        return "item" + id;
    }
}
'''),
    5: ("jobs/handler_<<G>>.py", '''import os
import subprocess
class Handler<<G>>(BaseHandler):
    def run(self):
        name = request.args.get("name")
        # pylint: disable=exec_check
        command = "convert " + name
        subprocess.run(command, shell=True)
        return os.system("ls <<p_size>>")
def check_<<G>>(value):
    cursor.execute("SELECT * FROM t WHERE a = " + value)
'''),
    6: ("web/page_<<G>>.php", '''<?php
$id = $_GET["id"];
$safe = intval($id);
echo system("ping " . $id);
$q = "SELECT * FROM t<<p_size>> WHERE id = " . $_POST["key"];
mysqli_query($db, $q);
$data = unserialize($_COOKIE["d"]);
// ignore: XSS
echo htmlspecialchars($id);
'''),
    7: ("api/routes/item_<<G>>.js", '''const db = require("db");
function find<<G>>(req, res) {
  const id = req.query.id;
  const rows = db.query("SELECT * FROM items WHERE id = " + id);
  res.send(render<<G>>(rows));
}
async function render<<G>>(rows) {
  document.write(rows);
  const port = process.env.PORT;
  eval(rows + <<p_size>>);
}
const token = "demo-secret-<<p_size>>";
'''),
    8: ("pom.xml", '''<project>
  <properties>
    <log4j.version>2.<<p_size>>.0</log4j.version>
  </properties>
  <dependencies>
    <dependency>
      <groupId>org.apache.logging.log4j</groupId>
      <artifactId>log4j-core</artifactId>
      <version>$<<OPEN>>log4j.version}</version>
    </dependency>
    <dependency>
      <groupId>com.alibaba</groupId>
      <artifactId>fastjson</artifactId>
      <version>1.2.<<p_size>></version>
    </dependency>
    <dependency>
      <groupId>junit</groupId>
      <artifactId>junit</artifactId>
      <version>4.12</version>
      <scope>test</scope>
    </dependency>
  </dependencies>
</project>
'''),
    9: ("module<<G>>/build.gradle", '''ext {
    springVersion = "5.2.<<p_size>>"
}
dependencies {
    implementation "org.springframework:spring-core:$springVersion"
    compile "commons-collections:commons-collections:3.2.1"
    testImplementation "junit:junit:4.13"
}
'''),
    10: ("module<<G>>/package.json", '''{"name": "module<<G>>", "dependencies": {"express": "^4.<<p_size>>.0", "lodash": "4.17.<<p_size>>"},
 "devDependencies": {"mocha": "10.0.0"}}
'''),
    11: ("module<<G>>/test/item_<<G>>_test.go", '''package test
func TestItem<<G>>(t *testing.T) {
	cmd := exec.Command("sh", "-c", os.Getenv("RUN"))
	expect(cmd)
}
'''),
}


def _sql_text(template: str) -> str:
    """A template as a concat() of literals and column expressions, valid in both engines."""
    lines = []
    for line in template.split("\n"):
        parts = []
        for i, piece in enumerate(re.split(r"<<(\w+)>>", line)):
            if i % 2:
                parts.append({"G": G, "OPEN": "'{'"}.get(piece, piece))
            elif piece:
                parts.append("'" + piece.replace("$", "'||chr(36)||'") + "'")
        lines.append("concat('', " + ", ".join(parts) + ")" if parts else "''")
    return "concat_ws(chr(10), " + ", ".join(lines) + ")"


def _case(index: int) -> str:
    arms = " ".join(f"WHEN {k} THEN {_sql_text(t[index])}" for k, t in TEMPLATES.items())
    return f"CASE p_partkey % 12 {arms} END"


CODE_PROJECT = "concat('proj', CAST(floor(p_partkey / 48) AS BIGINT))"
# pom files of one project sit in one directory per group
CODE_PATH = f"CASE WHEN p_partkey % 12 = 8 THEN concat('module', {G}, '/pom.xml') ELSE {_case(0)} END"
CODE = f"code AS (SELECT {CODE_PROJECT} AS project, {CODE_PATH} AS path, {_case(1)} AS content, p_partkey FROM part)"
CODE_LINES = CODE + """,
code_lines AS (SELECT project, path, unnest(string_split(content, chr(10))) AS line,
   CAST(unnest(generate_series(1, len(string_split(content, chr(10))))) AS INTEGER) AS line_no FROM code)"""


def code_files(spark, sf_dir) -> DataFrame:
    return read_corpus_table(spread(table(spark, sf_dir, "part")), {"project": CODE_PROJECT, "path": CODE_PATH, "content": _case(1)})


CODE_RULES = [
    Rule("JAVA-SRC-PARAM", r"@RequestParam|@RequestBody|request\.getParameter", kind="source", language="java", category="user_input"),
    Rule("JAVA-SQL", r"executeQuery\s*\([^)]*\+", kind="sink", language="java", category="sql_injection", vuln_type="SQL_INJECTION", cwe="CWE-89", severity="critical"),
    Rule("JAVA-SQLTEXT", r"select \* from [^;]*\+", kind="sink", language="java", category="sql_injection", vuln_type="SQL_INJECTION", cwe="CWE-89", severity="high"),
    Rule("JAVA-EXEC", r"getRuntime\(\)\.exec\(", kind="sink", language="java", category="command_exec", vuln_type="COMMAND_INJECTION", cwe="CWE-78", severity="critical"),
    Rule("JAVA-FILE", r"new File\([^)]*\+", kind="sink", language="java", category="file_operation", vuln_type="PATH_TRAVERSAL", cwe="CWE-22", severity="high"),
    Rule("JAVA-REDIR", r"sendRedirect\(", kind="sink", language="java", category="open_redirect", vuln_type="OPEN_REDIRECT", cwe="CWE-601", severity="medium"),
    Rule("JAVA-PASS", r'password\s*=\s*"[^"]+"', kind="sink", language="java", category="hard_coded_secret", vuln_type="HARD_CODE_PASSWORD", cwe="CWE-259", severity="high"),
    Rule("JAVA-SAN", r"prepareStatement", kind="sanitizer", language="java", category="sql"),
    Rule("PY-SRC", r"request\.args", kind="source", language="python", category="user_input"),
    Rule("PY-EXEC", r"subprocess\.run\(|os\.system\(", kind="sink", language="python", category="command_exec", vuln_type="COMMAND_INJECTION", cwe="CWE-78", severity="critical"),
    Rule("PY-SQL", r"execute\([^)]*\+", kind="sink", language="python", category="sql_injection", vuln_type="SQL_INJECTION", cwe="CWE-89", severity="high"),
    Rule("PHP-SRC", r"[$]_(?:GET|POST|COOKIE)", kind="source", language="php", category="user_input"),
    Rule("PHP-EXEC", r"system\s*\(", kind="sink", language="php", category="command_exec", vuln_type="COMMAND_INJECTION", cwe="CWE-78", severity="critical"),
    Rule("PHP-DES", r"unserialize\s*\(", kind="sink", language="php", category="deserialization", vuln_type="DESERIALIZATION", cwe="CWE-502", severity="high"),
    Rule("PHP-SAN", r"intval", kind="sanitizer", language="php", category="general"),
    Rule("JS-SRC", r"req\.query", kind="source", language="javascript", category="user_input"),
    Rule("JS-SQL", r"\.query\([^)]*\+", kind="sink", language="javascript", category="sql_injection", vuln_type="SQL_INJECTION", cwe="CWE-89", severity="high"),
    Rule("JS-XSS", r"document\.write\(", kind="sink", language="javascript", category="xss", vuln_type="XSS", cwe="CWE-79", severity="medium"),
    Rule("JS-EVAL", r"eval\(", kind="sink", language="javascript", category="code_injection", vuln_type="CODE_INJECTION", cwe="CWE-94", severity="critical"),
    Rule("GO-EXEC", r"exec\.Command\(", kind="sink", language="go", category="command_exec", vuln_type="COMMAND_INJECTION", cwe="CWE-78", severity="high"),
]
CODE_SINKS = [r for r in CODE_RULES if r.kind == "sink"]
LANG_SQL = ("CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' WHEN 'php' THEN 'php' "
            "WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'xml' THEN 'xml' ELSE 'unknown' END")


def code_findings(spark, sf_dir) -> DataFrame:
    return line_findings(code_files(spark, sf_dir), CODE_SINKS, "quick_scan")


def code_rule_values(rules) -> str:
    rows = ", ".join("('%s', '(?i)%s', '%s', '%s', '%s', '%s', '%s', '%s')" % (
        r.rule_id, r.pattern.replace("'", "''"), r.vuln_type, r.cwe, r.severity, r.language, r.kind, r.category) for r in rules)
    return f"(VALUES {rows}) AS r(rule_id, pat, vuln_type, cwe, severity, rlang, kind, category)"


CODE_FINDINGS = CODE_LINES + f""",
cf AS (SELECT project, 'quick_scan' AS source, rule_id, path AS file, line_no AS line, concat(path, ':', line_no) AS location,
  {LANG_SQL} AS language, vuln_type, cwe, severity, CAST(0.75 AS DOUBLE) AS confidence, concat('Possible ', vuln_type) AS title,
  regexp_extract(l.line, pat, 0) AS match, concat('Found at ', path, ':', line_no, ': ', regexp_extract(l.line, pat, 0)) AS evidence, l.line AS text
  FROM code_lines l, {code_rule_values(CODE_SINKS)} WHERE rlang = {LANG_SQL} AND regexp_matches(l.line, pat))"""
