"""Chunks, budgets, conversations, retrieval; Java code, symbols and call graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import CODE, CODE_FINDINGS, DOCS, FINDINGS, code_files, code_findings, doc_findings, document_files, table
from bindings.filter_queries import TIER
from riskloom.functions import texts
from riskloom.operators import chunk, java, messages, retrieve, symbols
from riskloom.sources.corpus import spread

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def tok(c):
    cjk = "[\\x{4e00}-\\x{9fff}]"
    return (f"CAST(ceil(len(regexp_extract_all({c}, '{cjk}')) * 2e0 + len(regexp_extract_all(regexp_replace({c}, '{cjk}', ' ', 'g'), '\\S+')) * 13e-1 "
            f"+ len(regexp_extract_all({c}, '[.,;:!?，。；：！？\"''（）()\\[\\]{{}}]')) * 5e-1) AS BIGINT)")


@query("chunk_lines_fixed", f"""WITH {DOCS}, l AS (SELECT project, path, string_split(content, chr(10)) AS ls FROM docs), c AS (SELECT *, unnest(generate_series(1, greatest(CAST(ceil((len(ls) - 2) / 6e0) AS BIGINT), 1))) AS chunk_no FROM l)
 SELECT project, path, CAST(chunk_no AS INTEGER) AS chunk_no, CAST((chunk_no - 1) * 6 + 1 AS INTEGER) AS line_start, CAST(least((chunk_no - 1) * 6 + 8, len(ls)) AS INTEGER) AS line_end, md5(array_to_string(ls[(chunk_no - 1) * 6 + 1:(chunk_no - 1) * 6 + 8], chr(10))) AS content_md5 FROM c""")
def _(spark, sf):
    return chunk.chunk_lines_fixed(document_files(spark, sf), 8, 2).withColumn("content_md5", F.md5("content")).drop("content")


@query("chunk_lines_sized", f"""WITH RECURSIVE {DOCS}, l AS (SELECT project, path, string_split(content, chr(10)) AS ls FROM docs),
 w AS (SELECT path, 1 AS i, 1 AS st, 0 AS used, CAST(0 AS BIGINT) AS cut_from, CAST(0 AS BIGINT) AS cut_to FROM l
  UNION ALL SELECT w.path, w.i + 1, CASE WHEN b THEN greatest(w.st, w.i - 5) ELSE w.st END,
   CASE WHEN b THEN len(array_to_string(ls[greatest(w.st, w.i - 5):w.i - 1], chr(10))) ELSE w.used END + len(ls[w.i]) + 1, CASE WHEN b THEN w.st ELSE 0 END, CASE WHEN b THEN w.i - 1 ELSE 0 END
  FROM (SELECT w.*, ls, w.used + len(ls[w.i]) + 1 > 1000 AND w.i > w.st AS b FROM w JOIN l ON l.path = w.path WHERE w.i <= len(ls)) w)
 SELECT path, CAST(cut_from AS INTEGER) AS line_start, CAST(cut_to AS INTEGER) AS line_end FROM w WHERE cut_to > 0
 UNION ALL SELECT w.path, st, w.i - 1 FROM w JOIN l ON l.path = w.path WHERE w.i = len(ls) + 1""")
def _(spark, sf):
    return chunk.chunk_lines_sized(document_files(spark, sf)).select("path", "line_start", "line_end")


EXT = "regexp_extract(path, '[.]([a-z]+)$', 1)"
SPLIT_AT = {
    "js": r"(?:function\s+(\w+)|(?:async\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(|(\w+)\s*\([^)]*\)\s*\{)",
    "py": r"(?:def\s+(\w+)|class\s+(\w+)|async\s+def\s+(\w+))",
    "java": r"(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*(?:\w+)\s+(\w+)\s*\([^)]*\)\s*\{"}
SPLIT_PATTERN = " ".join(f"WHEN '{e}' THEN regexp_replace(content, '({p})', chr(1) || '\\1', 'g')" for e, p in SPLIT_AT.items() if e != "js")
SPLIT_NAME = " ".join(f"WHEN '{e}' THEN " + "concat(" + ", ".join(f"regexp_extract(t, '^{p}', {i})" for i in range(1, p.count(r"(\w+)") + 1)) + ")" for e, p in SPLIT_AT.items() if e != "js")
JS_NAME = "concat(" + ", ".join(f"regexp_extract(t, '^{SPLIT_AT['js']}', {i})" for i in (1, 2, 3)) + ")"


@query("chunk_by_function", f"""WITH {CODE}, s AS (SELECT project, path, content, string_split(CASE {EXT} {SPLIT_PATTERN} ELSE regexp_replace(content, '({SPLIT_AT["js"]})', chr(1) || '\\1', 'g') END, chr(1)) AS ps FROM code),
 u AS (SELECT project, path, ps, unnest(ps[2:]) AS t, unnest(generate_series(1, len(ps) - 1)) AS k FROM s),
 n AS (SELECT *, 1 + len(string_split(array_to_string(ps[1:k], ''), chr(10))) - 1 AS first FROM u)
 SELECT project, path, CAST(k AS INTEGER) AS chunk_no, 'function' AS chunk_type, CASE {EXT} {SPLIT_NAME} ELSE {JS_NAME} END AS name, CAST(first AS INTEGER) AS line_start, CAST(first + len(string_split(t, chr(10))) - 1 AS INTEGER) AS line_end, t AS content FROM n
 UNION ALL SELECT project, path, 1, 'block', NULL, 1, CAST(len(string_split(content, chr(10))) AS INTEGER), content FROM s WHERE len(ps) = 1""")
def _(spark, sf):
    return chunk.chunk_by_function(code_files(spark, sf))


# (extensions, order, kind, pattern); the groups of a pattern hold the name
STARTS = [("java", 1, "class", r"^(?:public|private|protected)?\s*(?:static\s+)?class\s+(\w+)"),
          ("java", 2, "function", r"^(?:public|private|protected)?\s*(?:static\s+)?[\w<>\[\],\s]+\s+(\w+)\s*\([^;]*\)\s*\{?\s*$"),
          ("py", 1, "comment", r"^\s*@()"), ("py", 2, "function", r"^\s*(?:async\s+def|def)\s+(\w+)\s*\("), ("py", 3, "class", r"^\s*class\s+(\w+)"),
          ("go", 1, "function", r"^\s*func\s+(\w+)"), ("go", 2, "class", r"^\s*type\s+(\w+)\s+struct\b"), ("go", 3, "class", r"^\s*type\s+(\w+)\s+interface\b"),
          ("php", 1, "class", r"^(?:abstract\s+|final\s+)?class\s+(\w+)"), ("php", 2, "function", r"^(?:public|private|protected)?\s*function\s+(\w+)"),
          ("js", 1, "function", r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("js", 2, "class", r"^(?:export\s+)?class\s+(\w+)"),
          ("js", 3, "function", r"^(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\("), ("js", 4, "function", r"^\s*(\w+)\s*:\s*(?:async\s*)?\("),
          ("js", 5, "function", r"^(\w+)\s*\([^)]*\)\s*\{$")]
START_ROWS = ", ".join(f"('{e}', {o}, '{k}', '{p}')" for e, o, k, p in STARTS)


@query("chunk_structure", f"""WITH {CODE}, f AS (SELECT project, path, content, string_split(content, chr(10)) AS ls, CASE WHEN {EXT} IN ('java', 'py', 'go', 'php') THEN {EXT} ELSE 'js' END AS e FROM code),
 l AS (SELECT project, path, e, unnest(ls) AS t, unnest(generate_series(1, len(ls))) AS i, len(ls) AS n FROM f),
 d AS (SELECT *, sum(len(t) - len(replace(t, '{{', '')) - (len(t) - len(replace(t, '}}', '')))) OVER (PARTITION BY project, path ORDER BY i) AS lvl FROM l),
 g AS (SELECT d.*, lvl - (len(t) - len(replace(t, '{{', '')) - (len(t) - len(replace(t, '}}', '')))) AS base, first(p.kind ORDER BY p.o) AS kind, first(regexp_extract(t, p.pat, 1) ORDER BY p.o) AS name FROM d JOIN (VALUES {START_ROWS}) AS p(e, o, kind, pat) ON p.e = d.e AND regexp_matches(t, p.pat) GROUP BY ALL),
 w AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY project, path ORDER BY i) - 1, n) AS stop FROM g),
 x AS (SELECT project, path, kind, name, i, coalesce((SELECT min(d.i) FROM d WHERE d.project = w.project AND d.path = w.path AND d.i BETWEEN w.i AND w.stop AND contains(d.t, '}}') AND d.lvl <= w.base), stop) AS last FROM w WHERE kind <> 'comment')
 SELECT x.project, x.path, CAST(row_number() OVER (PARTITION BY x.project, x.path ORDER BY i) AS INTEGER) AS chunk_no, kind AS chunk_type, name, CAST(i AS INTEGER) AS line_start, CAST(last AS INTEGER) AS line_end, array_to_string(ls[i:last], chr(10)) AS content FROM x JOIN f ON f.project = x.project AND f.path = x.path
 UNION ALL SELECT project, path, 1, 'block', NULL, 1, CAST(len(ls) AS INTEGER), content FROM f WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.project = f.project AND x.path = f.path)""")
def _(spark, sf):
    return chunk.chunk_structure(code_files(spark, sf))


@query("chunk_semantic")
def _(spark, sf):
    return chunk.chunk_semantic(code_files(spark, sf), 60)


SEVTEXT = "concat_ws(' ', 'Intro', p_name, CASE p_partkey % 4 WHEN 0 THEN 'Critical:' WHEN 1 THEN 'high' WHEN 2 THEN 'Medium:' ELSE 'Low' END, p_brand, 'info on', 'HIGH', 'end')"


@query("chunk_by_severity", f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS s1 FROM part)
 SELECT p_partkey AS doc_id, 0 AS chunk_no, 'Info' AS severity FROM t UNION ALL SELECT p_partkey, 1, s1 FROM t UNION ALL SELECT p_partkey, 2, 'High' FROM t""")
def _(spark, sf):
    t = table(spark, sf, "part").selectExpr("p_partkey AS doc_id", f"{SEVTEXT} AS text")
    return chunk.chunk_by_severity(t).select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), "severity")


@query("estimate_tokens", f"""WITH {DOCS} SELECT path, {tok('content')} AS by_words, CAST(ceil(len(content) * 3e-1) AS BIGINT) AS by_chars, CAST(ceil(len(content) / 4e0) AS BIGINT) AS by_quarter FROM docs""")
def _(spark, sf):
    c = F.col("content")
    return document_files(spark, sf).select("path", texts.estimate_tokens(c).alias("by_words"), texts.estimate_tokens(c, "chars").alias("by_chars"), texts.estimate_tokens(c, "quarter").alias("by_quarter"))


@query("message_tokens", f"SELECT conv_id, count(*) AS messages, CAST(sum({tok('text')} + 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return messages.message_tokens(table(spark, sf, "conversations"))


@query("token_precheck", f"""WITH t AS (SELECT conv_id, CAST(sum({tok('text')} + 4) + 512 AS BIGINT) AS current_tokens FROM conversations GROUP BY conv_id)
 SELECT *, CAST(1700 AS INTEGER) AS max_tokens, current_tokens <= 1700 AS ok, printf('%.1f', current_tokens * 1e2 / 1700) AS usage_percent FROM t""")
def _(spark, sf):
    return messages.token_precheck(table(spark, sf, "conversations"), 2000)


@query("keep_recent_messages", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role <> 'system' ORDER BY turn DESC) AS back FROM conversations), o AS (SELECT *, role <> 'system' AND back > 3 AS old FROM m)
 SELECT conv_id, CASE WHEN role <> 'system' THEN 2 ELSE 0 END AS part, turn, role, md5(text) AS text_md5 FROM o WHERE NOT old UNION ALL SELECT conv_id, 1, -1, 'system', CAST(count(*) AS VARCHAR) FROM o WHERE old GROUP BY conv_id""")
def _(spark, sf):
    k = messages.keep_recent_messages(table(spark, sf, "conversations"), 3)
    return k.select("conv_id", "part", "turn", "role", F.when(F.col("part") == 1, F.regexp_extract("text", r"\[(\d+) earlier", 1)).otherwise(F.md5("text")).alias("text_md5"))


@query("token_rounds", f"""WITH RECURSIVE m AS (SELECT conv_id, turn, CAST({tok('text')} AS BIGINT) AS ti, CAST(len(text) // 10 AS BIGINT) AS tt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS tin, CAST(0 AS BIGINT) AS tout, FALSE AS soft, FALSE AS hard, 0 AS comp, CAST(0 AS BIGINT) AS total, CAST(-1 AS BIGINT) AS turn FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL SELECT m.conv_id, m.i, CASE WHEN w.hard THEN 80 ELSE w.tin END + m.ti, CASE WHEN w.hard THEN 0 ELSE w.tout END + m.tt,
   (CASE WHEN w.hard THEN FALSE ELSE w.soft END) OR ((CASE WHEN w.hard THEN 80 ELSE w.tin + w.tout END + m.ti + m.tt) / 4e2 >= 6e-1 AND (CASE WHEN w.hard THEN 80 ELSE w.tin + w.tout END + m.ti + m.tt) / 4e2 < 8e-1),
   (CASE WHEN w.hard THEN 80 ELSE w.tin + w.tout END + m.ti + m.tt) / 4e2 >= 8e-1, w.comp + CASE WHEN w.hard THEN 1 ELSE 0 END, CASE WHEN w.hard THEN 80 ELSE w.tin + w.tout END + m.ti + m.tt, m.turn
  FROM w JOIN m ON m.conv_id = w.conv_id AND m.i = w.i + 1)
 SELECT conv_id, turn, CAST(i AS INTEGER) AS round, total, floor(total / 4e2 * 1e2 + 5e-1) / 1e2 AS ratio, soft, hard, comp AS compressions, CAST(greatest(0, floor((400 * 8e-1 - total) / (total / CAST(i AS DOUBLE)))) AS BIGINT) AS rounds_left FROM w WHERE i > 0""")
def _(spark, sf):
    r = table(spark, sf, "conversations").select("conv_id", "turn", texts.estimate_tokens(F.col("text")).alias("input_tokens"), F.floor(F.length("text") / 10).alias("output_tokens"))
    return messages.token_rounds(r, 400)


RANKP = "CASE WHEN regexp_matches(lower(path), '(/controller/|/config/|/util/|security|auth|login|admin)') THEN 200 WHEN regexp_matches(lower(path), '(auth|permission|policy|access|role|upload|secret|query|service)') THEN 60 ELSE 0 END"


@query("rank_files", f"""WITH {CODE_FINDINGS} SELECT project, path, round(least(len(content) / 2e2, 8e1) * CASE WHEN path LIKE '%.java' THEN 12e-1 WHEN path LIKE '%.py' THEN 11e-1 ELSE 1e0 END + CASE WHEN EXISTS (SELECT 1 FROM cf WHERE cf.project = code.project AND cf.file = code.path) THEN 120 ELSE 0 END
  + {RANKP} + CASE WHEN contains(lower(path), 'route') THEN 5 ELSE 0 END, 6) AS score FROM code""")
def _(spark, sf):
    return chunk.rank_files(code_files(spark, sf), code_findings(spark, sf), ["Route"]).select("project", "path", F.round("score", 6).alias("score"))


@query("prioritize_files", f"""WITH {CODE_FINDINGS} SELECT project, path, CAST(CASE WHEN regexp_matches(lower(path), 'auth|login|user|permission|role|admin|security') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(path), 'api|controller|handler|service') THEN 8 ELSE 0 END
  + CASE WHEN regexp_matches(lower(path), 'config|settings|env') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(path, '[.](java|py|js|ts)$') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(lower(path), 'test|spec|mock') THEN 20 ELSE 0 END
  + 3 * (SELECT count(*) FROM cf WHERE cf.project = code.project AND cf.file = code.path) + CASE WHEN len(content) > 1000 AND len(content) < 50000 THEN 3 ELSE 0 END AS BIGINT) AS score FROM code""")
def _(spark, sf):
    return chunk.prioritize_files(code_files(spark, sf), code_findings(spark, sf)).select("project", "path", "score")


@query("pack_batches", f"""WITH RECURSIVE {CODE}, r AS (SELECT project, path, len(content) AS chars, {tok('content')} AS tokens, row_number() OVER (PARTITION BY project ORDER BY {TIER}, len(content), path) AS i FROM code),
 w AS (SELECT project, CAST(0 AS BIGINT) AS i, 1 AS batch, 0 AS n, 0 AS c, 0 AS t, '' AS path FROM (SELECT DISTINCT project FROM r)
  UNION ALL SELECT r.project, r.i, CASE WHEN b THEN batch + 1 ELSE batch END, CASE WHEN b THEN 0 ELSE n END + 1, CASE WHEN b THEN 0 ELSE c END + chars + len(r.path), CASE WHEN b THEN 0 ELSE t END + tokens + 10, r.path
  FROM (SELECT w.project, w.i AS wi, batch, n, c, t, r.i, r.path, chars, tokens, n > 0 AND (n >= 6 OR t + tokens + 10 > 900 OR c + chars + len(r.path) > 3000) AS b FROM w JOIN r ON r.project = w.project AND r.i = w.i + 1) r)
 SELECT project, path, batch FROM w WHERE i > 0""")
def _(spark, sf):
    return chunk.pack_batches(code_files(spark, sf), chunk.BatchLimits(6, 3000, 900)).select("project", "path", "batch")


@query("token_budget", f"""WITH {CODE}, s AS (SELECT project, CAST(ceil(sum(len(content)) / 4e0) AS BIGINT) AS total_tokens, CAST(ceil(coalesce(sum(len(content)) FILTER (path LIKE '%.java'), 0) / 4e0) AS BIGINT) AS priority_tokens FROM code GROUP BY project)
 SELECT *, 5000 AS remaining, 4500 AS safe_budget, total_tokens > 4500 AS needs_compression, round(4500e0 / greatest(total_tokens, 1), 6) AS ratio FROM s""")
def _(spark, sf):
    return chunk.token_budget(code_files(spark, sf), 5000, priority=F.col("path").endswith(".java")).withColumn("ratio", F.round("ratio", 6))


@query("truncate_tail", f"""WITH {DOCS}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(1, len(string_split(content, chr(10))))) AS i, len(string_split(content, chr(10))) AS n FROM docs),
 s AS (SELECT *, sum({tok('line')}) OVER (PARTITION BY path ORDER BY i DESC) AS used FROM l) SELECT path, CAST(count(*) FILTER (used <= 120) AS INTEGER) AS kept_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (used <= 120), '')) AS content_md5 FROM s GROUP BY path""")
def _(spark, sf):
    return chunk.truncate_tail(document_files(spark, sf), 120).select("path", "kept_lines", F.md5("content").alias("content_md5"))


@query("truncate_ratio", f"""WITH {DOCS}, t AS (SELECT path, content, {tok('content')} AS k FROM docs) SELECT path, k > 200 AS truncated,
  md5(CASE WHEN k > 200 THEN concat(substr(content, 1, CAST(floor(len(content) * (200e0 / k) * 9e-1) AS BIGINT)), '...[truncated]') ELSE content END) AS content_md5 FROM t""")
def _(spark, sf):
    return chunk.truncate_ratio(document_files(spark, sf), 200).select("path", "truncated", F.md5("content").alias("content_md5"))


@query("retrieve_docs", """WITH q AS (SELECT item_id AS query_id, lower(text) AS q FROM benchmark), w AS (SELECT query_id, unnest(regexp_split_to_array(q, '\\s+')) AS word FROM q), d AS (SELECT doc_id, lower(text) AS c, lower(left(text, 60)) AS title, lower(lang) AS tag FROM documents),
 s AS (SELECT query_id, doc_id, count(*) AS pts FROM w JOIN d ON word <> '' AND contains(c, word) GROUP BY ALL UNION ALL SELECT query_id, doc_id, 10 FROM q JOIN d ON contains(title, q) UNION ALL SELECT query_id, doc_id, 5 FROM q JOIN d ON contains(tag, q)),
 t AS (SELECT query_id, doc_id, CAST(sum(pts) AS BIGINT) AS score FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM t) SELECT query_id, doc_id, score FROM k WHERE rn <= 5""")
def _(spark, sf):
    q = table(spark, sf, "benchmark").selectExpr("item_id AS query_id", "text")
    d = spread(table(spark, sf, "documents")).selectExpr("doc_id", "left(text, 60) AS title", "array(lang) AS tags", "text AS content")
    return retrieve.retrieve_docs(q, d, 5)


# ---------------------------------------------------------------- symbols
KIND = "(p_partkey % 12)"
K = f"k AS (SELECT {KIND} AS k, CAST(floor(p_partkey / 12) AS BIGINT) AS g, p_size, CASE WHEN 1 = 1 THEN code.project END AS project, code.path FROM part JOIN code USING (p_partkey))"


@query("symbols", f"""WITH {CODE}, {K}, s AS (SELECT project, path, 'class' AS kind, CASE k WHEN 0 THEN concat('Item', g, 'Controller') WHEN 1 THEN concat('Item', g, 'Service') WHEN 2 THEN concat('Item', g, 'Dao') WHEN 3 THEN concat('Legacy', g, 'Servlet') WHEN 4 THEN concat('Rest', g, 'Resource') WHEN 5 THEN concat('Handler', g) END AS name,
  CASE k WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 3 END AS line, CASE k WHEN 0 THEN 'BaseController' WHEN 1 THEN 'ItemApi' WHEN 2 THEN 'BaseDao' WHEN 3 THEN 'HttpServlet' WHEN 4 THEN concat('Item', g, 'Dao') WHEN 5 THEN 'BaseHandler' END AS supers FROM k WHERE k <= 5) SELECT * FROM s""")
def _(spark, sf):
    return symbols.symbols(code_files(spark, sf)).where("kind = 'class'").select("project", "path", "kind", "name", "line", F.array_join("supers", ",").alias("supers"))


MEMBERS = f"""mb AS (SELECT project, path, u.kind, u.name, u.line FROM k, LATERAL (SELECT * FROM (VALUES (0, 'field', concat('item', k.g, 'Service'), 7), (0, 'method', 'find', 10), (0, 'method', 'save', 18), (1, 'field', concat('item', k.g, 'Dao'), 5), (1, 'field', 'password', 6),
   (1, 'method', 'search', 7), (1, 'field', 'stmt', 8), (1, 'field', 'rs', 9), (1, 'method', 'store', 12), (0, 'field', 'query', 11), (2, 'method', 'load', 3), (2, 'field', 'ps', 4), (3, 'method', 'doGet', 4), (3, 'field', 'path', 5), (3, 'field', 'file', 6), (4, 'method', 'item', 6)) AS v(kk, kind, name, line) WHERE v.kk = k.k) u)"""


@query("symbol_members", f"WITH {CODE}, {K}, {MEMBERS} SELECT * FROM mb")
def _(spark, sf):
    return symbols.symbols(code_files(spark, sf)).where("kind <> 'class' AND path LIKE '%.java'").select("project", "path", "kind", "name", "line")


@query("symbol_stats", f"""WITH {CODE}, {K}, {MEMBERS}, p AS (SELECT project, count(*) FILTER (k <= 5) AS c, count(*) FILTER (k = 5) AS py FROM k GROUP BY project HAVING count(*) FILTER (k <= 5) > 0), m AS (SELECT project, count(*) FILTER (kind = 'method') AS me, count(*) FILTER (kind = 'field') AS fi FROM mb GROUP BY project)
 SELECT p.project, p.c AS classes, m.me + 2 * p.py AS methods, m.fi + p.py * 2 AS fields FROM p JOIN m ON m.project = p.project""")
def _(spark, sf):
    return symbols.symbol_stats(symbols.symbols(code_files(spark, sf)))


@query("symbol_search", f"""WITH {CODE}, {K} SELECT project, concat('Item', g, 'Dao') AS owner, 'load' AS name FROM k WHERE k = 2""")
def _(spark, sf):
    return symbols.symbol_search(symbols.symbols(code_files(spark, sf)), method="load").select("project", "owner", "name")


@query("class_hierarchy", f"""WITH {CODE}, {K}, d AS (SELECT project, CASE k WHEN 0 THEN concat('Item', g, 'Controller') WHEN 1 THEN concat('Item', g, 'Service') WHEN 2 THEN concat('Item', g, 'Dao') WHEN 3 THEN concat('Legacy', g, 'Servlet') WHEN 4 THEN concat('Rest', g, 'Resource') ELSE concat('Handler', g) END AS class,
   CASE k WHEN 0 THEN 'BaseController' WHEN 1 THEN 'ItemApi' WHEN 2 THEN 'BaseDao' WHEN 3 THEN 'HttpServlet' WHEN 4 THEN concat('Item', g, 'Dao') ELSE 'BaseHandler' END AS related FROM k WHERE k <= 5)
 SELECT project, class, related, 1 AS depth FROM d UNION ALL SELECT a.project, a.class, b.related, 2 FROM d a JOIN d b ON a.project = b.project AND a.related = b.class""")
def _(spark, sf):
    return symbols.class_hierarchy(symbols.symbols(code_files(spark, sf)))


@query("function_index", f"""WITH {CODE}, {K} SELECT project, path, u.name, u.line FROM k, LATERAL (SELECT * FROM (VALUES (0, 'find', 10), (0, 'save', 18), (1, 'search', 7), (1, 'store', 12), (2, 'load', 3), (3, 'doGet', 4), (4, 'item', 6), (5, concat('check_', k.g), 10), (7, concat('find', k.g), 2), (7, concat('render', k.g), 7), (11, concat('TestItem', k.g), 2)) AS v(kk, name, line) WHERE v.kk = k.k) u""")
def _(spark, sf):
    return symbols.function_index(code_files(spark, sf)).select("project", "path", "name", "line")


@query("call_tree", f"""WITH {CODE}, {K}, j AS (SELECT a.project, a.g, a.path, b.path AS svc, c.path AS dao FROM k a LEFT JOIN k b ON b.project = a.project AND b.g = a.g AND b.k = 1 LEFT JOIN k c ON c.project = a.project AND c.g = a.g AND c.k = 2 WHERE a.k = 7)
 SELECT project, path AS root_path, concat('find', g) AS root, 1 AS depth, path, concat('find', g) AS name, 2 AS line FROM j UNION ALL SELECT project, path, concat('find', g), 2, path, concat('render', g), 7 FROM j""")
def _(spark, sf):
    idx = symbols.function_index(code_files(spark, sf))
    return symbols.call_tree(idx, idx.where("name LIKE 'find_%' AND path LIKE '%.js'"), 3)


# ---------------------------------------------------------------- Java web code
ROUTES = f"""rt AS (SELECT project, path, g, p_size, u.* FROM k, LATERAL (SELECT * FROM (VALUES (0, 'Spring MVC', 'GET', concat('/api/items', k.g, '/find'), 9, concat('Item', k.g, 'Controller'), 'find', 'name', 'item'), (0, 'Spring MVC', 'POST', concat('/api/items', k.g, '/admin/', k.p_size), 17, concat('Item', k.g, 'Controller'), 'save', 'name', 'item'),
   (3, 'Servlet', 'ANY', concat('/legacy/', k.g), 2, concat('Legacy', k.g, 'Servlet'), 'service', '', ''), (4, 'JAX-RS', 'GET', concat('/rest/', k.g, '/item/{{id}}'), 4, concat('Rest', k.g, 'Resource'), 'item', 'page', '')) AS v(kk, framework, http_method, url_path, line, class_name, method_name, query_params, body_params) WHERE v.kk = k.k) u)"""


def _routes(spark, sf):
    return java.extract_routes(code_files(spark, sf))


@query("detect_frameworks", f"""WITH {CODE}, f AS (SELECT project, path, unnest(list_filter([CASE WHEN path LIKE '%.java' AND regexp_matches(content, '@(Rest)?Controller\\b|@(Request|Get|Post|Put|Delete|Patch)Mapping\\b') THEN 'spring_mvc' END, CASE WHEN path LIKE '%.java' AND regexp_matches(content, '@WebServlet|extends HttpServlet') THEN 'servlet' END,
  CASE WHEN path LIKE '%.java' AND contains(content, '@Path(') THEN 'jax_rs' END], lambda x: x IS NOT NULL)) AS framework FROM code) SELECT project, framework, min(path) AS evidence FROM f GROUP BY ALL""")
def _(spark, sf):
    return java.detect_frameworks(code_files(spark, sf))


@query("extract_routes", f"WITH {CODE}, {K}, {ROUTES} SELECT project, path, framework, http_method, url_path, line, class_name, method_name, query_params, body_params FROM rt")
def _(spark, sf):
    return _routes(spark, sf).select("project", "path", "framework", "http_method", "url_path", "line", "class_name", "method_name",
                                     F.array_join("query_params", ",").alias("query_params"), F.array_join("body_params", ",").alias("body_params"))


@query("route_stats", f"WITH {CODE}, {K}, {ROUTES} SELECT project, 'framework' AS kind, framework AS value, count(*) AS n FROM rt GROUP BY ALL UNION ALL SELECT project, 'http_method', http_method, count(*) FROM rt GROUP BY ALL")
def _(spark, sf):
    return java.route_stats(_routes(spark, sf))


@query("infer_param_type", f"""WITH {CODE}, {K}, {ROUTES} SELECT project, url_path, 'query' AS place, query_params AS name, CASE query_params WHEN 'page' THEN 'Integer' ELSE 'String' END AS type FROM rt WHERE query_params <> ''
 UNION ALL SELECT project, url_path, 'body', body_params, 'String' FROM rt WHERE body_params <> '' UNION ALL SELECT project, url_path, 'path', 'id', 'Integer' FROM rt WHERE framework = 'JAX-RS'""")
def _(spark, sf):
    return java.route_params(_routes(spark, sf)).select("project", "url_path", "place", "name", "type")


@query("entry_methods", f"""WITH {CODE}, {K} SELECT project, path, u.method, u.line, u.n_params FROM k, LATERAL (SELECT * FROM (VALUES (0, 'find', 10, 2), (0, 'save', 18, 1), (4, 'item', 6, 2)) AS v(kk, method, line, n_params) WHERE v.kk = k.k) u""")
def _(spark, sf):
    return java.entry_methods(java.java_facts(code_files(spark, sf))).select("project", "path", "method", "line", F.size("params").alias("n_params"))


@query("method_calls", f"""WITH {CODE}, {K} SELECT project, path, u.caller, u.target, u.method FROM k, LATERAL (SELECT * FROM (VALUES (0, 'find', concat('Item', k.g, 'Service'), 'search'), (0, 'save', concat('Item', k.g, 'Service'), 'store'), (1, 'search', concat('Item', k.g, 'Dao'), 'load')) AS v(kk, caller, target, method) WHERE v.kk = k.k) u""")
def _(spark, sf):
    return java.method_calls(java.java_facts(code_files(spark, sf))).select("project", "path", "caller", "target", "method")


@query("inject_deps", f"""WITH {CODE}, {K} SELECT project, path, CASE k WHEN 0 THEN concat('item', g, 'Service') ELSE concat('item', g, 'Dao') END AS name, CASE k WHEN 0 THEN concat('Item', g, 'Service') ELSE concat('Item', g, 'Dao') END AS type FROM k WHERE k <= 1""")
def _(spark, sf):
    return java.inject_deps(code_files(spark, sf))


@query("body_sinks", f"""WITH {CODE}, {K} SELECT project, path, u.method, u.sink FROM k, LATERAL (SELECT * FROM (VALUES (1, 'search', 'SQL'), (1, 'store', 'COMMAND'), (2, 'load', 'SQL'), (3, 'doGet', 'FILE')) AS v(kk, method, sink) WHERE v.kk = k.k) u""")
def _(spark, sf):
    return java.body_sinks(java.java_facts(code_files(spark, sf))).select("project", "path", "method", "sink")


CHAIN = f"""{ROUTES}, cc AS (SELECT project, url_path AS route, http_method, 1 AS level, class_name, method_name AS method FROM rt WHERE framework <> 'Servlet'
  UNION ALL SELECT r.project, url_path, http_method, 2, concat('Item', r.g, 'Service'), CASE method_name WHEN 'find' THEN 'search' ELSE 'store' END FROM rt r WHERE framework = 'Spring MVC' AND EXISTS (SELECT 1 FROM k WHERE k.project = r.project AND k.g = r.g AND k.k = 1)
  UNION ALL SELECT r.project, url_path, http_method, 3, concat('Item', r.g, 'Dao'), 'load' FROM rt r WHERE method_name = 'find' AND EXISTS (SELECT 1 FROM k WHERE k.project = r.project AND k.g = r.g AND k.k = 1) AND EXISTS (SELECT 1 FROM k WHERE k.project = r.project AND k.g = r.g AND k.k = 2))"""


def _chain(spark, sf):
    files = code_files(spark, sf)
    return java.call_chain(java.extract_routes(files), java.java_facts(files))


@query("call_chain", f"WITH {CODE}, {K}, {CHAIN} SELECT project, route, http_method, level, class_name, method FROM cc")
def _(spark, sf):
    return _chain(spark, sf).select("project", "route", "http_method", "level", "class_name", "method")


@query("controllability", f"""WITH {CODE}, {K}, {ROUTES} SELECT project, url_path AS route, u.param, u.used, u.used AS controllable FROM rt, LATERAL (SELECT * FROM (VALUES ('find', 'name', TRUE), ('find', 'token', FALSE), ('save', 'item', TRUE), ('item', 'id', TRUE), ('item', 'page', FALSE)) AS v(m, param, used) WHERE v.m = rt.method_name) u""")
def _(spark, sf):
    return java.controllability(_chain(spark, sf)).select("project", "route", "param", "used", "controllable")


@query("trace_stats", f"""WITH {CODE}, {K}, {CHAIN} SELECT project, route, http_method, count(*) AS layers, string_agg(concat('[L', level, '] ', class_name, '.', method, '()'), ' -> ' ORDER BY level) AS chain, count(*) FILTER (level > 1) AS terminal_points FROM cc GROUP BY ALL""")
def _(spark, sf):
    c = _chain(spark, sf)
    return java.trace_stats(c, java.controllability(c)).select("project", "route", "http_method", "layers", "chain", "terminal_points")


@query("risky_routes", f"""WITH {CODE_FINDINGS}, {K}, {ROUTES}, h AS (SELECT * FROM rt WHERE contains(url_path, 'admin') OR contains(url_path, 'api') OR EXISTS (SELECT 1 FROM cf WHERE cf.project = rt.project AND cf.file = rt.path))
 SELECT project, path, url_path FROM h""")
def _(spark, sf):
    return java.risky_routes(_routes(spark, sf), code_findings(spark, sf)).select("project", "path", "url_path")


@query("route_findings", f"""WITH {CODE}, {K}, {CHAIN}, s AS (SELECT project, route, max(CASE WHEN level > 1 AND method <> 'store' THEN 1 ELSE 0 END) AS sql, max(CASE WHEN method = 'store' THEN 1 ELSE 0 END) AS cmd FROM cc GROUP BY ALL)
 SELECT project, route, 'critical' AS severity, CASE WHEN sql = 1 THEN 'SQL_INJECTION' ELSE 'COMMAND' END AS vuln_type FROM s WHERE sql + cmd > 0""")
def _(spark, sf):
    c = _chain(spark, sf)
    p = java.controllability(c)
    return java.route_findings(java.trace_stats(c, p), p).select("project", "route", "severity", "vuln_type")


@query("dependency_context", f"""WITH {CODE}, {K}, {ROUTES} SELECT a.project, concat('Item', a.g, 'Service.search') AS node, CAST(EXISTS (SELECT 1 FROM k c WHERE c.project = a.project AND c.g = a.g AND c.k = 0) AS BIGINT) AS upstream, CAST(EXISTS (SELECT 1 FROM k c WHERE c.project = a.project AND c.g = a.g AND c.k = 2) AS BIGINT) AS downstream FROM k a WHERE a.k = 1
  AND EXISTS (SELECT 1 FROM k c WHERE c.project = a.project AND c.g = a.g AND c.k IN (0, 2))""")
def _(spark, sf):
    facts = java.java_facts(code_files(spark, sf))
    node = F.concat_ws(".", "class_name", "method")
    calls = java.method_calls(facts)
    edges = calls.select("project", F.concat_ws(".", "class_name", "caller").alias("src"), F.concat_ws(".", "target", "method").alias("dst"))
    nodes = facts.select("project", node.alias("node"), F.col("body").alias("code"), F.lit("java").alias("extension"))
    real = nodes.select("project", F.col("node").alias("dst"))
    edges = edges.join(real, ["project", "dst"], "left_semi")
    f = facts.where("method = 'search'").select("project", node.alias("node"))
    return symbols.dependency_context(f, edges, nodes).where("upstream IS NOT NULL").select("project", "node", "upstream", "downstream")
