"""Many rules at once, affected version ranges, and what given symbols reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import DOCS, code_files, document_files, table
from bindings.source_queries import DEPS
from riskloom.operators import advisories, reach, scan
from riskloom.sources import hash_tree, manifests
from riskloom.sources.rules import Rule

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


# 300 rules: a pair of syllables and what follows it in the word; and three rules without any string that must be there
HEADS = "th re de la ver ein an in er en on ch st ou er".split()
TAILS = "tion ment eau keit lich ung ent ing ble heit elle ere oi cion ado os re nd ier aux".split()
OPEN = [r"[0-9]{4,}", r"\+[0-9]|%{3}", r"[A-Z][0-9]"]


def many_rules() -> list[Rule]:
    pairs = sorted({h + t for h in HEADS for t in TAILS})
    return [Rule(f"S-{p}", p + "[a-z]{0,4}") for p in pairs] + [Rule(f"O-{i}", p) for i, p in enumerate(OPEN)]


PAIRS = ", ".join(f"'{h}'" for h in HEADS), ", ".join(f"'{t}'" for t in TAILS)


@query("scan_many_rules", f"""WITH r AS (SELECT DISTINCT h || t AS s FROM (SELECT unnest([{PAIRS[0]}]) AS h) a, (SELECT unnest([{PAIRS[1]}]) AS t) b),
 d AS (SELECT *, lower(text) AS low FROM documents),
 m AS (SELECT 'S-' || s AS rule_id, len(regexp_extract_all(text, '(?i)' || s || '[a-z]{{0,4}}')) AS n FROM d JOIN r ON contains(low, s)
   UNION ALL SELECT 'O-0', len(regexp_extract_all(text, '[0-9]{{4,}}')) FROM d UNION ALL SELECT 'O-1', len(regexp_extract_all(text, '\\+[0-9]|%{{3}}')) FROM d
   UNION ALL SELECT 'O-2', len(regexp_extract_all(text, '(?i)[A-Z][0-9]')) FROM d)
 SELECT rule_id, count(*) AS files, CAST(sum(n) AS BIGINT) AS matches FROM m WHERE n > 0 GROUP BY rule_id""")
def _(spark, sf):
    hits = scan.scan_rules(document_files(spark, sf), many_rules())
    per_file = hits.groupBy("rule_id", "project", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("rule_id").agg(F.count("*").alias("files"), F.sum("n").alias("matches"))


@query("match_advisories", f"""WITH {DEPS}, v AS (SELECT *, CAST(regexp_extract(version, '([0-9]+)(?:\\.0)?$', 1) AS INTEGER) AS n, CAST(string_split(version, '.')[2] AS VARCHAR) AS minor FROM dp),
 h AS (SELECT project, path AS file, group_id || ':' || artifact AS component, version, 'CVE-2021-44228' AS cve, 'critical' AS severity, '2.17.1' AS fix_version FROM v WHERE artifact = 'log4j-core' AND CAST(minor AS INTEGER) <= 14
   UNION ALL SELECT project, path, group_id || ':' || artifact, version, 'CVE-2021-45046', 'critical', '2.17.1' FROM v WHERE artifact = 'log4j-core' AND version = '2.15.0'
   UNION ALL SELECT project, path, group_id || ':' || artifact, version, 'CVE-2022-25845', 'critical', '1.2.83' FROM v WHERE artifact = 'fastjson' AND CAST(string_split(version, '.')[3] AS INTEGER) <= 80
   UNION ALL SELECT project, path, group_id || ':' || artifact, version, 'CVE-2020-8840', 'critical', '1.2.84' FROM v WHERE artifact = 'fastjson' AND CAST(string_split(version, '.')[3] AS INTEGER) <= 68
   UNION ALL SELECT project, path, group_id || ':' || artifact, version, 'CVE-2022-22965', 'critical', '5.3.18' FROM v WHERE artifact = 'spring-core' AND CAST(string_split(version, '.')[3] AS INTEGER) <= 19
   UNION ALL SELECT project, path, group_id || ':' || artifact, version, 'CVE-2015-6420', 'critical', '3.2.2' FROM v WHERE artifact = 'commons-collections' AND version = '3.2.1')
 SELECT project, file, component, version, cve, severity, fix_version FROM (SELECT *, row_number() OVER (PARTITION BY project, component, cve ORDER BY file, version) AS rn FROM h) WHERE rn = 1""")
def _(spark, sf):
    found = advisories.match_advisories(manifests.parse_dependencies(code_files(spark, sf)))
    return found.select("project", "file", "component", "version", "cve", "severity", "fix_version")


@query("reach_suppliers", """WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), s AS (SELECT o_orderkey AS o FROM orders WHERE o_orderkey % 500 = 0),
 one AS (SELECT DISTINCT s.o AS seed, p FROM s JOIN e ON e.o = s.o), two AS (SELECT DISTINCT seed, e.o FROM one JOIN e USING (p))
 SELECT seed, depth, count(*) AS nodes FROM (SELECT seed, 1 AS depth, p FROM one UNION ALL SELECT seed, 2, o FROM two WHERE o <> seed) GROUP BY ALL UNION ALL SELECT o, 0, 1 FROM s""")
def _(spark, sf):
    """Orders that share a part with given orders, over the graph of orders and parts: parts at depth 1, orders at depth 2."""
    at = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    pairs = table(spark, sf, "lineitem").select(F.lit("all").alias("project"), at("order", "l_orderkey").alias("src"), at("part", "l_partkey").alias("dst"))
    both = pairs.unionByName(pairs.select("project", F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = table(spark, sf, "orders").where("o_orderkey % 500 = 0").select(F.lit("all").alias("project"), F.col("o_orderkey").alias("seed"), at("order", "o_orderkey").alias("node"))
    return reach.reach(both, seeds, 2).groupBy("seed", "depth").agg(F.count("*").alias("nodes"))


@query("changes_by_tree", f"""WITH {DOCS}, old AS (SELECT project, path, CASE WHEN doc_id % 7 = 1 THEN concat(content, '!') ELSE content END AS content FROM docs WHERE doc_id % 11 <> 2),
 new AS (SELECT project, path, content FROM docs WHERE doc_id % 13 <> 3)
 SELECT project, path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'changed' END AS change, left(sha256(coalesce(new.content, old.content)), 16) AS hash
 FROM new FULL JOIN old USING (project, path) WHERE old.path IS NULL OR new.path IS NULL OR new.content <> old.content""")
def _(spark, sf):
    """Two snapshots made of all documents: some texts differ, some are missing on either side."""
    files = document_files(spark, sf).withColumn("n", F.regexp_extract("path", r"doc_([0-9]+)", 1).cast("long"))
    old = files.where("n % 11 <> 2").withColumn("content", F.when(F.col("n") % 7 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    now, last = (hash_tree.tree_entries(f) for f in (files.where("n % 13 <> 3"), old))
    return hash_tree.changes((hash_tree.hash_tree(now), now), (hash_tree.hash_tree(last), last))
