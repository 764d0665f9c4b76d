"""Streams over the given tables, checked against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import DOC_RULES, DOCS, FINDINGS, document_files
from bindings.prep_queries import ORACLES as PREP_SQL
from riskloom.functions import texts
from riskloom.plans.audit import audit
from riskloom.sources.corpus import read_corpus_table
from riskloom.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def _stream(spark, sf, name):
    return jobs.stream_table(spark, sf, f"{name}.parquet")


def _files(spark, sf):
    return read_corpus_table(_stream(spark, sf, "documents"), {
        "project": "source", "path": "concat(source, '/', lang, '/doc_', doc_id, '.txt')", "content": "text"})


def _log(spark, sf):
    return _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("key"),
                                               (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration"))


@query("stream_scan", f"WITH {FINDINGS} SELECT file, line, rule_id, severity FROM f")
def _(spark, sf):
    return jobs.run_to_table(jobs.stream_scan(_files(spark, sf), DOC_RULES)).select("file", "line", "rule_id", "severity")


@query("stream_changed", "SELECT DISTINCT concat('u', user_id) AS path, left(sha256(event_type), 16) AS hash FROM events")
def _(spark, sf):
    e = _stream(spark, sf, "events").select(F.lit("p").alias("project"), F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("content"),
                                            F.col("ts").cast("timestamp").alias("modified"))
    return jobs.run_to_table(jobs.stream_changed(e)).select("path", "hash")


@query("stream_failure_rate", """WITH e AS (SELECT ts, user_id % 5 AS key, event_type <> 'error' AS ok, unnest(generate_series(0, 2)) AS k FROM events),
 w AS (SELECT key, time_bucket(INTERVAL 20 MINUTES, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 20 MINUTES AS window_start, ok FROM e),
 g AS (SELECT key, window_start, count(*) AS calls, count(*) FILTER (NOT ok) AS failures FROM w GROUP BY ALL)
 SELECT key, CAST(epoch(window_start) AS BIGINT) AS window_start, calls, failures, round(failures / calls, 6) AS failure_rate, calls >= 3 AND failures / calls >= 5e-1 AS alarm FROM g""")
def _(spark, sf):
    s = jobs.stream_failure_rate(_log(spark, sf), "60 minutes", "20 minutes", "1 hour", min_calls=3)
    out = jobs.run_to_table(s, "complete")
    return out.select("key", F.unix_seconds("window_start").alias("window_start"), "calls", "failures", F.round("failure_rate", 6).alias("failure_rate"), "alarm")


@query("stream_metrics", """SELECT user_id % 5 AS key, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS window_start, count(*) AS n, round(sum(value), 4) AS total_duration, count(*) FILTER (event_type <> 'error') AS successful FROM events GROUP BY ALL""")
def _(spark, sf):
    out = jobs.run_to_table(jobs.stream_metrics(_log(spark, sf), "1 hour", "1 hour"), "complete")
    return out.select("key", F.unix_seconds("window_start").alias("window_start"), "n", F.round("total_duration", 4).alias("total_duration"), "successful")


@query("stream_token_rounds", PREP_SQL["token_rounds"])
def _(spark, sf):
    r = _stream(spark, sf, "conversations").select("conv_id", "turn", texts.estimate_tokens(F.col("text")).alias("input_tokens"), F.floor(F.length("text") / 10).alias("output_tokens"))
    return jobs.run_to_table(jobs.stream_token_rounds(r, 400, ttl=None))


@query("stream_finding_counts", f"WITH {FINDINGS} SELECT project, severity, count(*) AS n FROM f GROUP BY ALL")
def _(spark, sf):
    folder = jobs.work_folder(spark)
    q = jobs.stream_finding_counts(jobs.stream_scan(_files(spark, sf), DOC_RULES), f"{folder}/counts", f"{folder}/checkpoint")
    q.awaitTermination()
    return jobs.running_counts(spark, f"{folder}/counts").drop("last_batch")


def audit_documents(spark, sf):
    return audit(document_files(spark, sf), DOC_RULES).scores()


AUDIT_MATCHES = """h AS (SELECT DISTINCT project, file, line, vuln_type, rule_id, severity FROM f)"""


@query("audit_scores", f"""WITH {FINDINGS}, b AS (SELECT project, lower(regexp_replace(file, '^.*/', '')) AS bn, vuln_type, line // 5 AS bucket, file, line, min((rule_id)) AS rule_id FROM f GROUP BY ALL),
 first AS (SELECT *, row_number() OVER (PARTITION BY project, bn, vuln_type, bucket ORDER BY line) AS rn FROM b),
 c0 AS (SELECT project, CASE vuln_type WHEN 'HARD_CODE_SECRET' THEN 'critical' WHEN 'CREDENTIAL_EXPOSURE' THEN 'high' WHEN 'PERSONAL_INFO_EXPOSURE' THEN 'medium' WHEN 'INFO_LEAK' THEN 'low' ELSE 'info' END AS severity FROM first WHERE rn = 1),
 c AS (SELECT d.project, count(severity) FILTER (severity = 'critical') AS blocker, count(severity) FILTER (severity = 'high') AS major, count(severity) FILTER (severity = 'medium') AS minor, count(severity) FILTER (severity NOT IN ('critical', 'high', 'medium')) AS info, count(severity) AS findings_count
   FROM (SELECT DISTINCT project FROM docs) d LEFT JOIN c0 ON c0.project = d.project GROUP BY d.project)
 SELECT project, blocker, major, minor, info, findings_count, CAST(greatest(0, 100 - blocker * 25 - major * 5 - minor - least(3, greatest(0, info - 5))) AS BIGINT) AS score FROM c""")
def _(spark, sf):
    return audit_documents(spark, sf).select("project", "blocker", "major", "minor", "info", "findings_count", "score")
