"""Flows from inputs to sinks within a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import dims
from riskloom.functions import texts
from riskloom.functions.durable import durable
from riskloom.functions.joins import growing
from riskloom.operators.scan import if_any, scan_rules, with_language
from riskloom.sources.rules import Rule

NAME = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b"

# What a sink category means.
SINK_SEVERITY = {"command_exec": "critical", "code_injection": "critical", "deserialization": "critical", "sql_injection": "high",
                 "xss": "high", "xxe": "high", "ssrf": "high", "file_operation": "medium"}
SINK_CWE = {"sql_injection": "CWE-89", "command_exec": "CWE-78", "xss": "CWE-79", "file_operation": "CWE-22",
            "deserialization": "CWE-502", "ssrf": "CWE-918", "xxe": "CWE-611", "code_injection": "CWE-94"}
SINK_OWASP = {"sql_injection": "A03:2021", "command_exec": "A03:2021", "xss": "A03:2021", "file_operation": "A05:2021",
              "deserialization": "A08:2021", "ssrf": "A01:2021", "xxe": "A03:2021"}
SINK_ADVICE = {"sql_injection": "Use parameterized queries instead of string concatenation",
               "command_exec": "Use APIs with separate arguments or escape user input",
               "xss": "Encode output before rendering or use safe DOM methods",
               "file_operation": "Validate file paths against an allow list",
               "deserialization": "Do not deserialize untrusted data",
               "ssrf": "Restrict URLs to allowed domains", "xxe": "Disable external entities in XML parsers"}


def _sanitized(text: Column, language: Column, rules: list[Rule]) -> Column:
    tests = []
    for lang in sorted({r.language for r in rules}):
        hit = texts.any_match(text, [r.pattern for r in rules if r.language == lang])
        tests.append(hit if lang == "*" else (language == lang) & hit)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def identifiers(files: DataFrame, sources: DataFrame, rules: list[Rule]) -> DataFrame:
    """(project, path, inputs, lines): per file with inputs, the names on each input line (repeats included), and which of those names stand on
    which line, with what that line does to a value. One pass over each text; no text leaves it.

    sources(project, path, line, category). The input lines of a file (numbers) meet its text as one row.
    """
    marks = sources.groupBy("project", "path").agg(F.collect_set(F.struct("line", "category")).alias("_marks"))
    f = with_language(files).select("project", "path", "language", "content")
    cleaners = [r for r in rules if r.kind == "sanitizer"]
    df = marks.join(growing(f), ["project", "path"]).select("project", "path", "language", "_marks", if_any(texts.lines_of(F.col("content"))).alias("_lines"))
    named = F.transform("_lines", lambda x: F.struct(x.alias("text"), F.regexp_extract_all(x, F.lit(NAME), F.lit(1)).alias("names")))
    df = df.select("project", "path", "language", "_marks", if_any(named).alias("_named"))
    inputs = F.transform("_marks", lambda m: F.struct(m["line"].alias("source_line"), m["category"].alias("source_category"), F.element_at("_named", m["line"])["names"].alias("names")))
    wanted = F.array_distinct(F.flatten(F.transform("_marks", lambda m: F.element_at("_named", m["line"])["names"])))
    df = df.select("project", "path", "language", inputs.alias("inputs"), wanted.alias("_wanted"), "_named")
    here = F.transform("_named", lambda x, i: F.struct((i + 1).alias("line"), x["text"].alias("text"), F.array_intersect(x["names"], "_wanted").alias("names")))
    df = df.select("project", "path", "language", "inputs", F.filter(here, lambda x: F.size(x["names"]) > 0).alias("_here"))
    lines = F.transform("_here", lambda x: F.struct(
        x["line"].alias("line"), x["names"].alias("names"), _sanitized(x["text"], F.col("language"), cleaners).alias("sanitized"),
        (F.when(x["text"].contains("+") | x["text"].contains("${"), 0.15).otherwise(0.0)
         + F.when(x["text"].contains("(") & x["text"].contains(")"), 0.1).otherwise(0.0)).alias("gain")))
    return df.select("project", "path", "inputs", lines.alias("lines"))


def taint_sources(files: DataFrame, sources: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each input line with the later uses of its names: uses array<struct<line,name,delta,sanitized>>, by line and name.

    A use is a later line on which the whole name stands (`id` is no use in `width`), once per name and line; a name that
    occurs twice on the input line counts twice. A use adds 0.15 for concatenation or interpolation and 0.1 for a call, and takes 0.3
    when the line sanitizes. Names meet by equality, file by file and name by name: the work is linear in identifiers and uses,
    and a large file is spread by its names. Inputs whose names are never used again drop out.
    """
    found = durable(identifiers(files, sources, rules))
    names = found.select("project", "path", F.explode("inputs").alias("i")).select("project", "path", "i.source_line", "i.source_category", F.explode("i.names").alias("name"))
    lines = found.select("project", "path", F.explode("lines").alias("l")).select("project", "path", "l.*")
    uses = lines.select("project", "path", "line", "sanitized", (F.col("gain") - F.when(F.col("sanitized"), 0.3).otherwise(0.0)).alias("delta"), F.explode("names").alias("name"))
    met = names.join(growing(uses), ["project", "path", "name"]).where(F.col("line") > F.col("source_line"))
    df = met.groupBy("project", "path", "source_line", "source_category").agg(F.array_sort(F.collect_list(F.struct("line", "name", "delta", "sanitized"))).alias("uses"))
    return df.withColumn("first_use", F.array_min(F.transform("uses", lambda u: u["line"])))


def taint_paths(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Input and sink lines of one file, the sink at or after the first use of a name from the input line.

    One row per (input line, sink line) and categories. A file's sinks are one row that its inputs look into, so a file with very many
    inputs can be split over tasks.
    """
    found = scan_rules(files, [r for r in rules if r.kind in ("source", "sink")])
    sources = taint_sources(files, found.where("kind = 'source'"), rules)
    sinks = found.where("kind = 'sink'").groupBy("project", "path").agg(F.collect_set(F.struct(F.col("line").alias("sink_line"), F.col("category").alias("sink_category"))).alias("_sinks"))
    reached = F.filter("_sinks", lambda s: (s["sink_line"] > F.col("source_line")) & (s["sink_line"] >= F.col("first_use")))
    pairs = sources.join(growing(sinks), ["project", "path"]).withColumn("_s", F.explode(reached)).select("*", "_s.*")
    steps = F.filter("uses", lambda u: u["line"] <= F.col("sink_line"))
    df = pairs.withColumn("_steps", steps)
    confidence = F.lit(0.7) + F.aggregate("_steps", F.lit(0.0), lambda a, u: a + u["delta"])
    return df.select("project", F.col("path").alias("file"), "source_line", "source_category", "sink_line", "sink_category",
                     F.array_distinct(F.transform("_steps", lambda u: u["name"])).alias("variables"), F.size("_steps").alias("steps"),
                     F.exists("_steps", lambda u: u["sanitized"]).alias("is_sanitized"),
                     F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"))


def taint_findings(paths_: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Paths as findings: sanitized and weak ones dropped, the rest described by the sink."""
    sink = F.col("sink_category")
    # sums of tenths are compared with a hair of slack
    kept = paths_.where(~F.col("is_sanitized") & (F.col("confidence") >= min_confidence - 1e-9))
    return kept.select(
        "project", F.lit("taint").alias("source"), F.lit("taint-analysis").alias("skill_id"), "file", F.col("sink_line").alias("line"),
        F.concat_ws(":", "file", "sink_line").alias("location"), "source_line", "source_category", "sink_category",
        F.concat_ws("-", F.lit("TAINT"), "source_category", "sink_category", "source_line", "sink_line").alias("rule_id"),
        dims.lookup(dims.TYPE_BY_CATEGORY, sink, "UNKNOWN").alias("vuln_type"), dims.lookup(SINK_SEVERITY, sink, "medium").alias("severity"),
        dims.lookup(SINK_CWE, sink, "").alias("cwe"), dims.lookup(SINK_OWASP, sink, "").alias("owasp"),
        dims.lookup(SINK_ADVICE, sink, "Sanitize user input before using it").alias("remediation"), "confidence",
        F.concat(F.lit("Input at line "), F.col("source_line"), F.lit(" reaches "), sink, F.lit(" at line "), F.col("sink_line")).alias("evidence"),
        F.concat(F.lit("Flow into "), sink).alias("title"))


def taint_summary(paths_: DataFrame, findings: DataFrame) -> DataFrame:
    """Per project: paths, findings, and findings by severity."""
    p = paths_.groupBy("project").agg(F.count("*").alias("paths"))
    f = findings.groupBy("project").agg(F.count("*").alias("findings"), *[
        F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("critical", "high", "medium", "low")])
    return p.join(growing(f), "project", "left").na.fill(0)


def sanitizer_between(pairs: DataFrame, files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Pairs(project, file, source_line, sink_line) with the sanitizer lines in [source, sink)."""
    f = with_language(files)
    lines = texts.lines_of(F.col("content"))
    cleaners = [r for r in rules if r.kind == "sanitizer"]
    marks = f.select("project", F.col("path").alias("file"), F.array_compact(F.transform(
        lines, lambda x, i: F.when(_sanitized(x, F.col("language"), cleaners), i + 1))).alias("_san")).where(F.size("_san") > 0)
    df = pairs.join(growing(marks), ["project", "file"], "left")
    inside = F.filter("_san", lambda n: (n >= F.col("source_line")) & (n < F.col("sink_line")))
    return df.withColumn("sanitizer_lines", F.coalesce(inside, F.array().cast("array<int>"))).drop("_san")
