"""Findings checked against the source they name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskloom import dims
from riskloom.functions import paths, severity, texts
from riskloom.functions.joins import growing
from riskloom.functions.severity import round_half_up
from riskloom.operators.context import with_source_lines, with_windows
from riskloom.operators.filters import type_supported

SEARCH_RANGE = 10


def validate_snippet(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Is the quoted code where the finding says it is?

    validation: `valid`, `corrected` (line moved to the first line holding the code) or
    `hallucination` (unknown file). note tells why a finding was kept without a check.
    """
    df = with_source_lines(findings, files)
    n = F.size("_lines")
    inside = F.col("_line").between(1, n)
    snippet = F.col("snippet") if "snippet" in findings.columns else F.lit(None).cast("string")
    df = df.withColumn("_snip", F.coalesce(F.nullif(snippet, F.lit("")), F.when(inside, F.try_element_at("_lines", F.greatest(F.col("_line"), F.lit(1))))))
    words = F.filter(F.transform(F.split(F.coalesce("_snip", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 3)
    df = df.withColumn("_words", words)
    first_word = F.lower(F.try_element_at("_words", F.lit(1)))
    df = df.withColumn("_hits", F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.lower(
        F.coalesce(F.try_element_at("_lines", i), F.lit(""))).contains(first_word)))

    def holds(i):
        return F.exists("_words", lambda w: F.coalesce(F.try_element_at("_lines", i), F.lit("")).contains(w))

    near = F.try_element_at(F.filter(F.sequence(F.greatest(F.col("_line") - SEARCH_RANGE, F.lit(1)),
                                                F.greatest(F.least(F.col("_line") + SEARCH_RANGE, n), F.lit(1))), holds), F.lit(1))
    missing = F.col("_lines").isNull()
    no_code = F.coalesce("_snip", F.lit("")) == ""
    first_hit = F.try_element_at("_hits", F.lit(1))
    unchecked = ~type_supported(F.col("vuln_type"), paths.detect_language(F.col("_file")))
    # the steps of the check in order; each yields the line it settles on
    found = (F.when(F.array_contains("_hits", F.col("_line")), F.col("_line")).when(first_hit.isNotNull(), first_hit)
             .when(inside & holds(F.greatest(F.col("_line"), F.lit(1))), F.col("_line")).otherwise(near))
    usable = ~missing & ~no_code & (F.size("_words") > 0) & (F.col("_line") == 0) | (~missing & ~no_code & (F.size("_words") > 0) & inside & ~unchecked)
    df = df.withColumn("_found", F.when(usable, F.when(F.col("_line") == 0, first_hit).otherwise(found)))
    moved = F.col("_found").isNotNull() & (F.col("_found") != F.col("_line"))
    note = (F.when(missing, "file not found").when(no_code, "code_not_available")
            .when((F.col("_line") == 0) & F.col("_found").isNull(), "no_line_found").when(unchecked, "type_not_listed_for_language")
            .when(F.col("_found").isNull(), "code_snippet_unverified"))
    return (df.withColumn("validation", F.when(missing, "hallucination").when(moved, "corrected").otherwise("valid"))
            .withColumn("note", note).withColumn("corrected_from", F.when(moved, F.col("_line")))
            .withColumn("line", F.when(moved, F.col("_found")).otherwise(F.col("_line")))
            .withColumn("location", F.when(moved, F.concat_ws(":", "_file", "_found")).otherwise(F.col("location")))
            .withColumn("validated_code", F.trim(F.try_element_at("_lines", F.col("_found"))))
            .drop("_file", "_line", "_lines", "_snip", "_words", "_hits", "_found"))


# What marks an input and a dangerous call near a finding.
SOURCE_MARKS = ["@RequestParam", "@PathVariable", "@RequestBody", "@RequestHeader", r"req\.", r"request\.", r"params\.", r"query\.",
                r"body\.", "getParameter", "getInputStream", "readLine", "getQuery", "getBody", "payload", "input", "data"]
SINK_MARKS = [r"exec\s*\(", r"eval\s*\(", r"Runtime\s*\.\s*getRuntime", "ProcessBuilder", r"executeQuery\s*\(", r"createQuery\s*\(",
              "createNativeQuery", r"setHeader\s*\(", r"sendRedirect\s*\(", r"forward\s*\(", r"File\s*\(", "FileInputStream",
              "FileOutputStream", r"cipher\.doFinal", "getInstance.*MD5|SHA1|DES", r"Random\s*\(", r"SecureRandom\s*\(", r"session\.put",
              r"Cookie\s*\("]
# A small built-in set; load_sanitizers reads a fuller one.
SANITIZERS = {
    "sql": ["PreparedStatement", "prepareStatement", r"JdbcTemplate\.", "NamedParameterJdbcTemplate", "@Param", "setString"],
    "xss": ["escapeHtml", "htmlspecialchars", "DOMPurify", "encodeForHTML", "textContent"],
    "path": ["getCanonicalPath", "realpath", r"normalize\s*\(", r"basename\s*\("],
    "cmd": ["escapeshellarg", "escapeshellcmd", r"shlex\.quote"], "general": [r"validate\w*\s*\(", r"sanitize\w*\s*\(", "intval"],
}


def reachability_score(df: DataFrame) -> Column:
    """3 internet, 2 intranet, 1 signed in, 0 administrator; by type when no access path is given."""
    path = F.coalesce(*[F.col(c).cast("string") for c in ("access_path",) if c in df.columns], F.lit("unknown"))
    t = F.upper(F.coalesce("vuln_type", F.lit("")))
    return (F.when(path.contains("internet") | path.contains("public"), 3).when(path.contains("intranet") | path.contains("internal"), 2)
            .when(path.contains("auth") | path.contains("login"), 1).when(path.contains("admin") | path.contains("privileged"), 0)
            .when(t.contains("SSRF") | t.contains("XSS") | t.contains("OPEN_REDIRECT"), 3)
            .when(t.contains("AUTH_BYPASS") | t.contains("IDOR"), 2).otherwise(1))


def impact_score() -> Column:
    t = F.upper(F.coalesce("vuln_type", F.lit("")))
    return (F.when(t.contains("COMMAND_INJECTION") | t.contains("CODE_INJECTION") | t.contains("DESERIALIZATION"), 3)
            .when(t.contains("SQL_INJECTION") | t.contains("PATH_TRAVERSAL"), 2)
            .when(t.contains("XSS") | t.contains("INFO_LEAK") | t.contains("HARD_CODE_PASSWORD"), 1).otherwise(0))


def complexity_score() -> Column:
    t = F.upper(F.coalesce("vuln_type", F.lit("")))
    return (F.when(t.contains("SQL_INJECTION") | t.contains("COMMAND_INJECTION") | t.contains("PATH_TRAVERSAL"), 3)
            .when(t.contains("XSS") | t.contains("OPEN_REDIRECT"), 2).when(t.contains("CSRF") | t.contains("IDOR"), 1).otherwise(0))


def verify_path(findings: DataFrame, files: DataFrame, sanitizers: dict[str, list[str]] | None = None, strict: bool = False) -> DataFrame:
    """verdict, adjusted_severity, sanitizers found, and an overall score.

    needs_review when the file is unknown, downgraded when a sanitizer is within 30 lines, else
    confirmed. With `strict`, a finding with neither an input within 100 lines nor a dangerous call
    within 50 is a false positive.
    """
    sanitizers = SANITIZERS if sanitizers is None else sanitizers
    df = with_windows(findings, files, 100)

    def near(n):
        return texts.near_text(F.col("_at"), n, n)

    t = F.upper(F.coalesce("vuln_type", F.lit("")))
    group = (F.when(t.contains("SQL"), "sql").when(t.contains("XSS"), "xss").when(t.contains("COMMAND") | t.contains("CMD"), "cmd")
             .when(t.contains("PATH") | t.contains("TRAVERSAL"), "path"))
    df = df.withColumn("_near", near(30)).withColumn("_group", group)
    tests = []
    for name, pats in sanitizers.items():
        for p in pats:
            hit = F.col("_near").rlike(p)
            tests.append(F.when(hit if name == "general" else (F.col("_group") == name) & hit, F.lit(p.replace("\\", "").replace("/", ""))))
    found = F.array_distinct(F.array_compact(F.array(*tests))) if tests else F.array().cast("array<string>")
    known = F.col("_around").isNotNull()
    df = df.withColumn("sanitizers", F.when(known, found).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("source_found", known & texts.any_match(near(100), SOURCE_MARKS, False)).withColumn(
        "sink_found", known & texts.any_match(near(50), SINK_MARKS, False))
    verdict = F.when(~known, "needs_review")
    if strict:
        verdict = verdict.when(~F.col("source_found") | ~F.col("sink_found"), "false_positive")
    verdict = verdict.when(F.size("sanitizers") > 0, "downgraded").otherwise("confirmed")
    score = round_half_up(reachability_score(findings) * 40 / 3.0 + impact_score() * 35 / 3.0 + complexity_score() * 25 / 3.0)
    return (df.withColumn("verdict", verdict).withColumn("adjusted_severity", F.when(F.col("verdict") == "downgraded", severity.downgrade(F.col("severity"))))
            .withColumn("overall_score", F.when(known, score).otherwise(0)).drop("_file", "_line", "_at", "_around", "_from", "_near", "_group"))


def first_lines(files: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(project, file, word) -> (project, file, word, n_lines, at): the first line of the file that holds the word, null if none does.

    The distinct words asked of a file are gathered first, so that each text meets one row; one automaton over them passes the lower-case
    text once, and only positions come back. Words are matched as they are given (lower-case ones find anything); null words have no line, the
    empty word stands in line 1. Files nobody asks about are not read by Python; unknown files and null texts give no row.
    """
    words = asked.groupBy("project", "file").agg(F.collect_set(F.struct("word")).alias("words"))
    whole = files.where(F.col("content").isNotNull()).select("project", F.col("path").alias("file"), F.lower("content").alias("text")).join(growing(words), ["project", "file"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        for batch in batches:
            rows = []
            for project, file, text, structs in batch.itertuples(index=False, name=None):
                wanted = [s["word"] for s in structs]
                ends = np.array([m.start() for m in re.finditer("\n", text)] + [len(text)])
                first = {"": 0} if "" in wanted else {}
                auto = ahocorasick.Automaton()
                for w in wanted:
                    if w and "\n" not in w:
                        auto.add_word(w, w)
                left = len(auto)
                if left:
                    auto.make_automaton()
                    for end, w in auto.iter(text):
                        if w not in first:
                            first[w] = end
                            left -= 1
                            if not left:
                                break
                rows += [(project, file, w, len(ends), int(np.searchsorted(ends, first[w])) + 1 if w in first else None) for w in wanted]
            out = pd.DataFrame(rows, columns=["project", "file", "word", "n_lines", "at"])
            yield out.astype({"at": "Int32"})

    return whole.select("project", "file", "text", "words").mapInPandas(find, "project string, file string, word string, n_lines int, at int")


def verify_chain(chain: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes(project, file, line, method) of call chains: does the line, or else the method, exist?

    Nodes keep all their columns; no row holds a text beside a node. Nodes of unknown files and nodes without line and method are not verified.
    """
    nodes = chain.withColumn("_word", F.lower("method"))
    found = first_lines(files, nodes.select("project", "file", F.col("_word").alias("word"))).select(
        F.col("project").alias("_project"), F.col("file").alias("_file"), F.col("word").alias("_asked"), F.col("n_lines").alias("_n"), F.col("at").alias("_at"))
    met = nodes.join(growing(found), (F.col("project") == F.col("_project")) & (F.col("file") == F.col("_file")) & F.col("_word").eqNullSafe(F.col("_asked")), "left")
    at = F.when(F.col("line").between(1, F.col("_n")), F.col("line")).otherwise(F.col("_at"))
    return met.withColumn("verified_line", F.when(F.col("_n").isNotNull(), at)).withColumn(
        "verified", F.col("verified_line").isNotNull()).drop("_word", "_project", "_file", "_asked", "_n", "_at")


def missing_evidence(findings: DataFrame) -> DataFrame:
    """Evidence the sink asks for and the finding lacks; completeness COMPLETE or PARTIAL, N/A without requirements."""
    dim = F.broadcast(dims.sink_dim(findings.sparkSession).select("vuln_type", "required_evidence"))
    df = findings.join(dim, "vuln_type", "left")
    none = F.array().cast("array<string>")
    df = df.withColumn("missing_evidence", F.array_except(F.coalesce("required_evidence", none), F.coalesce("evidence_points", none)))
    return df.withColumn("completeness", F.when(F.size(F.coalesce("required_evidence", none)) == 0, "N/A")
                         .when(F.size("missing_evidence") > 0, "PARTIAL").otherwise("COMPLETE"))


def verdict_stats(findings: DataFrame) -> DataFrame:
    """Per project: verdicts, hallucinations and corrected lines."""
    def count(col, value):
        return F.count(F.when(F.col(col) == value, 1)) if col in findings.columns else F.lit(0).cast("long")

    return findings.groupBy("project").agg(
        F.count("*").alias("total"), *[count("verdict", v).alias(v) for v in ("confirmed", "false_positive", "downgraded", "needs_review")],
        count("validation", "hallucination").alias("hallucinations"), count("validation", "corrected").alias("corrected"))
