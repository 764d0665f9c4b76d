"""Pattern scans over whole files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import literals, paths, severity, texts
from riskloom.functions.pieces import map_rows
from riskloom.sources.rules import Rule

MATCH_COLUMNS = ("project string, path string, language string, rule_id string, pattern_ord int, kind string, "
                 "category string, vuln_type string, cwe string, severity string, match string, `offset` int, line int")


def java_pattern(rule_pattern: str) -> str:
    return "(?i)" + rule_pattern


def _applies(rule: Rule, language: Column) -> Column | None:
    return None if rule.language == "*" else language == rule.language


def _hit_indexes(rules: list[Rule], language: Column, content: Column) -> Column:
    """Indexes of the rules that may occur in a text: one pass of an automaton over the strings that the rules' matches must hold.
    Rules that need no string are tried one by one in the JVM, as literal patterns that a task compiles once."""
    needed = [literals.needs(r.pattern) for r in rules]
    tests = []
    for i, rule in enumerate(rules):
        if not needed[i].strings:
            test = content.rlike(java_pattern(rule.pattern))
            guard = _applies(rule, language)
            tests.append(F.when(test if guard is None else guard & test, F.lit(i)))
    tried = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<int>")
    if len(tests) == len(rules):
        return tried
    asked = [(i, n, rules[i].language) for i, n in enumerate(needed) if n.strings]

    @F.arrow_udf("array<int>")
    def held(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        finders: dict = {}
        for languages, texts_ in batches:
            out = []
            for lang, text in ((a.as_py(), b.as_py()) for a, b in zip(languages, texts_)):
                if lang not in finders:
                    finders[lang] = literals.RuleFinder([(i, n) for i, n, of in asked if of in ("*", lang)])
                out.append([] if text is None else list(finders[lang].rules_in(literals.fold(text))))
            yield pa.array(out, pa.list_(pa.int32()))

    return F.concat(held(language, content), tried)


def if_any(items: Column) -> Column:
    """A generator that keeps rows with a non-empty array. Unlike a filter, which would be pushed below the
    projection and work the array out a second time, it evaluates the array once."""
    return F.explode(F.filter(F.array(items), lambda x: F.size(x) > 0))


def with_language(files: DataFrame) -> DataFrame:
    return files if "language" in files.columns else files.withColumn("language", paths.detect_language(F.col("path")))


def scan_rules(files: DataFrame, rules: list[Rule], kind: str | None = None, around: int | None = None, span: int | None = None,
               carry: dict[str, Column] | None = None) -> DataFrame:
    """Every match of every rule of the file's language, with its offset and line.

    No shuffle. One automaton over the strings that the rules' matches must hold says which rules a file may match, whatever the number of
    rules; files without any are dropped, and each pattern is run only around its strings. What later steps need of the text comes along from the same pass, so that no text is joined again: `around` lines on
    both sides (`_around`, the first is line `_from`), `span` characters on both sides (`_near`), and
    measures of the file (`carry`, by name).
    """
    rules = [r for r in rules if kind in (None, r.kind)]
    carry = carry or {}
    kinds = with_language(files).select(*[c.alias(n) for n, c in carry.items()]).schema
    extra = (["_around array<string>", "_from int"] if around is not None else []) + (["_near string"] if span is not None else [])
    schema = ", ".join([MATCH_COLUMNS, *extra, *[f"{f.name} {f.dataType.simpleString()}" for f in kinds]])
    if not rules:
        return files.sparkSession.createDataFrame([], schema)
    hits = with_language(files).select("project", "path", "language", "content",
                                       if_any(_hit_indexes(rules, F.col("language"), F.col("content"))).alias("hits"),
                                       *[c.alias(n) for n, c in carry.items()])
    table = [(r.rule_id, r.pattern_ord, r.kind, r.category, r.vuln_type, r.cwe, r.severity, r.pattern) for r in rules]

    def finder():
        compiled = [re.compile(t[-1], re.IGNORECASE | re.ASCII) for t in table]
        needed = [literals.needs(t[-1]) for t in table]

        def find(project, path, language, content, hit, *measures):
            lines, folded = content.split("\n") if around is not None else [], literals.fold(content)
            for i in sorted(hit):
                t, line, at = table[i], 1, 0
                for m in literals.matches(compiled[i], needed[i], content, folded):
                    if m.end() == m.start():
                        continue
                    line += content.count("\n", at, m.start())
                    at = m.start()
                    row = [project, path, language, t[0], t[1], t[2], t[3], t[4], t[5], t[6], m.group(), at, line]
                    if around is not None:
                        first = max(line - around, 1)
                        row += [lines[first - 1:line + around], first]
                    if span is not None:
                        row.append(content[max(at - span, 0):m.end() + span])
                    yield row + list(measures)

        return find

    return map_rows(hits, finder, schema)


def scan_lines(files: DataFrame, rules: list[Rule], around: int | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """First match of each rule on each line, without leaving the JVM.

    For rules that cannot match across lines. One row per (line, rule). `around` and `carry` bring along what `scan_rules`
    does with them.
    """
    def found(text: Column) -> Column:
        tests = []
        for r in rules:
            test = text.rlike(java_pattern(r.pattern))
            guard = _applies(r, F.col("language"))
            made = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(r.category).alias("category"),
                            F.lit(r.vuln_type).alias("vuln_type"), F.lit(r.cwe).alias("cwe"),
                            F.lit(r.severity).alias("severity"),
                            F.regexp_extract(text, java_pattern(r.pattern), 0).alias("match"))
            tests.append(F.when(test if guard is None else guard & test, made))
        return F.array_compact(F.array(*tests))

    carry = carry or {}
    base, files = ["project", "path", "language"], with_language(files)
    lines = texts.lines_of(F.col("content"))
    if around is None and not carry:
        rows = files.select(*base, F.posexplode(lines).alias("_p", "text"))
        return rows.select(*base, (F.col("_p") + 1).alias("line"), "text", F.explode(found(F.col("text"))).alias("h")).select(
            *base, "line", "text", "h.*")
    rows = files.select(*base, if_any(lines).alias("_lines"), *[c.alias(n) for n, c in carry.items()])
    hits = F.filter(F.transform("_lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), found(x).alias("hits"))),
                    lambda h: F.size(h["hits"]) > 0)
    n = around or 0
    wide = F.transform(hits, lambda h: F.struct(
        h["line"].alias("line"), h["text"].alias("text"), h["hits"].alias("hits"),
        texts.line_window(F.col("_lines"), h["line"], n, n).alias("_around"), F.greatest(h["line"] - n, F.lit(1)).alias("_from")))
    return (rows.select(*base, *carry, F.explode(wide).alias("r")).select(*base, *carry, "r.*")
            .select(*base, "line", "text", "_around", "_from", *carry, F.explode("hits").alias("h"))
            .select(*base, "line", "text", "_around", "_from", *carry, "h.*"))


def rule_text_join(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Line x rule pairs of the same language that match. Rules ride along as literals, not as a join."""
    return scan_lines(files, rules).select("project", "path", "language", "line", "rule_id", "vuln_type", "match")


def scan_profiles(files: DataFrame, rules: list[Rule], span: int = 150) -> DataFrame:
    """Risk-pattern matches with no safe pattern within `span` characters of them."""
    risky = [r for r in rules if r.kind == "profile"]
    guarded = [r for r in risky if r.safe_patterns]
    if not guarded:
        return scan_rules(files, risky)
    near = scan_rules(files, risky, span=span)
    safe = F.lit(False)
    for key in sorted({(r.rule_id, r.language, tuple(r.safe_patterns)) for r in guarded}):
        rule_id, language, pats = key
        hit = (F.col("rule_id") == rule_id) & texts.any_match(F.col("_near"), list(pats))
        safe = safe | (hit if language == "*" else hit & (F.col("language") == language))
    return near.where(~safe).drop("_near")


def line_complexity(line: Column) -> Column:
    operators = F.regexp_count(line, F.lit(r"[+\-*/%=<>!&|]+"))
    parens = F.regexp_count(line, F.lit(r"\("))
    return F.when(line == "", F.lit(0.0)).otherwise(F.least(
        F.lit(1.0), operators * F.lit(0.1) + parens * F.lit(0.1) + F.least(F.length(line) / F.lit(100.0), F.lit(0.5))))


def text_complexity(content: Column) -> Column:
    """Mean line length against 80 and control words per line, averaged."""
    lines = F.filter(F.split(content, "\n", -1), lambda x: F.trim(x) != "")
    n = F.size(lines)
    chars = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    words = F.regexp_count(content, F.lit(r"(?i)\b(function|class|if|else|for|while|switch|case|return)\b"))
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), (chars / n / F.lit(80.0) + words / n) / F.lit(2.0)))


# Words that make a line look like test code.
TEST_LINE = ["test", "spec", "mock", "fixture", "example", "sample", "demo", "stub", "placeholder", "dummy"]


def match_confidence(line: Column, content_complexity: Column, boost: Column | None = None,
                     fp_rate: Column | None = None) -> Column:
    """0.6, adjusted by the line, the file and the rule's false-positive history, within [0, 1]."""
    text = F.trim(line)
    score = F.lit(0.6) + (boost if boost is not None else F.lit(0.0))
    score = score + F.when(F.length(text) > 0, 0.05).otherwise(0.0)
    score = score + F.when(F.length(text) > 50, 0.05).otherwise(0.0)
    score = score + F.when(texts.any_match(text, TEST_LINE), 0.0).otherwise(0.1)
    score = score - F.when(line_complexity(text) > 0.5, 0.1).otherwise(0.0)
    score = score - F.when(content_complexity < 0.3, 0.05).otherwise(0.0)
    if fp_rate is not None:
        score = score * (F.lit(1.0) - F.coalesce(fp_rate, F.lit(0.0)) * F.lit(0.5))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def scan_with_context(files: DataFrame, rules: list[Rule], window: int = 3,
                      fp_rates: DataFrame | None = None) -> DataFrame:
    """Sources and sinks with their surrounding lines and a confidence, to which a rule adds its own `confidence_boost`."""
    boosts = [x for r in rules if r.confidence_boost for x in (F.lit(f"{r.rule_id}\n{r.pattern_ord}"), F.lit(float(r.confidence_boost)))]
    named = F.concat_ws("\n", "rule_id", F.col("pattern_ord").cast("string"))
    boost = F.coalesce(F.try_element_at(F.create_map(*boosts), named), F.lit(0.0)) if boosts else None
    ctx = scan_rules(files, [r for r in rules if r.kind in ("source", "sink")], around=window,
                     carry={"_complexity": text_complexity(F.col("content"))})
    if fp_rates is not None:
        # one row per rule: bounded by the rule set
        ctx = ctx.join(F.broadcast(fp_rates.select("rule_id", "fp_rate")), "rule_id", "left")
    line = F.coalesce(texts.near_line(F.col("line")), F.lit(""))
    return (ctx.withColumn("context", texts.context_lines(F.col("line")))
            .withColumn("confidence", match_confidence(line, F.col("_complexity"), boost,
                                                       fp_rate=F.col("fp_rate") if fp_rates is not None else None))
            .drop("_around", "_from", "_complexity", "fp_rate"))


def search_text(lines: DataFrame, query: str, ignore_case: bool = True, limit: int | None = None) -> DataFrame:
    """Lines holding a literal text; `limit` is the page size of the report, None for all."""
    text = F.lower("line") if ignore_case else F.col("line")
    found = lines.where(text.contains(query.lower() if ignore_case else query)).select(
        "project", "path", "line_no", F.trim("line").alias("content"))
    return found if limit is None else found.orderBy("project", "path", "line_no").limit(limit)


def search_patterns(lines: DataFrame, patterns: list[str], include: list[str] | None = None,
                    exclude: list[str] | None = None) -> DataFrame:
    """Lines matching any of several patterns, in files picked by globs; the first pattern that hit is named."""
    df = lines
    if include:
        df = df.where(reduce(lambda a, b: a | b, [F.col("path").rlike(paths.glob_to_regex(g)) for g in include]))
    if exclude:
        df = df.where(~reduce(lambda a, b: a | b, [F.col("path").rlike(paths.glob_to_regex(g)) for g in exclude]))
    first = F.coalesce(*[F.when(F.col("line").rlike("(?i)" + p), F.lit(p)) for p in patterns])
    return df.withColumn("pattern", first).where(F.col("pattern").isNotNull()).select(
        "project", "path", "line_no", "pattern", F.trim("line").alias("content"))


def project_structure(files: DataFrame, preview: int = 500) -> DataFrame:
    return files.select("project", "path", F.substring("content", 1, preview).alias("preview"),
                        F.size(texts.lines_of(F.col("content"))).alias("line_count"), F.length("content").alias("chars"))


def make_findings(matches: DataFrame, source: str, confidence: float = 0.75, skill_id: str = "rule-scan") -> DataFrame:
    """Raw matches as findings: location, severity name, title, fixed confidence."""
    return matches.select(
        "project", F.lit(source).alias("source"), F.lit(skill_id).alias("skill_id"), "rule_id",
        F.col("path").alias("file"), "line", F.concat_ws(":", "path", "line").alias("location"),
        *(["offset"] if "offset" in matches.columns else []), "language", "vuln_type", "cwe",
        severity.severity_map(F.col("severity")).alias("severity"), F.lit(confidence).alias("confidence"),
        F.concat(F.lit("Possible "), F.col("vuln_type")).alias("title"), "match",
        F.concat(F.lit("Found at "), F.col("path"), F.lit(":"), F.col("line"), F.lit(": "), F.col("match")).alias("evidence"),
        F.lit("open").alias("status"))
