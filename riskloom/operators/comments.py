"""Comments in source files and the findings they suppress."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom.operators.dedup import file_of, line_of
from riskloom.operators.scan import with_language

# Comment markers per language, and suppression tags.
SINGLE = {**dict.fromkeys(["javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust"], "//"),
          **dict.fromkeys(["python", "ruby", "php", "shell", "yaml", "yml"], "#"), "xml": "<!--", "html": "<!--", "sql": "--"}
MULTI = {**dict.fromkeys(["javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust"], ("/*", "*/")),
         "xml": ("<!--", "-->"), "html": ("<!--", "-->")}
SUPPRESSIONS = [r"gbt:\s*disable\s+([\w\-]+)", r"gbt-disable:\s*([\w\-]+)", r"gbt:\s*ignore\s+([\w\-]+)", r"ignore:\s*([\w\-]+)",
                r"eslint-disable-next-line\s+([\w\-]+)", r"eslint-disable-line\s+([\w\-]+)", r"tslint:disable-next-line\s+([\w\-]+)",
                r"tslint:disable\s+([\w\-]+)", r"pylint:\s*disable\s*=\s*([\w\-]+)", r"noinspection\s+([\w\-]+)"]
COMMENT_SCHEMA = ("project string, path string, kind string, start_line int, end_line int, content string, "
                  "suppressions array<string>, unclosed boolean")


def parse_comments(files: DataFrame) -> DataFrame:
    """comments(project, path, kind, start_line, end_line, content, suppressions, unclosed).

    One pass over the lines of a file with an open/closed state; files are independent, so nothing is
    shuffled. A marker inside a string literal counts as a marker.
    """
    tags = SUPPRESSIONS

    def parse(batches):
        patterns = [re.compile(t, re.IGNORECASE) for t in tags]

        def rules_in(text):
            found = (p.search(text) for p in patterns)
            return [m.group(1).upper() for m in found if m]

        for batch in batches:
            rows = []
            for project, path, language, content in batch.itertuples(index=False):
                mark, pair = SINGLE.get(language, "//"), MULTI.get(language)
                block, start, last = None, 0, 0
                for last, text in enumerate(content.split("\n"), 1):
                    if pair and block is None and pair[0] in text:
                        block, start = [], last
                    if block is not None:
                        block.append(text)
                        if pair[1] in text:
                            whole = "\n".join(block)
                            rows.append((project, path, "multi", start, last, whole, rules_in(whole), False))
                            block = None
                    if block is None and mark in text:
                        body = text.split(mark, 1)[1]
                        rows.append((project, path, "single", last, last, body.strip(), rules_in(body), False))
                if block is not None:
                    rows.append((project, path, "multi", start, last, "\n".join(block), [], True))
            yield pd.DataFrame(rows, columns=["project", "path", "kind", "start_line", "end_line", "content", "suppressions", "unclosed"])

    marked = with_language(files).select("project", "path", "language", "content").where(
        F.col("content").rlike(r"//|#|<!--|--|/\*"))
    return marked.mapInPandas(parse, COMMENT_SCHEMA)


def comment_ranges(comments: DataFrame) -> DataFrame:
    return comments.select("project", "path", "kind", "start_line", "end_line", "suppressions").orderBy("project", "path", "start_line")


def suppressed_rules(comments: DataFrame) -> DataFrame:
    """The distinct suppressed rules per file."""
    return comments.select("project", "path", F.explode("suppressions").alias("rule")).distinct()


def suppress_findings(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """Findings with `suppressed`: a tag on the line decides, else the block comment around the line.

    A tag covers its own rule, ALL, or anything when it holds a star.
    """
    keyed = findings.withColumn("_path", file_of(findings)).withColumn("_line", F.greatest(line_of(findings), F.lit(1)))
    tagged = comments.where((F.size("suppressions") > 0) | (F.col("kind") == "multi"))
    per_file = tagged.groupBy("project", F.col("path").alias("_path")).agg(F.collect_list(
        F.struct("kind", "start_line", "end_line", "suppressions")).alias("_c"))
    df = keyed.join(per_file, ["project", "_path"], "left")
    line = F.col("_line")
    single = F.try_element_at(F.filter("_c", lambda c: (c["kind"] == "single") & (c["start_line"] == line)), F.lit(1))
    multi = F.try_element_at(F.filter("_c", lambda c: (c["kind"] == "multi") & line.between(c["start_line"], c["end_line"])), F.lit(1))
    rules = F.coalesce(single["suppressions"], multi["suppressions"])
    rule = F.upper(F.coalesce("vuln_type", F.lit("")))
    hit = F.exists(rules, lambda r: (r == rule) | (r == "ALL") | r.contains("*"))
    return df.withColumn("suppressed", F.coalesce(hit, F.lit(False))).drop("_path", "_line", "_c")
