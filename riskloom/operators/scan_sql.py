"""Rule scans in SQL: table functions over any table of files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskloom.dims import LANGUAGE_BY_EXTENSION
from riskloom.functions import literals
from riskloom.operators.scan import MATCH_COLUMNS
from riskloom.sources.rules import Rule, usable

#: Matches that leave a task at a time.
OUT_ROWS = 10_000


def language_of(path: str | None) -> str | None:
    """What `detect_language` says of a path."""
    stem, dot, end = (path or "").rsplit("/", 1)[-1].rpartition(".")
    return LANGUAGE_BY_EXTENSION.get(end.lower() if stem and dot else "", "unknown")


class _Scanner:
    """The rules of each language, made ready when a text of that language first comes."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.needed, self.ready = rules, [literals.needs(r.pattern) for r in rules], {}
        self.compiled: dict[int, re.Pattern] = {}

    def candidates(self, language: str | None, folded: str) -> list[int]:
        if language not in self.ready:
            mine = [(i, self.needed[i]) for i, r in enumerate(self.rules) if r.language in ("*", language)]
            self.ready[language] = literals.RuleFinder([x for x in mine if x[1].strings]), [i for i, n in mine if not n.strings]
        finder, always = self.ready[language]
        return sorted([*finder.rules_in(folded), *always])

    def matches(self, project: str | None, path: str | None, language: str | None, text: str) -> Iterator[tuple]:
        folded = literals.fold(text)
        for i in self.candidates(language, folded):
            r, line, at = self.rules[i], 1, 0
            if i not in self.compiled:
                self.compiled[i] = re.compile(r.pattern, re.IGNORECASE | re.ASCII)
            for m in literals.matches(self.compiled[i], self.needed[i], text, folded):
                if m.end() > m.start():
                    line += text.count("\n", at, m.start())
                    at = m.start()
                    yield (project, path, language, r.rule_id, r.pattern_ord, r.kind, r.category, r.vuln_type, r.cwe, r.severity, m.group(), at, line)


def scan_function(rules: list[Rule]):
    """The table function of these rules: `files` has project, path, content and maybe language; other columns are not read."""
    kinds = to_arrow_schema(StructType.fromDDL(MATCH_COLUMNS))

    class Scan:
        def __init__(self):
            self.scanner = _Scanner(rules)

        def eval(self, files: pa.RecordBatch):
            names = files.schema.names
            paths = files.column(names.index("path")).to_pylist()
            languages = files.column(names.index("language")).to_pylist() if "language" in names else map(language_of, paths)
            held: list[tuple] = []
            for project, path, language, text in zip(files.column(names.index("project")).to_pylist(), paths, languages, files.column(names.index("content"))):
                for row in self.scanner.matches(project, path, language, text.as_py() or ""):
                    held.append(row)
                    if len(held) >= OUT_ROWS:
                        yield pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
                        held = []
            if held:
                yield pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)

    return F.arrow_udtf(Scan, returnType=MATCH_COLUMNS)


def register_scan(spark: SparkSession, rules: list[Rule], name: str = "scan_rules", kind: str | None = None) -> list[tuple[str, str, str]]:
    """Makes `SELECT * FROM <name>(TABLE(files))` give what `scan_rules(files, rules, kind)` gives; returns the refused patterns.

    Each partition is scanned where it lies: no shuffle, and a task holds one Arrow batch of files and at most `OUT_ROWS` matches.
    Texts that are null have no matches, no rules give no rows, and repeated files repeat their matches. A later registration under
    the same name takes the place of the earlier one.
    """
    good, refused = usable([r for r in rules if kind in (None, r.kind)])
    spark.udtf.register(name, scan_function(good))
    return refused
