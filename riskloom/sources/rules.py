"""Detection rules: plain data, checked once on the driver, carried to the tasks as literals.

A rule file holds a few hundred patterns at most, so rules are Python records here; the frames
built from them are small by construction.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from riskloom.dims import TYPE_BY_CATEGORY

try:
    import yaml
except ImportError:  # rules may also be written as JSON
    yaml = None

RULE_SCHEMA = ("rule_id string, kind string, language string, name string, category string, vuln_type string, "
               "cwe string, severity string, profiles array<string>, guidelines map<string,array<string>>, "
               "labels array<string>, pattern string, pattern_ord int, description string, "
               "confidence_boost double, safe_patterns array<string>, remediation string")


@dataclass
class Rule:
    """One pattern of one rule. `language` `*` applies to every file."""

    rule_id: str
    pattern: str
    kind: str = "sink"
    language: str = "*"
    name: str = ""
    category: str = ""
    vuln_type: str = ""
    cwe: str = "CWE-NONE"
    severity: str = "medium"
    profiles: list = field(default_factory=list)
    guidelines: dict = field(default_factory=dict)
    labels: list = field(default_factory=list)
    pattern_ord: int = 0
    description: str = ""
    confidence_boost: float = 0.0
    safe_patterns: list = field(default_factory=list)
    remediation: str = ""

    def row(self) -> tuple:
        return (self.rule_id, self.kind, self.language, self.name, self.category, self.vuln_type, self.cwe,
                self.severity, self.profiles, self.guidelines, self.labels, self.pattern, self.pattern_ord,
                self.description, float(self.confidence_boost), self.safe_patterns, self.remediation)


LOOSE_BRACE = re.compile(r"(?<!\\)((?:\\\\)*)((?:\\[^pPxuNk\\])?)\{(?!\d+(?:,\d*)?\})")


def portable(pattern: str) -> str:
    """The pattern with braces that open no repetition escaped: some engines read them as plain text, the JVM refuses them."""
    return LOOSE_BRACE.sub(r"\1\2\\{", pattern)


def problem_with(pattern: str) -> str | None:
    """Why a pattern cannot be used by Python or the JVM (asked while a session runs), or None. Matching empty text is refused too."""
    try:
        compiled = re.compile(pattern, re.IGNORECASE | re.ASCII)
    except re.error as err:
        return f"does not compile: {err}"
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as err:  # the gateway wraps the JVM's PatternSyntaxException
            return f"does not compile in the JVM: {str(err).splitlines()[0]}"
    return "matches empty text" if compiled.match("") else None


def usable(rules: list[Rule]) -> tuple[list[Rule], list[tuple[str, str, str]]]:
    """Rules that can run, and (rule_id, pattern, reason) for those that cannot."""
    good, bad = [], []
    for rule in rules:
        fixed = portable(rule.pattern)
        reason = problem_with(fixed)
        if reason is None:
            good.append(rule if fixed == rule.pattern else replace(rule, pattern=fixed))
        else:
            bad.append((rule.rule_id, rule.pattern, reason))
    return good, bad


def read_rule_file(path: Path):
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    if yaml is None:
        raise RuntimeError("PyYAML is needed to read YAML rules; write them as JSON instead")
    return yaml.safe_load(text)


def _files(directory: Path) -> list[Path]:
    if not directory.is_dir():
        return []
    return sorted(p for p in directory.iterdir() if p.suffix in (".yaml", ".yml", ".json"))


def resolve_type(entry: dict) -> str:
    return (entry.get("_vulnType") or TYPE_BY_CATEGORY.get(entry.get("category") or "")
            or entry.get("name") or entry.get("category") or "UNKNOWN")


def resolve_cwe(entry: dict) -> str:
    if entry.get("_cwe"):
        return entry["_cwe"]
    listed = (entry.get("guidelines") or {}).get("cwe") or []
    if not listed:
        return "CWE-NONE"
    first = str(listed[0])
    return first if first.startswith("CWE-") else f"CWE-{first}"


def read_rules(directory: str) -> list[Rule]:
    """Every pattern below `rules/` (sources, sinks, sanitizers) and `vuln-profiles/` (risk patterns)."""
    root, out = Path(directory), []
    for path in _files(root / "rules"):
        data = read_rule_file(path) or {}
        lang, kinds = data.get("language"), data.get("taintTracking") or {}
        for kind in ("sources", "sinks", "sanitizers"):
            for n, entry in enumerate(kinds.get(kind) or []):
                guide = {k: [str(x) for x in v] for k, v in (entry.get("guidelines") or {}).items()}
                for i, pattern in enumerate(entry.get("patterns") or []):
                    out.append(Rule(
                        rule_id=str(entry.get("id") or f"{lang}-{kind}-{n:03d}"), pattern=str(pattern),
                        kind=kind[:-1], language=lang, name=str(entry.get("name") or ""),
                        category=str(entry.get("category") or ""), vuln_type=resolve_type(entry),
                        cwe=resolve_cwe(entry), severity=str(entry.get("severity") or "medium").lower(),
                        profiles=[str(p) for p in entry.get("profiles") or []], guidelines=guide,
                        labels=[str(x) for x in entry.get("labels") or []], pattern_ord=i,
                        description=str(entry.get("description") or ""),
                        confidence_boost=float(entry.get("confidenceBoost") or 0)))
    for folder, key in (("vuln-profiles", "riskPatterns"),):
        for path in _files(root / folder):
            for rule_id, rule in (read_rule_file(path) or {}).items():
                if not isinstance(rule, dict):
                    continue
                for lang, part in (rule.get("languages") or {}).items():
                    safe = [s if isinstance(s, str) else s.get("pattern") for s in part.get("safePatterns") or []]
                    safe = [portable(s) for s in safe if s and problem_with(portable(s)) is None]
                    for i, risk in enumerate(part.get(key) or []):
                        risk = {"pattern": risk} if isinstance(risk, str) else risk
                        out.append(Rule(
                            rule_id=rule_id, pattern=str(risk.get("pattern")), kind="profile", language=lang,
                            name=rule_id, vuln_type=rule_id.upper(), cwe=str(rule.get("cwe") or "CWE-NONE"),
                            severity=str(part.get("severity") or rule.get("severity") or "medium").lower(),
                            pattern_ord=i, description=str(rule.get("description") or risk.get("description") or ""),
                            confidence_boost=float(risk.get("confidenceBoost") or 0), safe_patterns=safe,
                            remediation=str(part.get("remediation") or rule.get("remediation") or "")))
    return out


def read_frameworks(directory: str) -> list[dict]:
    """Framework rules: name, indicators, and the patterns that matter once the framework is present."""
    out = []
    for path in _files(Path(directory) / "framework-rules"):
        for name, rule in (read_rule_file(path) or {}).items():
            out.append({"framework": name, **rule})
    return out


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([r.row() for r in rules], RULE_SCHEMA)


def load_rules(spark: SparkSession, directory: str, extra: list[Rule] | None = None) -> tuple[list[Rule], DataFrame]:
    """(usable rules, frame of refused patterns with the reason)."""
    good, bad = usable(read_rules(directory) + list(extra or []))
    return good, spark.createDataFrame(bad, "rule_id string, pattern string, reason string")


def read_sanitizers(path: str) -> dict[str, list[str]]:
    """group -> patterns, for the checks around a finding."""
    groups = (read_rule_file(Path(path)) or {}).get("sanitizer_patterns") or {}
    return {g: [portable(p) for e in entries for p in e.get("patterns") or [] if problem_with(portable(p)) is None]
            for g, entries in groups.items()}


def load_sanitizers(spark: SparkSession, path: str) -> DataFrame:
    rows = [(g, p) for g, pats in read_sanitizers(path).items() for p in pats]
    return spark.createDataFrame(rows, "group string, pattern string")


def load_gbt(path: str) -> dict:
    """type -> language -> clause, from a mapping file; give it to `load_dimensions`."""
    return {t: {k: str(v).strip() for k, v in m.items()}
            for t, m in ((read_rule_file(Path(path)) or {}).get("gbtMappings") or {}).items()}


def load_language_adapters(spark: SparkSession, directory: str) -> DataFrame:
    """Control / dangerous / route patterns per language, one row per leaf."""
    rows = []

    def walk(language, section, trail, node):
        if isinstance(node, dict):
            for key, value in node.items():
                walk(language, section, trail + [str(key)], value)
        elif isinstance(node, list):
            for i, value in enumerate(node):
                walk(language, section, trail, value) if isinstance(value, (dict, list)) else rows.append(
                    (language, section, ".".join(trail), i, str(value)))
        elif node is not None:
            rows.append((language, section, ".".join(trail), 0, str(node)))

    for path in _files(Path(directory)):
        for section, node in (read_rule_file(path) or {}).items():
            if section != "version":
                walk(path.stem, section, [], node)
    return spark.createDataFrame(rows, "language string, section string, topic string, ord int, pattern string")
