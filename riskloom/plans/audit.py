"""A whole audit as one plan: files and rules in, findings, scores and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskloom.operators import chains, coverage, dedup, merge, risk, scan, scoring, validate
from riskloom.operators.context import guard_context
from riskloom.operators.enrich import enrich_findings
from riskloom.operators.filters import confidence_filter, title_fp_filter
from riskloom.functions.durable import durable
from riskloom.sources.rules import Rule


@dataclass
class Audit:
    """Lazy results of one run; `findings` is the shared input of the others."""

    files: DataFrame
    findings: DataFrame
    merged: DataFrame

    def scores(self, **gate) -> DataFrame:
        return scoring.score_project(self.findings, projects=self.files.select("project").distinct(), **gate)

    def scores_by_source(self) -> DataFrame:
        return scoring.score_by_source(self.findings)

    def chains(self) -> DataFrame:
        return chains.chains(self.findings)

    def coverage(self) -> DataFrame:
        return coverage.coverage_report(self.files, self.findings)

    def risks(self) -> DataFrame:
        return risk.risk_pool(risk.risk_entries(self.findings))

    def verdicts(self) -> DataFrame:
        return validate.verdict_stats(validate.verify_path(self.findings, self.files))


def detect(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Scan findings with snippet, guards and 3D score, de-duplicated."""
    found = scan.scan_rules(files, [r for r in rules if r.kind in ("sink", "profile")])
    # snippets and guards share the one join of findings with texts
    guarded = guard_context(scan.make_findings(found, "quick_scan"), files, snippet=True)
    return dedup.dedup_findings(scoring.cvss_3d(guarded))


def audit(files: DataFrame, rules: list[Rule], detectors: list[DataFrame] | None = None, min_confidence: float = 0.4,
          gbt: dict | None = None, keep: bool = True) -> Audit:
    """Runs the built-in scan, takes the findings of other detectors, merges, enriches and numbers them.

    A detector is any `files -> findings` result: tool reports, reviewer output, component matches.
    The merge keeps the detected findings, so texts are scanned once. With `keep` the numbered findings are checkpointed
    too, since every report reads them.
    """
    both = merge.union_detectors([detect(files, rules), *(detectors or [])])
    kept, merged = merge.cross_source_merge(title_fp_filter(both))
    ranked = dedup.assign_ids(confidence_filter(enrich_findings(kept, gbt), min_confidence))
    return Audit(files, durable(ranked) if keep else ranked, merged)
