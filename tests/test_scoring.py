import pytest
from pyspark.sql import functions as F

from riskloom.functions import severity
from riskloom.operators import filters, scoring

SEV = "project string, severity string"


def score(spark, levels, **gate):
    rows = [("p", s) for s in levels]
    projects = spark.createDataFrame([("p",)], "project string")
    return scoring.score_project(spark.createDataFrame(rows, SEV), projects=projects, **gate).collect()[0]


@pytest.mark.parametrize("levels,value,rating,passed", [
    ([], 100, "A", True), (["critical"], 75, "B", False), (["critical"] * 2, 50, "C", False), (["high"], 95, "A", True),
    (["critical", "high", "high"], 65, "C", False), (["critical"] * 5, 0, "D", False), (["critical"] * 3, 25, "D", False),
    (["critical"] * 4, 0, "D", False), (["bogus", "", None], 100, "A", True)])
def test_score(spark, levels, value, rating, passed):
    r = score(spark, levels)
    assert (r.score, r.rating, r.gate_passed, r.findings_count) == (value, rating, passed, len(levels))


@pytest.mark.parametrize("label,level", [("critical", "blocker"), ("high", "major"), ("medium", "minor"), ("bogus", "info"), ("", "info"),
                                         (None, "info"), ("严重", "blocker"), ("Major", "major")])
def test_levels(spark, label, level):
    df = spark.createDataFrame([(label,)], "s string")
    assert df.select(severity.severity_level(F.col("s"))).first()[0] == level


def test_info_penalty_is_bounded(spark):
    assert score(spark, ["info"] * 5).score == 100
    assert score(spark, ["info"] * 7).score == 98
    assert score(spark, ["info"] * 50).score == 97


def test_gate_reasons(spark):
    r = score(spark, ["critical"] + ["high"] * 4)
    assert r.gate_reasons == ["blocker:1>0", "major:4>3", "score:55<70"]


def test_score_by_source(spark):
    rows = [("p", "critical", "heuristic"), ("p", "high", "llm"), ("p", "medium", "react")]
    out = {r.source_group: r.findings_count for r in scoring.score_by_source(spark.createDataFrame(rows, SEV + ", source string")).collect()}
    assert out == {"overall": 3, "scan": 1, "model": 1, "agent": 1}


CAND = "severity string, vuln_type string, evidence string, language string, location string"


def candidates(spark, rows, mode="strict"):
    return filters.candidate_filter(spark.createDataFrame(rows, CAND), mode).collect()


def test_candidate_scores(spark):
    hi, lo = candidates(spark, [("high", "SQL_INJECTION", None, None, None), ("low", "SQL_INJECTION", None, None, None)])
    assert hi.audit_score > lo.audit_score
    text = 'db.query("SELECT * FROM users WHERE id = " + req.query.id)'
    with_, without = candidates(spark, [("high", None, text, "javascript", None), ("high", None, None, "javascript", None)])
    assert with_.audit_score > without.audit_score


def test_candidate_lenient(spark):
    rows = [("critical", None, "Runtime.exec(cmd)", "java", None), ("low", None, None, "python", None),
            ("critical", None, "Runtime.getRuntime().exec('rm -rf /')", "java", "/api/admin/exec")]
    out = candidates(spark, rows, "lenient")
    assert len(out) == 3 and out[2].passed and out[2].audit_priority == "high"
    assert candidates(spark, [], "lenient") == []


@pytest.mark.parametrize("value,label", [(50, "high"), (100, "high"), (20, "medium"), (35, "medium"), (0, "low"), (10, "low")])
def test_priority(spark, value, label):
    df = spark.createDataFrame([(value,)], "s int")
    assert df.select(filters.candidate_priority(F.col("s"))).first()[0] == label
