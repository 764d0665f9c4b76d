"""Confidence boosts of rules in scans, and failure rates whose window spans several time slices."""

import random
from datetime import datetime, timedelta

import pytest

from riskloom.operators import monitor, scan
from riskloom.sources.rules import Rule


def test_rules_add_their_boost(spark):
    files = spark.createDataFrame([("p", "a.py", "x = 1\nvalue = danger(y)\nz = other(y)")], "project string, path string, content string")
    found = {}
    for boost in (0.0, 0.2, -0.3):
        rules = [Rule("A", r"danger\(", confidence_boost=boost), Rule("B", r"other\(", kind="source")]
        found[boost] = {r["rule_id"]: r["confidence"] for r in scan.scan_with_context(files, rules).collect()}
    assert found[0.0].keys() == {"A", "B"} and len({f["B"] for f in found.values()}) == 1
    assert found[0.2]["A"] == pytest.approx(found[0.0]["A"] + 0.2) and found[-0.3]["A"] == pytest.approx(found[0.0]["A"] - 0.3)


def test_slices_shorter_than_the_window(spark):
    rnd = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=rnd.randrange(900), microseconds=rnd.choice([0, 0, 5])), rnd.choice("kq"), rnd.random() < 0.5) for i in range(400)]
    rows += [(1000 + i, start + timedelta(seconds=60 * i), "edge", i % 2 == 0) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, key string, ok boolean")
    want = {}
    for i, ts, key, _ in rows:
        window = [ok for _, t, k, ok in rows if k == key and ts - timedelta(seconds=60) < t <= ts]
        want[i] = (len(window), window.count(False))
    for size in (7, 20, 60, 120):
        got = {r["id"]: (r["window_calls"], r["window_failures"]) for r in monitor.rolling_failure_rate(df, 60, slice_seconds=size).collect()}
        assert got == want


def test_rates_do_not_visit_a_window_again_for_each_of_its_calls(spark):
    """A window over all rows is a running total; frames that move at both ends cost rows times window."""
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i // 50), None if i % 7 == 0 else i % 3 == 0) for i in range(2_000)]
    df = spark.createDataFrame([(i, t, "hot", ok) for i, t, ok in rows], "id long, ts timestamp, key string, ok boolean")
    found = monitor.rolling_failure_rate(df, 20, slice_seconds=30)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, -" not in plan
    got = {r["id"]: (r["window_calls"], r["window_failures"]) for r in found.collect()}
    for i, t, _ in rows[::97]:
        inside = [ok for _, x, ok in rows if t - timedelta(seconds=20) < x <= t]
        assert got[i] == (len(inside), sum(ok is False for ok in inside))
