"""Operators against brute force on small inputs with awkward shapes and hot keys."""

import random
import re

from pyspark.sql import functions as F

from riskloom.functions.ranking import numbered
from riskloom.operators import chunk, comments, dedup, monitor, scan, summary
from riskloom.sources.rules import Rule, usable

FILES = "project string, path string, content string, size long"


def test_offsets_and_lines(spark):
    texts = {"a.py": "x\n\neval(1)\nEVAL(2) eval(\n3)", "b.py": "", "c.py": "no newline eval(", "d.py": "\r\neval(\r\n日本 eval(\U0001f600 eval(", "e.py": "y" * 10_000 + "eval("}
    df = spark.createDataFrame([("p", k, v, 0) for k, v in texts.items()], FILES)
    got = {(r.path, r.offset, r.line, r.match) for r in scan.scan_rules(df, [Rule("E", r"eval\(")]).collect()}
    want = {(k, m.start(), v.count("\n", 0, m.start()) + 1, m.group()) for k, v in texts.items() for m in re.finditer(r"(?i)eval\(", v)}
    assert got == want


def test_bad_rules_are_reported():
    good, bad = usable([Rule("A", "x+"), Rule("B", "exec("), Rule("C", "z*")])
    assert [r.rule_id for r in good] == ["A"] and [b[0] for b in bad] == ["B", "C"]


FIND = "project string, source string, vuln_type string, file string, line int, location string, confidence double, rule_id string, offset int, title string"


def fold(rows):
    """The replacement rule, row by row."""
    kept = {}
    for r in sorted(rows, key=lambda r: (r[4], -r[6], r[3], r[8], r[7])):
        key = (r[0], r[2], r[3].split("/")[-1].lower(), r[4] // 5)
        old = kept.get(key)
        if old is None or len(r[3].split("/")) > len(old[3].split("/")) or r[6] > old[6]:
            kept[key] = r
    return set(kept.values())


def test_dedup_fold(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        file = "/".join(["d"] * rng.randint(0, 3) + [rng.choice(["A.java", "b.java"])])
        line = rng.randint(0, 12)
        rows.append(("p", "quick_scan", rng.choice(["XSS", "SSRF"]), file, line, f"{file}:{line}", rng.choice([0.5, 0.6, 0.9]), f"r{i:04d}", i, "t"))
    df = spark.createDataFrame(rows, FIND)
    once = dedup.dedup_findings(df)
    assert {tuple(r) for r in once.collect()} == fold(rows)
    assert {tuple(r) for r in dedup.dedup_findings(once).collect()} == fold(rows)


def test_ids_are_gap_free_with_a_hot_group(spark):
    rows = [("p" if i % 3 else "q", f"d{i % 7}/f{i % 11}.py", i, "critical") for i in range(900)]
    df = spark.createDataFrame(rows, "project string, file string, line int, severity string").withColumn("vuln_type", F.lit("XSS"))
    out = dedup.assign_ids(df).collect()
    for project in ("p", "q"):
        mine = sorted((r for r in out if r.project == project), key=lambda r: (r.file.rsplit("/", 1)[0], r.file.rsplit("/", 1)[1], r.line))
        assert [r.vuln_id for r in mine] == [f"C-XSS-{n:03d}" for n in range(1, len(mine) + 1)]


def test_numbered_equals_row_number(spark):
    df = spark.range(500).selectExpr("id % 2 AS k", "id % 5 AS a", "id % 13 AS b", "id AS c")
    got = {(r.c, r.rn) for r in numbered(df, ["k"], ["a", "b"], ["c"]).collect()}
    want = set()
    for k in (0, 1):
        ids = sorted((i for i in range(500) if i % 2 == k), key=lambda i: (i % 5, i % 13, i))
        want |= {(i, n) for n, i in enumerate(ids, 1)}
    assert got == want


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_clusters_equal_greedy(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 24))) for _ in range(25)]
    rows = []
    for i in range(160):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice("abcd")
        rows.append(("r", "".join(s), "f", i))
    leaders, want = [], {}
    for _, s, _, _ in rows:
        lead = next((x for x in leaders if 1 - lev(x, s) / max(len(x), len(s)) >= 0.8), None)
        if s in want:
            continue
        if lead is None:
            leaders.append(s)
        want[s] = lead or s
    df = spark.createDataFrame(rows, "rule_id string, match string, file string, line int")
    assert {r.text: r.leader for r in summary.cluster_similar(df).collect()} == want


def test_packing_in_blocks_equals_one_greedy_run(spark):
    rng = random.Random(3)
    rows = [("p", f"src/s{i}.java", "word " * rng.randrange(60), 0) for i in range(230)] + [("q", "one.py", "x", 0)]
    lim = chunk.BatchLimits(4, 700, 180)
    got = chunk.pack_batches(spark.createDataFrame(rows, FILES), lim, block=20).collect()
    assert len(got) == len({(r.project, r.path) for r in got}) == 231
    batch, n, chars, tokens = 1, 0, 0, 0
    for r in sorted((r for r in got if r.project == "p"), key=lambda r: r.ord):
        size, cost = r.chars + len(r.path), r.tokens + 10
        if n and (n >= lim.files or tokens + cost > lim.tokens or chars + size > min(lim.chars, lim.tokens * 4)):
            batch, n, chars, tokens = batch + 1, 0, 0, 0
        n, chars, tokens = n + 1, chars + size, tokens + cost
        assert r.batch == batch


def test_mirror_select_sees_every_candidate(spark):
    from riskloom.operators import repos

    big = [("p", f"src/auth/policy/big{i:03}.ts", None, 900) for i in range(50)]
    rows = big + [("p", "src/api/small.ts", None, 90), ("p", "src/api/tiny.ts", None, 10)]
    got = repos.mirror_select(spark.createDataFrame(rows, FILES), 4, max_bytes=1000).orderBy("ord").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["big000.ts", "tiny.ts", "small.ts"]


def test_comments(spark):
    text = "int a; // eslint-disable-line no-eval\n/* gbt: ignore XSS\n x */ int b; // tail\n/* open"
    df = spark.createDataFrame([("p", "a.js", text, 0)], FILES)
    out = sorted(tuple(r)[2:] for r in comments.parse_comments(df).collect())
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in out] == [
        ("multi", 2, 3, ["XSS"], False), ("multi", 4, 4, [], True), ("single", 1, 1, ["NO-EVAL"], False), ("single", 3, 3, [], False)]


def test_rolling_rate_across_slices(spark):
    rng = random.Random(5)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0.0, 5.0, 40.0])
        rows.append((i, t, "hot", rng.random() < 0.5))
    df = spark.createDataFrame(rows, "id int, t double, key string, ok boolean").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = {r.id: (r.window_calls, r.window_failures, r.consecutive_failures) for r in monitor.rolling_failure_rate(df, 60, slice_seconds=120).collect()}
    run = 0
    for i, t, _, ok in rows:
        run = 0 if ok else run + 1
        inside = [x for x in rows if t - 60 < x[1] <= t]
        assert got[i] == (len(inside), sum(not x[3] for x in inside), run)
