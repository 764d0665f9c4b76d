"""Clusters of similar matches against the plain greedy run, where most texts share most of their text."""

import random

import pytest

from riskloom.operators import summary


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def greedy(rows, threshold=0.8):
    """{(rule, text): leader} of (rule, text, file, line)."""
    first = {}
    for rule, text, file, line in rows:
        first[rule, text] = min(first.get((rule, text), (file, line)), (file, line))
    out = {}
    for rule in {r for r, _ in first}:
        leaders = []
        for text in sorted((t for r, t in first if r == rule), key=lambda t: (first[rule, t], t)):
            near = next((x for x in leaders if text and x and 1 - distance(text, x) / max(len(text), len(x)) >= threshold - 1e-12), None)
            out[rule, text] = near or text
            if near is None:
                leaders.append(text)
    return out


def made(rnd, n, families):
    rows = []
    for i in range(n):
        value = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rnd.choice([18, 20, 22])))
        rows.append(("R1", f'token = "{value}"', f"f{rnd.randrange(50)}", i))
    for i in range(families):
        rows.append((rnd.choice(["R2", "R1"]), f'set password "{rnd.choice("abcdef")}{rnd.randrange(300)}" for user', f"g{rnd.randrange(50)}", i))
    return rows + [("R3", None, "x", 1), ("R3", "", "x", 2), ("R3", "é𝄞 short", "x", 3), ("R3", "é𝄞 shirt", "x", 4)]


@pytest.mark.parametrize("hot,most_hot", [(4, 10), (64, 1_024), (3, 10**9)])
def test_clusters_equal_the_greedy_run(spark, hot, most_hot):
    rows = made(random.Random(hot), 120, 150)
    df = spark.createDataFrame(rows, "rule_id string, match string, file string, line int")
    got = {(r["rule_id"], r["text"]): r["leader"] for r in summary.cluster_similar(df, hot=hot, most_hot=most_hot).collect()}
    assert got == greedy([(r, t or "", f, n) for r, t, f, n in rows])


def test_candidates_grow_with_the_texts_not_with_their_square(spark):
    """All texts share one literal; the values differ. A text meets at most `hot` others on each of its segments."""
    for n in (1_000, 4_000):
        rows = [r for r in made(random.Random(1), n, 0) if r[0] == "R1"]
        df = spark.createDataFrame(rows, "rule_id string, text string, file string, line int").select("rule_id", "text")
        index = summary.segment_index(df, 0.8)
        assert index.where("NOT rare").select("r").distinct().count() <= n // 50
        segments = index.count() / n
        assert summary.candidate_pairs(df, index, 0.8).count() <= n * segments * summary.HOT and segments < 14
        assert index.groupBy("rule_id", "seg").count().where(f"count > {len(summary.SPARE) * summary.HOT}").count() == 0
