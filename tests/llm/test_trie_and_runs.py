"""Prefix trie and periodic runs against plain brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskloom.llm import periodic, prefix_trie


# -- periodic runs ------------------------------------------------------------------------------------------------------------
def plain_runs(ids, least, times):
    n, out = len(ids), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            j = i
            while j < n and ids[j] == ids[j - q]:
                j += 1
            start, length = i - q, j - i + q
            smaller = any(all(ids[k] == ids[k - p] for k in range(start + p, start + length)) for p in range(1, q))
            if j > i and length >= max(least, times * q) and not smaller:
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 7), st.lists(st.integers(0, 3), max_size=20),
       st.sampled_from([3, 4, 5]))
def test_runs_equal_brute_force(before, block, copies, after, times):
    ids = before + block * copies + after
    assert periodic.find_runs(np.array(ids, np.int64), 6, times) == plain_runs(ids, 6, times)


def test_runs_of_random_words():
    rnd = random.Random(5)
    for _ in range(600):
        ids = [rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randint(0, 60))]
        assert periodic.find_runs(np.array(ids, np.int64)) == plain_runs(ids, 6, 4)


def test_long_texts_stay_cheap():
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.find_runs(np.tile(np.arange(1000), 200)) == [(0, 200_000, 1000)]


def test_periodic_rows(spark):
    rows = [(1, "a b a b a b a b c"), (2, None), (3, ""), (None, "x x x x x x"), (1, "a b a b a b a b c"), (4, "one\x1ftwo three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("t", F.lit(2))
    got = periodic.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    by = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()), key=str)
    assert by.count((1, 9, [(0, 8, 2)], "a b c")) == 2 and (2, 0, [], "") in by and (3, 0, [], "") in by
    assert (None, 6, [(0, 6, 1)], "x") in by and (4, 2, [], "one\x1ftwo three") in by
    assert periodic.periodic_runs(docs.where("false")).count() == 0


# -- prefix trie --------------------------------------------------------------------------------------------------------------
def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(o) == len(p) + 1 and o[: len(p)] == p for o in members)]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, convs, shape="conv_id long, turn long, role string, text string"):
    rows = [(c, i, r, x) for c, turns in convs.items() for i, (r, x) in enumerate(turns)]
    turns = prefix_trie.digest_turns(spark.createDataFrame(rows, shape))
    ids = spark.createDataFrame([(c,) for c in convs], "conv long")
    return sorted((tuple(r) for r in prefix_trie.trie_nodes(turns, ids).collect()), key=str)


def test_trie_equals_brute_force(spark):
    rnd = random.Random(3)
    convs = {rnd.randrange(-500, 5000): [(rnd.choice("ua"), rnd.choice(["", "x", "hello", "é𝄞"])) for _ in range(rnd.randint(0, 6))] for _ in range(120)}
    convs |= {7000 + i: [("u", "same"), ("a", "answer"), ("u", f"own {i}"), ("a", "end")] for i in range(40)} | {8000 + i: [("u", "same"), ("a", "answer")] for i in range(1100)}
    assert trie_of(spark, convs) == plain_trie(convs)


def test_trie_blocks_and_small_sketch(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "HOT_NODES", 3)
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", 1 << 12)
    rnd = random.Random(4)
    long = [("u", f"turn {i}") for i in range(60)]
    convs = {1: long, 2: long[:50], 3: long[:33] + [("a", "z")] * 9, 4: [("u", "other")] * 30, 9: []} | {20 + i: long[: rnd.randint(0, 40)] for i in range(30)}
    assert trie_of(spark, convs) == plain_trie(convs)


def test_trie_odd_rows(spark):
    rows = [(1, 2, "a", "y"), (1, None, "u", "x"), (2, 0, "u", "x"), (2, 1, "a", "y"), (3, 0, None, None), (4, 0, "", ""), (4, 0, "", ""), (None, 0, "u", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash")).withColumn("depth", F.lit(1))
    placed = prefix_trie.digest_turns(turns)
    got = sorted((tuple(r) for r in prefix_trie.trie_nodes(placed, placed.select("conv").distinct()).collect()), key=str)
    assert got == plain_trie({1: [("u", "x"), ("a", "y")], 2: [("u", "x"), ("a", "y")], 3: [("", "")], 4: [("", ""), ("", "")]})
    none = prefix_trie.digest_turns(turns.where("false"))
    assert prefix_trie.trie_nodes(none, none.select("conv")).count() == 0


def test_sketch_never_estimates_too_little():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 300, 5000)
    counts = prefix_trie.CountMin(1 << 12)
    for part in np.array_split(keys, 7):
        counts.add(part % 5, part * 7919, part * 104729)
    values, true = np.unique(keys, return_counts=True)
    assert (counts.estimate(values % 5, values * 7919, values * 104729) >= np.minimum(true, 255)).all()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_periodic_runs"])
def test_query_equals_its_sql(spark, name):
    import os

    import duckdb

    from riskloom.llm.queries import ORACLES, QUERIES
    from tests.oracle_check import TABLES, compare

    folder = os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.exists(f"{folder}/documents.parquet"):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], folder)[0] == "OK"
