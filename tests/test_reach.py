"""Reachability from seeds against plain searches: cycles, hot nodes, depth."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from riskloom.operators import reach, symbols


def plain(edges, seeds, most=None):
    to = {}
    for p, a, b in edges:
        if a is not None and b is not None:
            to.setdefault((p, a), set()).add(b)
    out = set()
    for p, s, start in seeds:
        if start is None:
            continue
        far, queue = {start: 0}, deque([start])
        while queue:
            x = queue.popleft()
            for y in to.get((p, x), ()):
                if y not in far and (most is None or far[x] < most):
                    far[y] = far[x] + 1
                    queue.append(y)
        out |= {(p, s, n, d) for n, d in far.items()}
    return out


@pytest.mark.parametrize("fan,most", [(10_000, None), (3, None), (3, 2)])
def test_equals_a_plain_search(spark, fan, most):
    rnd = random.Random(fan)
    edges = [(rnd.choice("pq"), f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(70)] + [("p", "hub", f"n{i}") for i in range(30)] + [("p", f"n{i}", "hub") for i in range(5)]
    edges += [("p", "n1", "n1"), ("p", None, "n1"), ("p", "n1", None), edges[0]]
    seeds = [("p", "s1", "hub"), ("p", "s2", "n3"), ("q", "s1", "n3"), ("q", "s3", "none"), ("p", "s2", "n4"), ("p", "s2", "n4"), ("p", "s4", None)]
    got = reach.reach(spark.createDataFrame(edges, "project string, src string, dst string"), spark.createDataFrame(seeds, "project string, seed string, node string"), most, fan).collect()
    # one seed name may start at two nodes: the least depth counts
    want = {}
    for p, s, n, d in plain(edges, seeds, most):
        want[p, s, n] = min(d, want.get((p, s, n), d))
    assert sorted((r["project"], r["seed"], r["node"], r["depth"]) for r in got) == sorted((*k, d) for k, d in want.items())


def test_hot_node_is_dealt_to_parts(spark):
    edges = spark.range(100_000).select(F.lit("p").alias("project"), F.lit("Base").alias("src"), F.concat(F.lit("C"), F.col("id").cast("string")).alias("dst"))
    links, hot = reach.parted_edges(edges)
    assert hot.collect()[0]["parts"] == 10
    assert links.groupBy("project", "src", "part").count().agg(F.max("count")).first()[0] < 12_000
    found = reach.reach(edges, spark.createDataFrame([("p", "Base", "Base")], "project string, seed string, node string"))
    assert found.count() == 100_001


def test_chains_of_any_depth_and_only_from_seeds(spark):
    rows = [("p", f"K{i}", "class", [f"K{i + 1}"]) for i in range(12)] + [("p", f"L{i}", "class", [f"K{i}"]) for i in range(5)] + [("p", "K12", "class", ["K0"])]
    df = spark.createDataFrame(rows, "project string, name string, kind string, supers array<string>")
    one = symbols.class_hierarchy(df, classes=spark.createDataFrame([("p", "K9")], "project string, class string")).collect()
    assert {(r["class"], r["related"], r["depth"]) for r in one} == {("K9", f"K{(9 + d) % 13}", d) for d in range(1, 13)}
    assert symbols.class_hierarchy(df).count() == 13 * 12 + 5 * 13
    none = spark.createDataFrame([], "project string, src string, dst string")
    assert reach.reach(none, spark.createDataFrame([("p", 1, "a")], "project string, seed int, node string")).count() == 1
