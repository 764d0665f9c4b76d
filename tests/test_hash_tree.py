"""Descent of the hash tree against a plain comparison of all entries."""

import random

from riskloom.sources import hash_tree as ht

FILES = "project string, path string, content string"


def snap(spark, rows):
    entries = ht.tree_entries(spark.createDataFrame(rows, FILES))
    return ht.hash_tree(entries), entries


def test_equals_a_plain_comparison(spark, tmp_path):
    rnd = random.Random(5)
    old = {(rnd.choice("abcd"), f"src/f{i}.py"): rnd.choice(["x", "y", None, ""]) for i in range(400)}
    new = {k: v for k, v in old.items() if k[0] == "a" or rnd.random() > 0.1}
    for k in rnd.sample(sorted(new), 30):
        new[k] = new[k] if k[0] == "a" else f"new {k}"
    new |= {("b", f"more/{i}"): "z" for i in range(9)} | {("e", "only"): "one"}
    want = {(p, f, "added") for p, f in new.keys() - old.keys()} | {(p, f, "removed") for p, f in old.keys() - new.keys()}
    want |= {(p, f, "changed") for p, f in new.keys() & old.keys() if new[p, f] != old[p, f]}
    a, b = snap(spark, [(*k, v) for k, v in new.items()]), snap(spark, [(*k, v) for k, v in old.items()] * 2)
    got = ht.changes(a, b).collect()
    assert {(r["project"], r["path"], r["change"]) for r in got} == want and len(got) == len(want)
    ht.save_tree(b[1], str(tmp_path / "s"))
    again = ht.changes(a, ht.load_tree(spark, str(tmp_path / "s"))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    roots, tops, leaves = ht.differing_buckets(a[0], b[0])
    assert {r["project"] for r in roots.collect()} == {p for p, _, _ in want} and "a" not in {r["project"] for r in tops.collect()}
    assert leaves.count() <= len(want)


def test_unchanged_projects_cost_one_row(spark):
    rows = [(p, f"f{i}", str(i)) for p in "pq" for i in range(300)]
    a, b = snap(spark, rows), snap(spark, list(reversed(rows)))
    assert [d.count() for d in ht.differing_buckets(a[0], b[0])] == [0, 0, 0] and ht.changes(a, b).count() == 0
    assert a[0].where("level = 0").count() == 2
    none = snap(spark, [])
    assert ht.changes(none, b).count() == 600 and ht.changes(a, none).where("change = 'added'").count() == 600 and ht.changes(none, none).count() == 0
