"""Retrieval against a plain loop over queries and documents."""

import random

from riskloom.operators import retrieve


def test_retrieval_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    words = ["sql", "a", "in", "inject", "injection", "xss", "the", "path", "çé", "b2"]
    docs = [(i, " ".join(rng.choices(words, k=2)).upper(), rng.sample(words, 2), [f"CWE-{i % 5}"] if i % 3 else None,
             None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(120)]
    queries = [(f"q{i}", " ".join(rng.choices(words, k=rng.randrange(4)))) for i in range(12)] + [("e", "  "), ("n", None), ("c", "cwe-3"), ("dup", "sql sql Path")]
    monkeypatch.setattr(retrieve, "BLOCK_CHARS", 40)
    monkeypatch.setattr(retrieve, "CANDIDATES_KEPT", 10)
    got = retrieve.retrieve_docs(spark.createDataFrame(queries, "query_id string, text string"),
                                 spark.createDataFrame(docs, "doc_id long, title string, tags array<string>, cwe_ids array<string>, content string").repartition(3), 4)
    want = []
    for qid, text in queries:
        q = (text or "").lower()
        scored = []
        for i, title, tags, cwes, content in docs:
            points = sum(w in (content or "").lower() for w in q.split())
            if q.split():
                points += 10 * (q in title.lower()) + 5 * any(q in t.lower() for t in tags) + 8 * any(q in c.lower() for c in cwes or [])
            if points:
                scored.append((-points, i))
        want += [(qid, i, -p) for p, i in sorted(scored)[:4]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_asset_matches_equal_brute_force(spark, monkeypatch):
    from riskloom.operators import fingerprint

    monkeypatch.setattr(fingerprint, "BLOCK_CHARS", 12)
    none = []
    prints = [("p", ["WordPress"], ["React", "S3/Object Storage"], ["/admin"], none), ("q", none, ["React"], none, ["/api", "a"]), ("r", none, none, none, none)]
    kind = "project string, platforms array<string>, technologies array<string>, admin_paths array<string>, api_paths array<string>"
    frame = spark.createDataFrame(prints, kind)
    lines = ["http://x/ADMIN/react", "http://y/wordpress", " http://x/ADMIN/react ", "zzz", "", None, "react-reaction/api"]
    got = {(r.project, r.asset): r.hit_tokens for r in fingerprint.match_assets(spark.createDataFrame([(x,) for x in lines], "asset string"), frame).collect()}
    want = {}
    for project, *lists in prints:
        tokens = [t.lower() for part in lists for t in part]
        for line in {x.strip() for x in lines if x and x.strip()}:
            hits = [t for t in tokens if t in line.lower()]
            if hits:
                want[project, line] = hits
    assert got == want and len(got) > 4
    assert fingerprint.match_assets(spark.createDataFrame([("x",)], "asset string"), frame.limit(0)).collect() == []
