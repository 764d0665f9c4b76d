"""Groups in which near-duplicate candidates meet: bounded at any size, and no pair lost. Vectors whose float32 form says little."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hnsw, simhash


def family(rnd, rows, hot):
    words = rnd.integers(0, 2**63, rows).astype(np.uint64)
    center = words[0]
    for i in range(1, hot):
        for b in rnd.integers(0, 64, 5):
            words[i] = words[i] if b % 2 else words[i] ^ np.uint64(1 << int(b))
        words[i] = center ^ (np.uint64(1) << np.uint64(rnd.integers(0, 64)))
    n = np.where(np.arange(rows) < hot, rnd.integers(95, 106, rows), rnd.integers(0, 400, rows))
    return words, n, rnd.permutation(rows * 10)[:rows].astype(np.int64)


@pytest.mark.parametrize("rows", [4_000, 16_000])
def test_largest_group_is_bounded(rows):
    rnd = np.random.default_rng(rows)
    words, n, key = family(rnd, rows, rows // 3)
    pick = rnd.random(rows) < 0.5
    scale = rows / pick.sum()
    forest = simhash.Forest(words[pick], scale, 13, 7, 1_000)
    groups = simhash.Groups(forest, words[pick], n[pick], scale, 0.8, 250)
    group, at, side = groups.visits(words, n, key)
    _, sizes = np.unique(group, return_counts=True)
    assert sizes.max() <= 800  # two blocks of about 250, whatever the family's size


@pytest.mark.parametrize("few", [False])
def test_no_pair_is_lost(few):
    rnd = np.random.default_rng(7)
    words, n, key = family(rnd, 900, 300)
    forest = simhash.Forest(words, 1.0, 13, 7, 200)
    groups = simhash.Groups(forest, words, n, 1.0, 0.8, 40)
    group, at, side = groups.visits(words, n, key)
    found = []
    order = np.argsort(group, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        own = rows[np.lexsort((key[at[rows]], n[at[rows]]))]
        i = at[own]
        for p in simhash.leaf_pairs(words[i], n[i], key[i], side[own], 13, 0.8, few):
            found += [tuple(sorted(x)) for x in i[p].tolist()]
    near = np.bitwise_count(words[:, None] ^ words[None]) <= 13
    small, large = np.minimum(n[:, None], n[None]), np.maximum(n[:, None], n[None])
    want = {(a, b) for a, b in zip(*np.nonzero(near & (small >= 0.8 * large - 1e-9))) if a < b}
    assert set(found) == want and len(want) > 10_000


def test_size_bands_of_similar_sizes_touch():
    n = np.arange(0, 3_000)
    band = simhash.size_band(n, 0.8)
    for a in range(1, 3_000, 7):
        reach = np.arange(a, min(3_000, int(a / 0.8) + 1))
        assert (np.abs(band[reach] - band[a]) <= 1).all()
    assert band[0] < band[1] - 1


def recall(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=400).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert len(got) == len(range(0, len(x), 50)) and all(len(v) == 10 for v in got.values())
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += sum(score <= np.sort(d)[9] * (1 + 1e-12) for score in found.values())
        assert all(score == d[i] for i, score in found.items())
    return hits / (10 * len(got))


@pytest.mark.parametrize("name", ["huge", "offset", "near_equal", "mixed"])
def test_vectors_that_float32_cannot_tell(spark, name):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(1_200, 12))
    if name == "huge":
        x *= 1e30
    elif name == "offset":
        x += 1e8
    elif name == "near_equal":
        x[300:700] = x[300] + rnd.normal(size=(400, 12)) * 1e-10
    else:
        x[::3] *= 1e25
    assert recall(spark, x) >= 0.9


def test_slices_are_bounded_where_sizes_differ(monkeypatch):
    """A row that may meet hardly any other is no reason to compare thousands of rows with everything at once."""
    rnd = np.random.default_rng(3)
    rows = 6_000
    words, n = rnd.integers(0, 2**63, rows).astype(np.uint64), np.sort(np.append(np.zeros(40, int), np.geomspace(1, 10**9, rows - 40).astype(int)))
    seen, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (seen.append(x.size), count(x))[1])
    found = [tuple(x) for p in simhash.leaf_pairs(words, n, np.arange(rows), np.zeros(rows, np.int8), 26, 0.8, False) for x in p.tolist()]
    near = count(words[:, None] ^ words[None]) <= 26
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near & (n[:, None] >= 0.8 * n[None] - 1e-9))) if a < b}
    assert set(found) == want and len(found) == len(want) > 1_000 and max(seen) <= simhash.CELLS


def test_proposals_are_whole_and_come_once(spark):
    """Every pair within the bits of one of the words and of all words is proposed, by one word, and nothing else leaves a group."""
    rnd = np.random.default_rng(11)
    rows, cols = 700, ["f0", "f1"]
    words = rnd.integers(-2**63, 2**63, (rows, 2)).astype(np.int64)
    for i in range(1, 300):  # a family; some members are near in one word only
        words[i] = words[0]
        for w, turns in ((0, rnd.integers(0, 12)), (1, rnd.integers(0, 40))):
            for b in rnd.integers(0, 64, turns):
                words[i, w] ^= np.int64(np.uint64(1 << int(b)).astype(np.int64))
    n, key = rnd.integers(90, 110, rows), rnd.permutation(rows * 10)[:rows]
    nodes = spark.createDataFrame([(int(key[i]), int(n[i]), int(key[i]), int(words[i, 0]), int(words[i, 1])) for i in range(rows)], "key long, n long, label long, f0 long, f1 long").repartition(3)
    got = [[(r["a"], r["b"]) for r in simhash.propose(nodes, cols, w, 13, 7, 30, 0.8, False, leaf_rows=100, block_rows=60).collect()] for w in (0, 1)]
    u = words.view(np.uint64)
    bits = np.bitwise_count(u[:, None] ^ u[None]).astype(int)
    good = (bits <= 13).any(2) & (bits.sum(2) <= 30) & (np.minimum(n[:, None], n[None]) >= 0.8 * np.maximum(n[:, None], n[None]) - 1e-9)
    want = {tuple(sorted((int(key[a]), int(key[b])))) for a, b in zip(*np.nonzero(good)) if a < b}
    assert set(got[0]) | set(got[1]) == want and len(got[0]) + len(got[1]) == len(want) > 2_000 and got[1]


def texts_of_a_family(rnd, rows):
    """Texts whose shingle sets share from half to nearly all: most pairs are proposed, and about half of them are refused."""
    base = [f"w{i}" for i in range(120)]
    out = []
    for r in range(rows):
        words = list(base)
        for i in rnd.choice(120, int(rnd.integers(1, 5)), replace=False):
            words[i] = f"x{r % 23 if r % 2 else r}_{i}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("set_bytes, leaf_rows, block_rows", [(1 << 23, 500, 500), (20_000, 100, 150)])
def test_a_family_leaves_links_and_no_list_of_pairs(spark, set_bytes, leaf_rows, block_rows):
    rnd = np.random.default_rng(5)
    rows, cols = 240, ["f0", "f1", "f2", "f3"]
    texts = texts_of_a_family(rnd, rows)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    owners = simhash.shingle_prints(docs, 5, 4).withColumnRenamed("id", "first_id").withColumn("label", F.col("key")).cache()
    at = {r["key"]: r["first_id"] for r in owners.collect()}
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    met, listed = None, set()
    for k in range(4):
        more = simhash.meetings(owners, cols, k, 13, 7, 76, 0.8, leaf_rows=leaf_rows, block_rows=block_rows, set_bytes=set_bytes)
        met = more if met is None else met.unionByName(more)
        listed |= {(at[r["a"]], at[r["b"]]) for r in simhash.propose(owners, cols, k, 13, 7, 76, 0.8, False, leaf_rows=leaf_rows, block_rows=block_rows).collect()}
    links = [(at[r["a"]], at[r["b"]]) for r in simhash.similar_links(met, docs, owners, cols, 5, 13, 76, 0.8).collect()]

    def joined(pairs):
        root = list(range(rows))
        for a, b in pairs:
            if root[a] != root[b]:
                root = [root[a] if x == root[b] else x for x in root]
        return {frozenset(i for i in range(rows) if root[i] == k) for k in set(root)}

    good = {(a, b) for a, b in listed if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)
    assert joined(links) == joined(good) and 1_000 < len(good) < len(listed)
    assert len(links) < met.count()
    if set_bytes > 20_000:
        assert met.count() < len(listed) / 2


def test_odd_bits_never_say_more_than_the_sets():
    rnd = np.random.default_rng(9)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 40, 300, 5_000)]
    sets += [np.unique(np.append(s[: len(s) * 9 // 10], rnd.integers(0, 2**63, len(s) // 10).astype(np.uint64))) for s in sets]
    odd = simhash.odd_bits(sets)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert np.bitwise_count(odd[i] ^ odd[j]).sum() <= len(np.setxor1d(x, y))


def test_only_rows_near_in_the_run_of_a_tree_are_compared(monkeypatch):
    """The trees together find every pair, though each compares only rows that are within its radius on its own run of bits."""
    rnd = np.random.default_rng(13)
    words, n, key = family(rnd, 12_000, 400)
    order = np.lexsort((key, n))
    words, n, key = words[order], n[order], key[order]
    forest = simhash.Forest(words, 1.0, 13, 7, len(words))
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (compared.append(x.size), count(x))[1])
    monkeypatch.setattr(simhash, "RUN_ROWS", 16)
    found = {}
    for mask in forest.masks:
        for p in simhash.leaf_pairs(words, n, key, np.zeros(len(n), np.int8), 13, 0.8, False, run=(mask, forest.radius)):
            found |= dict.fromkeys(map(tuple, p.tolist()))
    with_runs, compared[:] = sum(compared), []
    want = {tuple(x) for p in simhash.leaf_pairs(words, n, key, np.zeros(len(n), np.int8), 13, 0.8, False) for x in p.tolist()}
    assert set(found) == want and len(want) > 50_000
    assert with_runs < 7 * sum(compared) / 3


def test_run_blocks_take_every_row_once():
    rnd = np.random.default_rng(2)
    words = rnd.integers(0, 2**63, 3_000).astype(np.uint64)
    mask, seen = (1 << 20) - (1 << 11), []
    for rows, met in simhash.run_blocks(words, mask, 1):
        near = np.bitwise_count((words[:, None] ^ words[None, rows]) & np.uint64(mask)) <= 1
        assert (np.diff(rows) > 0).all() and (met == np.flatnonzero(near.any(axis=1))).all()
        seen += rows.tolist()
    assert sorted(seen) == list(range(3_000))
    assert list(simhash.run_blocks(words[:0], mask, 1)) == []


def test_leaves_grow_with_the_table_within_bounds():
    """A row of a large table visits fewer leaves, and no leaf is cut for being as large as leaves are meant to be."""
    assert [simhash.near_rows(x) for x in (0, 500_000, 1_600_000, 10**9)] == [1 << 15, 1 << 15, 100_000, 1 << 17]
    rnd = np.random.default_rng(4)
    words, n = rnd.integers(0, 2**63, 8_000).astype(np.uint64), rnd.integers(1, 400, 8_000)
    visits = []
    for rows in (simhash.NEAR_ROWS, simhash.near_rows(3_000_000)):
        groups = simhash.Groups(simhash.Forest(words, 375.0, 13, 7, rows), words, n, 375.0, 0.8, max(2 * simhash.NEAR_ROWS, rows))
        assert not len(groups.large) and not len(groups.hot)
        visits.append(len(groups.visits(words, n, np.arange(8_000))[0]))
    assert visits[1] < 0.7 * visits[0]


def test_rows_of_a_group_travel_together(spark):
    """Arrays of rows by group are shuffled, not one row a visit, and every visit arrives, also from small batches."""
    rnd = np.random.default_rng(6)
    words, key = rnd.integers(-2**63, 2**63, 3_000), rnd.permutation(3_000)
    nodes = spark.createDataFrame([(int(k), 100, int(k), int(w)) for k, w in zip(key, words)], "key long, n long, label long, f0 long").repartition(2)

    def leave(group, key, n, pairs):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), group)), pa.array(key)], names=["grp", "key"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "70")
    try:
        found = simhash._in_groups(nodes, ["f0"], 0, 13, 7, 76, 0.8, False, 3_000, 200, 400, leave, "grp long, key long")
        got = sorted((r["grp"], r["key"]) for r in found.collect())
    finally:
        spark.conf.set(name, before)
    assert "key:array<bigint>" in found._jdf.queryExecution().analyzed().children().apply(0).schema().simpleString()
    words, n = words.view(np.uint64), np.full(3_000, 100)
    forest = simhash.Forest(words, 1.0, 13, 7, 200)
    group, at, _ = simhash.Groups(forest, words, n, 1.0, 0.8, 400).visits(words, n, key)
    assert got == sorted(zip(group.tolist(), key[at].tolist())) and len(got) > 7 * 3_000


@pytest.mark.parametrize("sizes", [[], [0, 3], [500] * 9, [20_000, 1, 8_192], [1] * 10])
def test_larger_batches_hold_the_same_rows(sizes):
    ends = np.cumsum([0, *sizes])
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, b))], names=["x"]) for a, b in zip(ends, ends[1:])]
    made = list(simhash.larger(batches, 2_000))
    assert [x for b in made for x in b.column(0).to_pylist()] == list(range(sum(sizes)))
    assert all(2_000 <= b.num_rows < 4_000 for b in made[:-1])
