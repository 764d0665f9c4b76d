"""The operators for training data on small tables: brute force, round trips, and the odd cases every operator must bear."""

import hashlib
import heapq
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bpe, bradley_terry, brown, chat, decontaminate, hnsw, html_text, linededup, sharding, simhash
from riskloom.llm.components import connected_components
from riskloom.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LONG = "word " * 40_000
# clashing names: lang, key, row, text length; nulls in any column; empty, very long and repeated texts; repeated rows
ROWS = [(1, "the quick brown fox jumps over", None, 1), (1, "the quick brown fox jumps over", None, 1), (2, "", "x", None), (3, None, "x", 2), (4, LONG, "x", 3),
        (None, "the quick brown fox jumps over", "x", 4), (5, "the quick brown fox jumps over", "y", 5), (6, "é ñ </s> <|end|>", "y", 6), (7, "   \n\t ", "y", 7)]
SCHEMA = "doc_id long, text string, key string, row long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("id", F.lit(1)).withColumn("component_id", F.lit("c")).withColumn("score", F.lit("s"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rng_texts(n, seed=0, words=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"w{r.randrange(50)}"
            out.append(" ".join(w))
        else:
            out.append(" ".join(f"w{r.randrange(50)}" for _ in range(r.randint(1, words))))
    return out


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


# -- components ------------------------------------------------------------------------------------------------------------
def test_components_of_chains_stars_and_nothing(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = roots(300, [p for p in pairs if None not in p])
    assert got == {i: want[i] for i in {x for p in pairs if None not in p and p[0] != p[1] for x in p}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# -- 1 ---------------------------------------------------------------------------------------------------------------------
def plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    texts = rng_texts(120, 1) + ["", None, "A b", "a B"]
    got = {r["id"]: r for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i]["f0"] % 2**64 for i in range(len(texts))] == prints
    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert [got[i]["component_id"] for i in range(len(texts))] == want


@pytest.mark.parametrize("max_bits,parts", [(4, 3), (12, 7), (0, 1)])
def test_forest_loses_no_pair(max_bits, parts):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 150, dtype=np.int64).view(np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << r.integers(0, 64, k).astype(np.uint64)) if k else np.uint64(0) for k in r.integers(0, max_bits + 3, 600)]
    x = np.unique(np.concatenate((base, base[r.integers(0, 150, 600)] ^ np.array(flips, np.uint64))))
    forest = simhash.Forest(x[::3], 3.0, max_bits, parts, leaf_rows=20)
    leaf, at = forest.route(x)
    assert forest.leaves > parts or not max_bits
    pairs = []
    for n in np.unique(leaf):
        mine = at[leaf == n]
        label = simhash.link_leaf(x[mine][:, None], max_bits)
        pairs += [(int(mine[i]), int(mine[k])) for i, k in enumerate(label)]
    want = roots(len(x), [(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= max_bits])
    assert roots(len(x), pairs) == want


def test_simhash_odd_rows(odd, none):
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert len(got) == len(ROWS) and all(c == 1 for i, c in got if i in (1, 5, None)) and {c for i, c in got if i in (2, 3, 7)} == {2}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 6]
    assert simhash.keep_one(none).count() == 0


def jaccard_texts(seed, sizes, copies):
    """Texts of one size each with copies in bands around 0.8, and two texts alike in the bits of a repeated shingle only."""
    r = random.Random(seed)
    out = []
    for n in sizes:
        base = [f"v{r.randrange(10**6)}" for _ in range(n)]
        for k in range(copies):
            w = base.copy()
            cut = max(1, round(n * r.uniform(0.02, 0.5)))
            w[-cut:] = [f"v{r.randrange(10**6)}" for _ in range(r.randint(0, cut))]
            out.append(" ".join(w))
    return out + ["same word again and " * 60 + " ".join(f"{c}{i}" for i in range(90)) for c in "pq"]


def test_near_copies_by_exact_similarity(spark):
    texts = jaccard_texts(11, [12, 20, 30, 45, 80, 150, 300] * 6, 6)
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    pairs = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j]}
    bands = [sum(lo <= v < hi for v in pairs.values()) for lo, hi in ((0.6, 0.7), (0.7, 0.75), (0.75, 0.8), (0.8, 0.85), (0.85, 1.01))]
    assert min(bands) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {x["id"]: x["component_id"] for x in simhash.similar_components(docs, **simhash.NEAR).collect()}
    want = roots(len(texts), [p for p, v in pairs.items() if v >= 0.8])
    lost = [(v, len(sets[i])) for (i, j), v in pairs.items() if v >= 0.8 and got[i] != got[j]]
    assert not lost, lost
    assert [got[i] for i in range(len(texts))] == want  # nothing else is joined


def test_keep_one_takes_similar_texts_and_leaves_others(spark):
    r = random.Random(9)
    words = [f"t{r.randrange(400)}" for _ in range(300)]
    near = words.copy()
    near[150] = "changed"
    other = [f"t{r.randrange(400)}" for _ in range(300)]
    docs = spark.createDataFrame([(3, " ".join(words)), (2, " ".join(near)), (1, " ".join(other))], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.keep_one(docs).collect()) == [1, 2]


# -- 2 ---------------------------------------------------------------------------------------------------------------------
def test_hnsw_recall_ties_and_unusable_rows(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(900, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[5].tolist()) for i in range(60)] + [
        (2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] * 16), (None, x[0].tolist()), (2005, []), (7, x[7].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("a")).withColumn("shard", F.lit("b"))
    got = {}
    for q in hnsw.nearest(v, v.where("vec_id % 100 = 0 OR vec_id = 5"), shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(q["query_id"], []).append((q["vec_id"], q["score"], q["rank"]))
    ids = np.concatenate((np.arange(900), np.arange(1000, 1060)))
    all_x = np.concatenate((x, np.repeat(x[5:6], 60, 0))).astype(np.float64)
    hits = total = 0
    for q, found in got.items():
        d = np.sqrt(((all_x - all_x[list(ids).index(q)]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hits += len({f[0] for f in found} & {int(ids[k]) for k in order})
        total += 10
        assert [f[2] for f in found] == list(range(1, 11)) and all(math.isclose(f[1], d[list(ids).index(f[0])], rel_tol=1e-12) for f in found)
    assert set(got) == {*range(0, 900, 100), 5, 1000} and hits / total >= 0.95
    assert [f[0] for f in got[5]] == list(range(1000, 1010)) and [f[0] for f in got[1000]][:3] == [5, 1001, 1002]
    assert hnsw.nearest(v.where("false"), v).count() == 0
    assert hnsw.nearest(v.where("vec_id < 3"), v.where("vec_id = 1")).count() == 2


# -- 3 ---------------------------------------------------------------------------------------------------------------------
def edits_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    r = random.Random(2)
    items = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randint(30, 150))).strip()) for i in range(12)] + [(90, None), (91, ""), (92, "tiny item")]
    docs = []
    for k in range(80):
        text = "".join(r.choice("abcdefgh ") for _ in range(300))
        if k % 2:
            item = list(r.choice(items[:12])[1].upper())
            for _ in range(r.randint(0, 14)):
                item[r.randrange(len(item))] = r.choice("xyz")
            text = text[:150] + "\n" + "".join(item) + "  " + text[150:]
        docs.append((k, text))
    docs += [(80, None), (81, ""), (82, "a  TINY\titem here"), (83, "atiny items"), (82, "a  TINY\titem here")]
    got = sorted(tuple(x) for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = []
    for d, text in docs:
        for i, item in items:
            p, t = decontaminate.normal(item), decontaminate.normal(text)
            if p and t and decontaminate.budget(len(p)):
                e = edits_inside(p, t)
                if e <= decontaminate.budget(len(p)):
                    want.append((d, i, e, decontaminate.budget(len(p))))
    want += [(82, 92, 0, 0)] * 2
    assert got == sorted(want) and len(want) > 15


def test_decontamination_in_blocks_and_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps"), (2, "nothing like this at all in there"), (None, None)], "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.contaminated(odd, items, block_chars=n).collect()), key=str) for n in (10**6, 5))
    assert one == many and [x[0] for x in one] == [1, 1, 5, None]
    kept = decontaminate.drop_contaminated(odd, items, block_chars=5)
    assert kept.columns == odd.columns and sorted(x["doc_id"] for x in kept.collect()) == [2, 3, 4, 6, 7]
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.drop_contaminated(none, items).count() == 0
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0 and decontaminate.drop_contaminated(odd, items.where("false")).count() == len(ROWS)


# -- 4 ---------------------------------------------------------------------------------------------------------------------
def test_chat_prefixes(spark):
    bad = r"<|end|> </s>[INST] <\|say|> [\\/INST] <\\</s>"
    rows = [(1, 2, "assistant", bad), (1, 1, "user", "hi"), (1, 3, "user", None), (2, 1, "user", "x"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (3, None, None, "first"),
            (None, 1, "assistant", "no id"), (4, 1, "we<|say|>ird", "é" * 50_000), (5, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("u", F.lit(1)).withColumn("example", F.lit("e"))
    ex = chat.expand_prefixes(turns)
    e1 = ex.where("conv_id = 1").orderBy("example").collect()
    assert [(x["n_turns"], x["target"], x["complete"]) for x in e1] == [(2, 1, False), (3, None, True)] and e1[1]["text"].startswith(e1[0]["text"])
    assert e1[0]["text"].count(chat.TURN) == 2 and e1[0]["text"].endswith(chat.TAIL)
    a = e1[0]["loss_start"]
    assert "</s>" not in e1[0]["text"] and e1[0]["text"][a:a + e1[0]["loss_chars"]] + chat.TAIL == e1[0]["text"][a:]
    got = {x["conv_id"]: x for x in chat.digests(ex).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(f"user\nhi\nassistant\n{bad}\nuser\n\n") and got[1]["loss_sha256"] == sha(bad) and got[1]["loss_chars"] == len(bad)
    assert got[3]["turns_sha256"] == sha("\nfirst\nassistant\na\nassistant\na\n") and got[3]["loss_sha256"] == sha("aa") and got[3]["n_examples"] == 2
    assert got[2]["loss_chars"] == 0 and got[2]["loss_sha256"] == sha("") and got[None]["n_turns"] == 1 and got[5]["loss_chars"] == 0
    assert got[4]["turns_sha256"] == sha("we<|say|>ird\n" + "é" * 50_000 + "\n")
    assert chat.digests(chat.expand_prefixes(turns.where("false"))).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(*tokenizer())


def test_bpe_equals_the_rank_order_encoder(coder):
    import tiktoken

    path, pattern = tokenizer()
    ranks = {w: i for i, w in coder.tokens.items()}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    pool = "abcdefghijklmnopqrstuvwxyz ETAOIN'sllved\n\t\r .,;!?0123456789éüñßçàêöÄÖ" + "日本語テスト한국어русскийالعربية😀🎉👩‍👩‍👧‍  ﬁǆ"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 80))) for _ in range(1500)] + ["", " ", "a" * 5000, "the" * 2000, "<|endoftext|>", "\n\n\n  x", "'s's'll"]
    for t in texts:
        ids = coder.encode(t)
        assert ids == plain.encode_ordinary(t) and coder.decode(ids) == t


def test_bpe_offsets_and_split_characters(coder):
    text = "naïve 😀 日本 ok"
    ids = coder.encode(text)
    starts, ends = coder.offsets(text, ids)
    for k, i in enumerate(ids):  # a token's bytes lie within the characters it covers
        assert coder.tokens[i] in text[starts[k]:ends[k]].encode()
    assert starts[0] == 0 and ends[-1] == len(text) and coder.offsets("", []) == ([], [])
    lone = next(i for i, w in coder.tokens.items() if w == "😀".encode()[:1])
    assert coder.decode([lone]) == "�" and len(bpe.byte_characters()) == len(set(bpe.byte_characters())) == 256


def test_bpe_small_memory_gives_the_same(coder):
    small = bpe.ByteBPE(*tokenizer(), kept=3)
    assert small.encode_many(["a b c d e", "a b", "f g h"]) == coder.encode_many(["a b c d e", "a b", "f g h"])


def test_bpe_odd_rows(odd, none):
    path, pattern = tokenizer()
    coded = bpe.encode_texts(odd, path, pattern, with_offsets=True)
    back = bpe.decode_ids(coded, path).collect()
    assert len(back) == len(ROWS) and all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert all(len(r["token_ids"]) == len(r["token_starts"]) == len(r["token_ends"]) for r in back)
    digests = bpe.round_trip_digests(odd, path, pattern).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in digests} == {(r["doc_id"], len(r["token_ids"])) for r in back}
    assert bpe.round_trip_digests(none, path, pattern).count() == 0 and bpe.encode_texts(none, path, pattern).count() == 0


def test_bpe_encodes_and_checks_in_one_pass(odd, none):
    import corpus_pipeline as p

    path, pattern = tokenizer()
    done = p.encoding(odd.sparkSession, odd, SF)
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = bpe.decode_ids(bpe.encode_texts(odd, path, pattern), path).withColumn("n_tokens", F.size("token_ids").cast("long"))
    two = two.withColumn("round_trip", F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).drop("decoded")
    assert done.columns == two.columns and [t for _, t in done.dtypes] == [t for _, t in two.dtypes]
    assert sorted(map(repr, done.collect())) == sorted(map(repr, two.collect())) and all(r["round_trip"] for r in done.collect())
    assert bpe.encode_and_check(none, path, pattern).count() == 0


def test_bpe_lists_are_spelt_like_single_texts(coder):
    texts = ["naïve 😀", "", " the the", "\n\n x"]
    ids = coder.encode_lists(texts)
    assert ids.to_pylist() == [coder.encode(t) for t in texts] and coder.decode_lists(ids).to_pylist() == [t.encode() for t in texts]
    some = pa.array([ids[0].as_py(), None, [], ids[2].as_py()], pa.list_(pa.int32()))
    assert coder.decode_lists(some[1:]).to_pylist() == [None, b"", texts[2].encode()]
    for wrong in (-1, 1 << 30, None):
        with pytest.raises(Exception):
            coder.decode_lists(pa.array([[wrong]], pa.list_(pa.int32())))
    with pytest.raises(KeyError):
        bpe.ByteTable({b"a": 0, b"b": 2}).decode_lists(pa.array([[1]], pa.list_(pa.int32())))


# -- 6 ---------------------------------------------------------------------------------------------------------------------
def test_line_chunks(spark, odd, none):
    r = random.Random(8)
    shared = [f"shared line {i}" for i in range(12)]
    texts = []
    for k in range(30):
        own = [f"own {k} {i} {r.random()}" for i in range(r.randint(0, 5))]
        texts.append("\n".join(own + (shared if k % 3 == 0 else []) + own[::-1]))
    done = {x["doc_id"]: x for x in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen = set()
    for k, t in enumerate(texts):
        keep = []
        for chunk in linededup.cut_lines(t):
            body = "\n".join(chunk)
            if sum(1 for x in chunk if x.strip()) >= 2 and body in seen:
                continue
            seen.add(body)
            keep += chunk
        assert done[k]["text"] == "\n".join(keep)
    assert sum(x["removed_chunks"] for x in done.values()) > 10 and done[0]["text"] == texts[0]
    rows = linededup.dedup_lines(odd)
    assert rows.columns == odd.columns + ["removed_chunks", "removed_lines"] and rows.count() == len(ROWS)
    assert {(x["doc_id"], x["text"]) for x in rows.collect()} == {(a, b) for a, b, _, _ in ROWS}  # single lines stay
    assert linededup.dedup_lines(none).count() == 0
    twice = spark.createDataFrame([(2, "a\nb\nc\nd\ne\nf"), (None, "a\nb\nc\nd\ne\nf"), (1, None)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in linededup.dedup_lines(twice).collect()}
    assert got[2]["removed_chunks"] == 0 and got[1]["text"] is None and got[None]["removed_chunks"] > 0


def test_passages_of_one_to_six_lines_go_in_any_surroundings(spark, odd, none):
    r = random.Random(4)

    def fresh(n):
        return " ".join(f"u{r.randrange(10**9)}" for _ in range(n))

    docs, planted = [], []
    for k in range(1, 7):  # 54 words or more in k lines, blank lines between some of them
        lines = [fresh(54 // k + 1) + (f"\n" if i % 2 and i < k - 1 else "") for i in range(k)]
        planted.append("\n".join(lines))
        for _ in range(3):
            docs.append("\n".join([fresh(r.randint(1, 9)) for _ in range(r.randint(1, 4))] + [planted[-1]] + [fresh(r.randint(1, 9)) for _ in range(r.randint(1, 4))]))
    docs.append("\n".join(["short and common", fresh(9)]))
    docs.append("\n".join(["short and common", fresh(9)]))
    docs.append("\n".join(["the same line over and over"] * 40))
    got = {x["doc_id"]: x for x in linededup.dedup_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    for i, text in enumerate(docs[:18]):
        passage = planted[i // 3]
        assert got[i]["text"] == (text if i % 3 == 0 else text.replace(passage + "\n", "")), i
        assert got[i]["removed_lines"] == (0 if i % 3 == 0 else passage.count("\n") + 1)
    assert got[18]["text"] == docs[18] and got[19]["text"] == docs[19]
    assert 9 <= got[20]["text"].count("\n") + 1 < 40 and set(got[20]["text"].split("\n")) == {"the same line over and over"}
    rows = linededup.dedup_passages(odd)
    assert rows.columns == odd.columns + ["removed_lines"] and rows.count() == len(ROWS) and linededup.dedup_passages(none).count() == 0
    kept = linededup.dedup_passages(spark.createDataFrame([(2, docs[0]), (None, docs[0]), (2, docs[0]), (1, None)], "doc_id long, text string")).collect()
    assert sorted(((x["doc_id"], x["removed_lines"]) for x in kept), key=str) == [(1, 0), (2, 0), (2, 0), (None, docs[0].count("\n") + 1)]


def test_passages_against_brute_force(spark):
    r = random.Random(6)
    docs = [[f"w{r.randrange(6)} " * r.randint(0, 4) for _ in range(r.randint(1, 30))] for _ in range(25)]
    got = {x["doc_id"]: x for x in linededup.dedup_passages(spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), over=6).collect()}
    left = [got[i]["text"].split("\n") for i in range(len(docs))]
    seen, lines = set(), set()
    for k, d in enumerate(docs):
        repeated, last = set(), len(d)
        for a in range(last):
            for b in range(a + 1, last + 1):
                if sum(len(x.split()) for x in d[a:b]) > 6 and tuple(d[a:b]) in seen:
                    repeated.update(i for i in range(a, b) if d[i].strip())
        assert sum(1 for x in left[k] if x.strip()) <= sum(1 for i, x in enumerate(d) if x.strip() and i not in repeated)
        seen |= {tuple(d[a:b]) for a in range(last) for b in range(a + 1, last + 1)}
        lines |= {x for x in left[k] if x.strip()}
        assert {x for x in d if x.strip()} <= lines  # nothing is lost


# -- 7 ---------------------------------------------------------------------------------------------------------------------
def test_least_loaded_is_the_plain_schedule():
    r = random.Random(6)
    items = [(f"i{k}", r.randint(1, 500)) for k in range(200)]
    loads, want = [0] * 7, {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        s = min(range(7), key=lambda j: (loads[j], j))
        want[name], loads[s] = s, loads[s] + size
    assert sharding.least_loaded(items, 7) == want and heapq.nsmallest(1, loads)[0] > 0.97 * max(loads)


def check_shards(rows, shards):
    by_text, slots, load = {}, {}, [0] * shards
    for r in rows:
        assert by_text.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


@pytest.mark.parametrize("grain,rows_per_slice", [(1024, 20_000), (4, 10)])
def test_shards(spark, grain, rows_per_slice):
    r = random.Random(1)
    texts = ["copy " * 20] * 60 + ["x" * r.randint(0, 300) + str(k) for k in range(900)]
    rows = sharding.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 6, grain=grain, rows_per_slice=rows_per_slice).collect()
    load = check_shards(rows, 6)
    assert {r["id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in enumerate(texts)}
    assert max(load) - min(load) < (0.01 if grain == 1024 else 0.2) * sum(load) / 6


def test_shards_odd_rows(odd, none):
    rows = sharding.assign_shards(odd, 3).collect()
    assert len(rows) == len(ROWS)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["id"] in (1, 5, None)}) == 1 and {r["size"] for r in rows if r["id"] in (2, 3)} == {8}
    assert sharding.assign_shards(none, 3).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------------------------
SMALL = brown.Settings(events=40, shapes=8, classes=6, rounds=4)


def test_brown_is_a_distribution_and_counts_right(spark):
    r = random.Random(3)
    a, b = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    texts = [" ".join(r.choice(side) for _ in range(30)) for side in (a, b) for _ in range(40)] + ["", None, "rare WORD"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = brown.train(docs, settings=SMALL)
    tokens = [w for t in texts for w in [*(t or "").lower().split(), "\n"]]
    counts = {w: tokens.count(w) for w in set(tokens)}
    assert (model.tokens, model.types) == (len(tokens), len(counts)) and {x["word"]: x["n"] for x in model.counts.collect()} == counts
    ask = [(0, "a1 b2 a1"), (1, "a1 zzz unseen"), (2, None), (3, " ".join(b)), (3, " ".join(b))]
    got = sorted(map(tuple, brown.score(spark.createDataFrame(ask, "doc_id long, text string").withColumn("word", F.lit(1)), model).collect()))
    n, v = len(tokens), len(counts)
    for row, (i, t) in zip(got, ask):
        words = [*(t or "").lower().split(), "\n"]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert row[:4] == (i, len(words), sum(w in counts for w in words), n) and math.isclose(row[4], base, rel_tol=1e-9)
    assert got[3][5] > got[3][4] + 3  # class transitions help within one kind of words
    # one step from any class: all known words and one unknown word per class add up to one
    whole = n + 0.5 * (v + 1)
    for c in range(SMALL.classes):
        total = 0.0
        for w, k in counts.items():
            e = model.events.get(w.encode(), SMALL.events + 1 + zlib.crc32(w.encode()[-3:]) % SMALL.shapes)
            d = model.class_of[e]
            total += SMALL.mix * model.transition[c, d] * (k + 0.5) / model.spread[d]
        total += SMALL.mix * sum(model.transition[c, d] * 0.5 / model.spread[d] for d in range(SMALL.classes))
        total += (1 - SMALL.mix) * sum((k + 0.5) / whole for k in [*counts.values(), 0])
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_brown_exchange_splits_two_kinds_of_words():
    r = np.random.default_rng(1)
    pairs = [(w, u) for kind in (range(1, 13), range(13, 25)) for w in kind for u in kind if r.random() < 0.8] + [(0, 1), (0, 14), (2, 0), (15, 0)]
    left, right = np.array(pairs).T
    class_of = brown.exchange(left, right, r.integers(1, 6, len(pairs)), 25, 4, 20)
    assert class_of[0] == 0 and not set(class_of[1:13]) & set(class_of[13:]) and not (class_of[1:] == 0).any()


def test_brown_rare_words_and_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(brown, "HEAD_WORDS", 3)
    monkeypatch.setattr(brown, "FLUSH", 2)
    model = brown.train(odd, settings=SMALL)
    got = brown.score(odd, model).collect()
    assert len(got) == len(ROWS) and {r["n_known"] - r["n_tokens"] for r in got} == {0}
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 7)} == {1} and next(r["n_tokens"] for r in got if r["doc_id"] == 4) == 40_001
    empty = brown.train(none, settings=SMALL)
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in brown.score(odd, empty).collect())
    assert brown.score(none, model).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body><header class=top><h1>Site</h1></header>
<div id="cookie-notice"><p>We use cookies to make the site better for you</p></div><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>hidden</p> -->
<main><article><h1>Title &amp; more</h1><p>One <b>two</b>  three&nbsp;four<p>a < b &lt;i&gt;<div class="ad-slot">Buy</div><ul><li>item a<li>item b</ul>
<form><input><p>mail</form><aside>side</aside><p title="x > y">Last<br>line</article><section id="comments"><article><p>I like it</p></article></section></main>
<footer>&copy; x</footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE) == "Title & more\nOne two three four\na < b <i>\nitem a\nitem b\nLast line"


def test_html_without_container_uses_both_passes():
    good = "This is the text of the page and it has a lot of the words that are in all of the texts. " * 4
    html = (f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>More of the news</a></div><h2>Short heading</h2><p>{good}</p><p>Short one.</p><p>{good}</p>"
            "<div>© 2020 The company and all of the rights</div></body>")
    assert html_text.main_text(html) == "\n".join(["Short heading", good.strip(), "Short one.", good.strip()])


@pytest.mark.parametrize("html", [None, "", "plain", "<", "<p", "<a b='", "<!--", "<script>", "</p></p>", "<p>" * 3000, "&#0;&bogus;&am", "<article><p>x" + " y" * 100_000])
def test_html_broken_pages(html):
    assert isinstance(html_text.main_text(html), str)


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "no-sidebar", "has-sidebar", "with-menu", "page-header-fixed", "cookie-banner-shown", "sidebar"])
def test_html_wrappers_with_noise_names(name):
    good = "This is the text of the page and it has a lot of the words that are in all of the texts. " * 4
    inner = f"<p>{good}</p><div class='comments'><article><p>I like it</p></article></div><div class='ad'>Buy this</div>"
    assert html_text.main_text(f"<body><div class='{name}'><article><p>{good}</p></article>{inner[inner.index('<div'):]}</div></body>") == good.strip()
    if name != "sidebar":
        assert html_text.main_text(f"<body><div class='{name}'>{inner}</div></body>") == good.strip()
    assert html_text.main_text(f"<body><form>{inner}</form></body>") == good.strip()
    assert html_text.main_text(f"<body><p>{good}</p><div class='{name}'><p>Some of the other things are in here.</p></div></body>") == good.strip()


def test_html_container_is_one_feature_of_the_rules():
    good = "This is the text of the page and it has a lot of the words that are in all of the texts. " * 4
    cards = "".join(f"<article><a href=/{i}>Teaser number {i}</a></article>" for i in range(3))
    assert html_text.main_text(f"<body><div><p>{good}</p></div>{cards}<div>Imprint</div></body>") == good.strip()
    assert html_text.main_text(f"<main><h1>Title</h1><p>{good}</p><p>© 2020 Some company</p></main><p>{good}</p><div>Imprint</div>") == "\n".join(["Title", good.strip(), good.strip()])


@pytest.mark.parametrize("good", ["Это обычный текст страницы на языке, которого нет в списке служебных слов, и он достаточно длинный. " * 4,
                                  "De kat zat gisteren rustig naast onze oude keukentafel terwijl buiten harde regen viel. " * 4, "这是一个没有列出的语言的网页正文,它应该被完整地保留下来。" * 12])
def test_html_other_languages_without_container(good):
    html = f"<body><div><a href=1>Раз</a> <a href=2>Два</a> <a href=3>Три</a></div><p>{good}</p><p>{good}</p><div>© 2020 {good}</div></body>"
    assert html_text.main_text(html) == "\n".join([good.strip(), good.strip()])


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit(5))
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(r["n_chars"] for r in got.collect())[:2] == [0, 0] and got.count() == 4
    assert html_text.extract_text(pages.where("false")).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------------
@tables
def test_quality_on_held_out_labels(spark):
    from riskloom.llm.queries import quality_scores

    scored = quality_scores(spark, SF.replace("0.001", "0.01"))
    rows = scored.join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert wins >= 0.95 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 1), (None, 1, 0), (2, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    ranker = bradley_terry.train(odd, labels)
    got = bradley_terry.with_scores(odd, ranker)
    assert got.columns == odd.columns and got.count() == len(ROWS)
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by[1] == by[5] > by[4] and all(0 <= s <= 1 for s in by.values())
    flat = bradley_terry.train(odd, labels.where("quality = 1"))
    assert {round(r["score"], 9) for r in bradley_terry.with_scores(odd, flat).collect()} == {bradley_terry.CUT}
    assert bradley_terry.with_scores(none, ranker).count() == 0 and bradley_terry.train(none, labels.where("false")).threshold == 0


# -- queries and pipeline ----------------------------------------------------------------------------------------------------
@tables
@pytest.mark.parametrize("name", ["op4_chat_prefixes", "op6_line_chunks"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from riskloom.llm.queries import ORACLES, QUERIES
    from tests.oracle_check import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF)[0] == "OK"


@tables
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    current = docs
    for name, stage in p.STAGES:
        current = stage(spark, current, SF)
        at[name] = {r["doc_id"]: r for r in current.collect()}
        if name != p.STAGES[-1][0]:
            assert current.columns == docs.columns
            current = spark.createDataFrame(list(at[name].values()), docs.schema)
    order = [n for n, _ in p.STAGES]
    bench = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = at[order[3]]
    assert not any(b in decontaminate.normal(r["text"]) for r in left.values() for b in bench)
    assert all(set(at[b]) <= set(at[a]) for a, b in zip(order, order[1:])) and set(at[order[0]]) == set(at[order[1]]) and set(at[order[3]]) == set(at[order[4]])
    assert len({r["text"] for r in left.values()}) == len(left) and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in at[order[4]].values())
    assert p.run(spark, SF).count() == len(left)


def test_brown_places_every_counted_word_by_its_own_neighbours(spark, monkeypatch):
    """Two kinds of words far rarer than the events, with endings that say nothing, fall apart by what stands beside them; scores are those of
    a plain model with the same classes, also for runs of words outside the head."""
    monkeypatch.setattr(brown, "HEAD_WORDS", 12)
    r = random.Random(8)
    common, rare = {k: [f"{k}{i}" for i in range(5)] for k in "ab"}, {k: [f"{k}word{i}same" for i in range(40)] for k in "ab"}
    texts = [" ".join(r.choice(common[k] * 16 + rare[k]) for _ in range(36)) for k in "ab" for _ in range(60)] + ["aword1same bword2same bword3same"]
    s = brown.Settings(events=10, shapes=4, classes=3, rounds=8)
    model = brown.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), settings=s)
    counts = {x["word"]: (x["n"], x["c"]) for x in model.counts.collect()}
    kinds = [{counts[w][1] for w in rare[k] + common[k]} for k in "ab"]
    assert [len(k) for k in kinds] == [1, 1] and kinds[0] != kinds[1] and counts["\n"][1] == 0
    tokens = [[0, *[counts[w][1] for w in t.split()], 0] for t in texts]
    pair = np.full((3, 3), 0.5)
    for c in tokens:
        np.add.at(pair, (c[:-1], c[1:]), 1)
    step = pair / pair.sum(1, keepdims=True)
    assert np.allclose(model.transition, step)
    n, v = model.tokens, model.types
    got = {x["doc_id"]: x["score"] for x in brown.score(spark.createDataFrame(list(enumerate([*texts, "unseen aword1same", ""])), "doc_id long, text string"), model).collect()}
    spread = [sum(k + 0.5 for k, c in counts.values() if c == d) + 0.5 for d in range(3)]
    unseen = int(model.class_of[s.events + 1 + zlib.crc32(b"een") % s.shapes])
    for i, t in enumerate([*texts, "unseen aword1same", ""]):
        want, at = 0.0, 0
        for w in [*t.split(), "\n"]:
            k, c = counts.get(w, (0, unseen))
            want += math.log10((k + 0.5) * (s.mix * step[at, c] / spread[c] + (1 - s.mix) / (n + 0.5 * (v + 1))))
            at = c
        assert math.isclose(got[i], want, rel_tol=1e-9)
