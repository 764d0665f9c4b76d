"""SimHash near-duplicates: vantage-point trees partition the fingerprints, triangle bounds decide which shards a fingerprint visits.

Hamming distance splits into the distances on disjoint runs of bits. Two fingerprints within `max_bits` are within
`max_bits // parts` on at least one of `parts` runs, so one small tree per run, searched with that small radius, finds every pair.
A node holds a vantage value v and a radius m: fingerprints with d(x, v) <= m go left, the others right, and those of the right
with d(x, v) <= m + r go left as well (triangle bound: a partner on the left is at most r nearer to v). So each pair meets in at
least one leaf, and leaves are compared on whole fingerprints. The trees are grown on a bounded sample and route every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable
from riskloom.llm.components import connected_components

SEED = 42
SAMPLE_ROWS = 16_384
LEAF_ROWS = 4_096
_BLOCK = 1 << 15
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words (A-Z lower-cased, space-joined, repeats included), as unsigned 64-bit numbers."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(tokens) - words + 1)


def fingerprint(text: str | None, words: int = 4, size: int = 1) -> np.ndarray:
    """`size` words of 64 bits; a bit is one if it is set in over half the hashes. No words at all: zero."""
    return fingerprint_of(shingle_hashes(text, words), size)


def fingerprint_of(h: np.ndarray, size: int) -> np.ndarray:
    ones = np.zeros(64 * size, np.int64)
    for i in range(0, len(h), _BLOCK):
        words = [h[i:i + _BLOCK]]
        for k in range(1, size):
            x = words[0] * np.uint64(_MIX[(k - 1) % 3]) + np.uint64(k)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[k % 3])
            words.append(x ^ (x >> np.uint64(32)))
        raw = np.stack(words, 1).astype(">u8").view(np.uint8)
        for j in range(0, len(raw), 255):  # as many ones as a byte counts
            ones += np.unpackbits(raw[j:j + 255], axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, size: int = 1) -> DataFrame:
    """(id, f0..f{size-1}) for every row; null and empty texts have fingerprint zero. Other columns are not read."""
    names = [f"f{k}" for k in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([fingerprint(t.as_py(), words, size) for t in b.column(1)], np.uint64).reshape(-1, size).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(rows[:, k]) for k in range(size)], names=["id"] + names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class Forest:
    """One vantage-point tree per run of bits, grown on a sample; `scale` rows stand behind each row of the sample."""

    def __init__(self, sample: np.ndarray, scale: float, max_bits: int, parts: int, leaf_rows: int = LEAF_ROWS):
        self.parts, self.radius, self.leaves, self.trees = parts, max_bits // parts, 0, []
        edges = [64 * k // parts for k in range(parts + 1)]
        self.masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
        self.ends = []  # the first leaf after each tree
        for mask in self.masks:
            self.trees.append(self._grow(np.sort(sample & np.uint64(mask)), scale, leaf_rows, 0))
            self.ends.append(self.leaves)

    def _grow(self, x: np.ndarray, scale: float, leaf_rows: int, depth: int):
        values = np.unique(x)
        if len(x) * scale <= leaf_rows or len(values) < 2 or depth >= 48:
            self.leaves += 1
            return self.leaves - 1
        best = None
        for v in values[:: max(1, len(values) // 3)][:3]:  # the most even of three vantage values
            d = _bits(x ^ v)
            reach = np.bincount(d, minlength=66).cumsum()
            for m in range(65 - self.radius):
                larger = max(reach[m + self.radius], len(x) - reach[m])
                if reach[m] < len(x) and (best is None or larger < best[0]):
                    best = (larger, int(v), m)
        if best is None or best[0] >= len(x):
            self.leaves += 1
            return self.leaves - 1
        _, v, m = best
        d = _bits(x ^ np.uint64(v))
        return v, m, self._grow(x[d <= m + self.radius], scale, leaf_rows, depth + 1), self._grow(x[d > m], scale, leaf_rows, depth + 1)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, position) for every visit of every fingerprint."""
        leaves, places = [], []
        for mask, tree in zip(self.masks, self.trees):
            part, open_nodes = x & np.uint64(mask), [(tree, np.arange(len(x)))]
            while open_nodes:
                node, at = open_nodes.pop()
                if isinstance(node, int):
                    leaves.append(np.full(len(at), node, np.int32))
                    places.append(at)
                    continue
                v, m, left, right = node
                d = _bits(part[at] ^ np.uint64(v))
                open_nodes += [(left, at[d <= m + self.radius]), (right, at[d > m])]
        return np.concatenate(leaves), np.concatenate(places)


def link_leaf(rows: np.ndarray, max_bits: int, all_bits: int | None = None) -> np.ndarray:
    """For each row of fingerprints the first row of its component within the leaf. Rows link when the first words are within
    `max_bits` and, if `all_bits` is given, all words together within `all_bits`. Needs no list of pairs."""
    n, label = len(rows), np.arange(len(rows))
    first = np.ascontiguousarray(rows[:, 0])
    step = max(1, (1 << 20) // max(1, n))
    for i in range(0, n, step):
        near = np.bitwise_count(first[i:i + step, None] ^ first[None, i:]) <= max_bits
        near[np.arange(len(near)), np.arange(len(near))] = False
        for r in np.flatnonzero(near.any(axis=1)):
            hits = np.flatnonzero(near[r]) + i
            hits = hits[label[hits] != label[i + r]]
            if len(hits) and all_bits is not None and rows.shape[1] > 1:
                hits = hits[np.bitwise_count(rows[hits] ^ rows[i + r]).sum(1, dtype=np.int64) <= all_bits]
            if len(hits):
                joined = np.unique(np.append(label[hits], label[i + r]))
                label[np.isin(label, joined)] = joined[0]
    return label


def link_fingerprints(distinct: DataFrame, cols: list[str], max_bits: int, parts: int, all_bits: int | None = None,
                      sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links (key, root) between the keys of distinct fingerprints (`cols`, and `key`): per leaf each key with its component's first."""
    count = distinct.count()
    part = min(1_000_000, int(1_000_000 * sample_rows / max(1, count)))
    sample = distinct.select(cols[0]).where(F.pmod(F.xxhash64(F.lit("sample"), cols[0]), F.lit(1_000_000)) < part).collect()  # about sample_rows hashes
    forest = Forest(np.array([r[0] for r in sample], np.int64).view(np.uint64), count / max(1, len(sample)), max_bits, parts, leaf_rows)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, at = forest.route(b.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaf)] + [c.take(pa.array(at)) for c in b.columns], names=["leaf", "key"] + cols)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        key = pdf["key"].to_numpy()
        root = key[link_leaf(np.ascontiguousarray(pdf[cols].to_numpy(np.int64)).view(np.uint64), max_bits, all_bits)]
        return pd.DataFrame({"key": key, "root": root})[key != root]

    kind = distinct.schema["key"].dataType.simpleString()
    routed = distinct.select("key", *cols).mapInArrow(visits, f"leaf int, key {kind}, " + ", ".join(f"{c} long" for c in cols))
    return routed.groupBy("leaf").applyInPandas(links, f"key {kind}, root {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, size: int = 1, max_bits: int = 4,
                    parts: int = 3, all_bits: int | None = None) -> DataFrame:
    """One row per input row: id, f0..f{size-1}, component_id (the smallest id reachable over links, the own id included).

    Nulls and empty texts have fingerprint zero and link like any other; rows with a null id take part, a component of null ids
    only has a null component_id. Repeated rows stay repeated. An empty table gives no rows. Columns beside id and text are not
    read, so clashing names do no harm. Only distinct fingerprints are routed: a third of all rows being copies costs one key,
    and joins back over that key split (adaptive skew joins), since each side of them is the direct input of the join.
    """
    cols = [f"f{k}" for k in range(size)]
    prints = durable(fingerprints(docs, id_col, text_col, words, size))
    owners = prints.groupBy(*cols).agg(F.min("id").alias("first_id"))
    owners = durable(owners.withColumn("key", F.col("f0") if size == 1 else F.xxhash64(*cols)))
    links = link_fingerprints(owners, cols, max_bits, parts, all_bits)
    classes = connected_components(links, "key", "root")
    named = classes.withColumnRenamed("node", "key").join(owners.select("key", "first_id"), "key")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    grouped = named.join(smallest, "root").select("key", "component_id")
    whole = owners.join(grouped, "key", "left").select(*cols, F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(whole, cols).select("id", *cols, "component_id")


#: Stage settings: five-word shingles and a similarity of 0.8 or more. 0.8 shared shingles turn 15 to 19 % of the bits. The bits only
#: propose: 13 of 64 in any of four words (one run of seven within 1, as at 12), 76 of all 256.
NEAR = {"words": 5, "similarity": 0.8, "size": 4, "max_bits": 13, "parts": 7, "all_bits": 76}


def shingle_set(text: str | None, words: int) -> np.ndarray:
    h = np.sort(shingle_hashes(text, words))  # np.unique puts the values in a hash table first
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def shingle_prints(docs: DataFrame, words: int, size: int) -> DataFrame:
    """(id, key, n, f0..) for rows (id, t): 64 bits over the whole set of shingles, its size, and the fingerprint of the set (repeats do not count)."""
    names = ["key", "n"] + [f"f{k}" for k in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.zeros((b.num_rows, len(names)), np.int64)
            for r, t in enumerate(b.column(1)):
                own = shingle_set(t.as_py(), words)
                rows[r, 0] = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64)
                rows[r, 1] = len(own)
                rows[r, 2:] = fingerprint_of(own, size).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(rows[:, k]) for k in range(len(names))], names=["id"] + names)

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def size_band(n: np.ndarray, similarity: float) -> np.ndarray:
    """Sets whose sizes allow the similarity are in one band or in neighbouring ones; empty sets have a band of their own."""
    return np.where(n > 0, np.floor(np.log(np.maximum(n, 1)) / -np.log(similarity) + 1e-9), -2).astype(np.int64)


GUEST, SECOND = 1, 2
#: Comparisons made at once, over all rows of a slice and all that they may meet.
CELLS = 1 << 18
#: Rows of like runs of bits that are compared at once with all that are near in that run.
RUN_ROWS = 256
#: Rows of a leaf of the wide search: few large leaves, since a row visits the more of them the smaller they are, and sizes narrow the comparisons.
NEAR_ROWS = 1 << 15
#: Rows of a leaf in a large table, where leaves of `NEAR_ROWS` would send a row to many more of them.
MOST_ROWS = 1 << 17


def near_rows(count: int) -> int:
    """Rows of a leaf of the wide search: a sixteenth of the table, so that there are enough leaves to share out, within the bounds."""
    return min(MOST_ROWS, max(NEAR_ROWS, count // 16))


def run_blocks(own: np.ndarray, mask: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows dealt by their run of bits `mask`, about `RUN_ROWS` or one value at a time: each row once, with all rows whose run is within
    `radius` of one of these. Both in order."""
    values, value, counts = np.unique(own & np.uint64(mask), return_inverse=True, return_counts=True)
    block = (np.cumsum(counts) - 1) // RUN_ROWS
    for k in np.unique(block):
        dealt = block == k
        near = (np.bitwise_count(values[:, None] ^ values[None, dealt]) <= radius).any(axis=1)
        yield np.flatnonzero(dealt[value]), np.flatnonzero(near[value])


def leaf_pairs(own: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, max_bits: int, similarity: float, few: bool,
               wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, run: tuple[int, int] | None = None) -> Iterator[np.ndarray]:
    """(i, j) of rows, ordered by `n`, whose sizes allow the similarity, whose words are within `max_bits`, and whose labels differ; in slices.

    `side` has GUEST for rows of the band below, which do not meet each other here, and SECOND for rows of the second of two blocks; then
    only pairs between the blocks count. `wanted` says which of the pairs (i, j) count at all. `few`: for each i only the nearest j and the
    last of those, enough to join most of a family. `run`: only rows within a radius on a run of bits (its mask, the radius) are compared."""
    cross = bool((side & SECOND).any())
    last = np.searchsorted(n, n / similarity + 1e-9, "right")
    for rows, met in run_blocks(own, *run) if run else [(np.arange(len(own)),) * 2]:
        words, first, after, i = own[met], np.searchsorted(met, rows), np.searchsorted(met, last[rows]), 0
        while i < len(rows):
            width = after[i:i + CELLS] - first[i]  # never falls: later rows reach farther
            step = max(1, int(np.searchsorted(np.arange(1, len(width) + 1) * width, CELLS, "right")))
            start, end = first[i], after[i:i + step][-1]
            near = np.bitwise_count(own[rows[i:i + step], None] ^ words[None, start:end]) <= max_bits
            a, b = np.divmod(np.flatnonzero(near), near.shape[1])  # flat: nonzero is slow on two axes
            a, b = rows[a + i], met[b + start]
            good = (b > a) & (b < last[a]) & (label[a] != label[b]) & ((side[a] & side[b] & GUEST) == 0)
            if cross:
                good &= (side[a] ^ side[b]) & SECOND > 0
            a, b = a[good], b[good]
            if wanted is not None and len(a):
                good = wanted(a, b)
                a, b = a[good], b[good]
            if few and len(a):
                order = np.lexsort((np.bitwise_count(own[a] ^ own[b]), a))
                nearest = order[np.unique(a[order], return_index=True)[1]]
                final = len(a) - 1 - np.unique(a[::-1], return_index=True)[1]
                pick = np.union1d(nearest, final)
                a, b = a[pick], b[pick]
            if len(a):
                yield np.stack((a, b), 1)
            i += step


class Groups:
    """The groups that rows visit: leaves, size bands of those that the sample says hold more than `block_rows` rows, and pairs of blocks of
    bands that still do."""

    def __init__(self, forest: Forest, words: np.ndarray, n: np.ndarray, scale: float, similarity: float, block_rows: int):
        self.forest, self.similarity = forest, similarity
        leaves, counts = np.unique(forest.route(words)[0], return_counts=True)
        self.large = leaves[counts * scale > block_rows]
        codes, counts = np.unique(self._codes(words, n)[0], return_counts=True)
        blocks = np.ceil(counts * scale / block_rows).astype(np.int64)
        self.hot, self.blocks = codes[blocks > 1], blocks[blocks > 1]

    def _codes(self, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf and band as one number, place, side) of every visit. A small leaf is one group; in a large one each row goes to its own
        size band and to the next one as a guest."""
        leaf, at = self.forest.route(words)
        wide = np.isin(leaf, self.large)
        code = leaf.astype(np.int64) * 1024 + np.where(wide, size_band(n, self.similarity)[at] + 2, 1023)
        guests = np.flatnonzero(wide)
        return np.concatenate((code, code[guests] + 1)), np.concatenate((at, at[guests])), np.concatenate((np.zeros(len(at), np.int8), np.full(len(guests), GUEST, np.int8)))

    def visits(self, words: np.ndarray, n: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, place, side) of every visit. In a group of k blocks a row of block i meets every block: k visits."""
        code, at, side = self._codes(words, n)
        k = np.ones(len(code), np.int64)
        if len(self.hot):
            where = np.minimum(np.searchsorted(self.hot, code), len(self.hot) - 1)
            k = np.where(self.hot[where] == code, self.blocks[where], 1)
        block = ((key[at].view(np.uint64) * np.uint64(_MIX[0])) >> np.uint64(33)).astype(np.int64) % k
        other = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        code, at, side, block = (np.repeat(x, k) for x in (code, at, side, block))
        low, high = np.minimum(block, other), np.maximum(block, other)
        return (code << 24) + low * 4096 + high, at, side + np.where((block == high) & (low < high), SECOND, 0).astype(np.int8)


#: Rows that are dealt to groups at a time.
SENT_ROWS = 1 << 13


def larger(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, `rows` or more at a time, less than twice as many: batches may be small for the sake of texts, which these do not have."""
    held = []
    for b in batches:
        for at in range(0, b.num_rows, rows):
            held.append(b.slice(at, rows))
            if sum(x.num_rows for x in held) >= rows:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def _in_groups(nodes: DataFrame, cols: list[str], word: int, max_bits: int, parts: int, all_bits: int, similarity: float, few: bool,
               sample_rows: int, leaf_rows: int | None, block_rows: int | None, leave: Callable, schema: str) -> DataFrame:
    """What `leave` gives for the groups of one forest over word `word` of nodes (key, n, label, cols): a generator over
    (group, key, n, pairs), the rows in order of (n, key), where pairs(skip) gives (i, j) slice by slice and leaves out those that
    skip(i, j) names. A null label is the key. A visit carries all words, so that only pairs that pass every test are given, and a pair
    comes from one place: the first word that proposes it (words before `word` have forests of their own) and, there, the tree of the
    first run of bits in which it is within the radius, where it is sure to meet; rows farther apart in that run are not compared there.

    A large leaf is cut by size bands (no pair is lost: sizes of similar sets differ by at most one band) and what is still large into blocks
    that meet two by two, so a group holds about 2 x `block_rows` rows at any size of table. Rows that leave a task for one group go together, in arrays."""
    count = nodes.count()
    part = min(1_000_000, int(1_000_000 * sample_rows / max(1, count)))
    sample = nodes.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1_000_000)) < part).select(cols[word], "n").collect()  # about sample_rows hashes
    words = np.array([r[0] for r in sample], np.int64).view(np.uint64)
    scale = count / max(1, len(sample))
    leaf_rows = leaf_rows or near_rows(count)
    block_rows = block_rows or max(2 * NEAR_ROWS, leaf_rows)
    forest = Forest(words, scale, max_bits, parts, leaf_rows)
    groups = Groups(forest, words, np.array([r[1] for r in sample], np.int64), scale, similarity, block_rows)
    held = ["key", "n", "label", *cols]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in larger(batches, SENT_ROWS):
            group, at, side = groups.visits(b.column(3 + word).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(0).to_numpy())
            order = np.argsort(group, kind="stable")
            for i in range(0, len(group), 1 << 16):
                some = order[i:i + (1 << 16)]
                first = np.flatnonzero(np.diff(group[some], prepend=-1))  # of each group
                ends, rows = pa.array(np.append(first, len(some)), pa.int32()), pa.array(at[some])
                lists = [pa.ListArray.from_arrays(ends, c) for c in (pa.array(side[some]), *(c.take(rows) for c in b.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(group[some][first]), *lists], names=["grp", "side"] + held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.Table.from_batches(list(batches))
        t = {c: lists[c].combine_chunks().flatten() for c in ["side"] + held}
        key, n = t["key"].to_numpy(), t["n"].to_numpy()
        order = np.lexsort((key, n))
        key, n, side = key[order], n[order], t["side"].to_numpy()[order]
        all_words = [t[c].to_numpy()[order].view(np.uint64) for c in cols]
        own, group = all_words[word], lists["grp"][0].as_py()
        tree = int(np.searchsorted(forest.ends, group >> 34, "right"))
        run = forest.masks[tree], forest.radius
        label = pc.coalesce(t["label"], t["key"]).to_numpy()[order]

        def wanted(a: np.ndarray, b: np.ndarray, skip: Callable | None) -> np.ndarray:
            good = np.ones(len(a), bool) if skip is None else ~skip(a, b)
            d = own[a] ^ own[b]
            for mask in forest.masks[:tree]:
                good &= np.bitwise_count(d & np.uint64(mask)) > forest.radius
            a, b, at = a[good], b[good], np.flatnonzero(good)
            turned = np.zeros(len(a), np.int64)
            fresh = np.ones(len(a), bool)
            for k, w in enumerate(all_words):
                bits = np.bitwise_count(w[a] ^ w[b])
                turned += bits
                if k < word:
                    fresh &= bits > max_bits
            good[at] = fresh & (turned <= all_bits)
            return good

        yield from leave(group, key, n, lambda skip=None: leaf_pairs(own, n, label, side, max_bits, similarity, few, lambda a, b: wanted(a, b, skip), run))

    label = F.when(F.col("label") != F.col("key"), F.col("label")).alias("label")
    routed = nodes.select("key", "n", label, *cols).mapInArrow(visits, "grp long, side array<byte>, " + ", ".join(f"{c} array<long>" for c in held))
    return routed.groupBy("grp").applyInArrow(meet, schema)


def propose(nodes: DataFrame, cols: list[str], word: int, max_bits: int, parts: int, all_bits: int, similarity: float, few: bool,
            sample_rows: int = SAMPLE_ROWS, leaf_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Pairs (a, b) of keys from one forest over word `word` of nodes (key, n, label, cols), all words together within `all_bits`: the list
    itself, which grows with the square of a family. `meetings` gives the rows of it instead."""

    def leave(group: int, key: np.ndarray, n: np.ndarray, pairs: Callable) -> Iterator[pa.RecordBatch]:
        for at in pairs():
            a, b = key[at[:, 0]], key[at[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _in_groups(nodes, cols, word, max_bits, parts, all_bits, similarity, few, sample_rows, leaf_rows, block_rows, leave, "a long, b long").distinct()


#: Bytes of shingle sets in a block; two blocks meet in a task.
SET_BYTES = 8 << 20
#: Words of 64 bits that tell of each of as many hash values whether a set holds an odd number of shingles with it.
ODD_WORDS = 16


def meetings(nodes: DataFrame, cols: list[str], word: int, max_bits: int, parts: int, all_bits: int, similarity: float,
             sample_rows: int = SAMPLE_ROWS, leaf_rows: int | None = None, block_rows: int | None = None, set_bytes: int = SET_BYTES) -> DataFrame:
    """(word, grp, low, high, side, key): where the pairs of `propose` meet. One row for each row of a group that has a partner there, not one
    for each pair. Rows of a group are cut by size into blocks of about `set_bytes` of shingles (low, high: the two blocks that meet,
    side SECOND in the second), and a row is sent to the blocks it has partners in."""

    def leave(group: int, key: np.ndarray, n: np.ndarray, pairs: Callable) -> Iterator[pa.RecordBatch]:
        tile = np.cumsum(8 * n) // set_bytes
        tile = np.unique(tile, return_inverse=True)[1]
        met = np.zeros((len(key), tile[-1] + 1), bool)
        for at in pairs(lambda a, b: met[a, tile[b]] & met[b, tile[a]]):
            a, b = at[:, 0], at[:, 1]
            met[a, tile[b]] = met[b, tile[a]] = True
        some = np.flatnonzero(met.any(axis=1))
        if not len(some):
            return
        block = np.cumsum(np.bincount(tile[some], 8 * n[some], met.shape[1])) // set_bytes  # tiles of which few rows have partners share a block
        block = np.unique(block, return_inverse=True)[1]
        own, key = block[tile[some]], key[some]
        meets = np.stack([met[some][:, block == k].any(axis=1) for k in range(block[-1] + 1)], 1)
        for low in range(block[-1] + 1):
            for high in range(low, block[-1] + 1):
                first, second = (own == low) & meets[:, high], (own == high) & meets[:, low] & (low != high)
                at = np.flatnonzero(first | second)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x, np.int32)) for x in (word, low, high)] + [pa.array(np.full(len(at), group)), pa.array(second[at] * np.int8(SECOND)), pa.array(key[at])],
                                                     names=["word", "low", "high", "grp", "side", "key"])

    return _in_groups(nodes, cols, word, max_bits, parts, all_bits, similarity, False, sample_rows, leaf_rows, block_rows, leave, "word int, low int, high int, grp long, side byte, key long")


def odd_bits(sets: list[np.ndarray], size: int = ODD_WORDS) -> np.ndarray:
    """`size` words for each set. Two sets differ in at least as many shingles as these words differ in bits: what is too far here is too
    far in truth."""
    out = np.zeros((len(sets), 64 * size), np.uint8)
    for r, x in enumerate(sets):
        out[r] = np.bincount((x % np.uint64(64 * size)).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def set_links(sets: list[np.ndarray], own: np.ndarray, all_words: np.ndarray, side: np.ndarray, max_bits: int, all_bits: int, similarity: float) -> list[tuple[int, int]]:
    """Positions (i, j) of links that join what is similar among sets ordered by size: at most one fewer than sets. Pairs within the bits are
    compared exactly, except where other links join them already or the odd bits say that they differ too much."""
    n, label, odd, found = np.array([len(x) for x in sets]), np.arange(len(sets)), odd_bits(sets), []

    def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.bitwise_count(all_words[a] ^ all_words[b]).sum(1, dtype=np.int64) <= all_bits
        at = np.flatnonzero(good)
        for i in range(0, len(at), 1 << 14):
            some = at[i:i + (1 << 14)]
            differ = np.bitwise_count(odd[a[some]] ^ odd[b[some]]).sum(1, dtype=np.int64)
            good[some] = differ <= (n[a[some]] + n[b[some]]) * (1 - similarity) / (1 + similarity) + 1e-6
        return good

    for at in leaf_pairs(own, n, label, side, max_bits, similarity, False, wanted):
        for i, j in at.tolist():
            if label[i] == label[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (n[i] + n[j] - both) - 1e-9:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def similar_links(met: DataFrame, texts: DataFrame, owners: DataFrame, cols: list[str], words: int, max_bits: int, all_bits: int, similarity: float) -> DataFrame:
    """Links (a, b) of keys whose sets of shingles have that Jaccard similarity or more, enough of them to join all that are similar where they
    meet: fewer than rows of `met`. texts(id, t), owners(key, cols, first_id)."""
    needed = met.select("key").distinct().join(owners.select("key", *cols, F.col("first_id").alias("id")), "key")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([shingle_set(t.as_py(), words).tobytes() for t in b.column(len(cols) + 1)], pa.binary())], names=["key", *cols, "s"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        key, held = t["key"].to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in t["s"]]
        order = np.lexsort((key, [len(x) for x in held]))
        key, held, side = key[order], [held[i] for i in order], t["side"].to_numpy()[order]
        all_words = np.stack([t[c].to_numpy()[order].view(np.uint64) for c in cols], 1)
        own = np.ascontiguousarray(all_words[:, t["word"][0].as_py()])
        found = np.array(set_links(held, own, all_words, side, max_bits, all_bits, similarity), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(key[found[:, 0]]), pa.array(key[found[:, 1]])], names=["a", "b"])

    schema = "key long, " + ", ".join(f"{c} long" for c in cols)
    whole = texts.join(needed, "id").select("key", *cols, "t").dropDuplicates(["key"]).mapInArrow(sets, schema + ", s binary")
    return met.join(whole, "key").groupBy("word", "grp", "low", "high").applyInArrow(links, "a long, b long")


def similar_components(docs: DataFrame, words: int, similarity: float, size: int, max_bits: int, parts: int, all_bits: int) -> DataFrame:
    """(id, component_id) for rows (id, t): components over all proposed pairs whose shingle sets have the similarity.

    No list of pairs is made: rows with partners meet again with their sets, and what leaves a meeting are fewer links than rows.
    """
    cols = [f"f{k}" for k in range(size)]
    prints = durable(shingle_prints(docs, words, size))
    owners = durable(prints.groupBy("key", "n", *cols).agg(F.min("id").alias("first_id")))
    alone, met = owners.withColumn("label", F.col("key")), None
    for k in range(size):
        more = durable(meetings(alone, cols, k, max_bits, parts, all_bits, similarity))  # one word after another
        met = more if met is None else met.unionByName(more)
    links = similar_links(met, docs, owners, cols, words, max_bits, all_bits, similarity)
    classes = connected_components(links, "a", "b").select(F.col("node").alias("key"), F.col("root"))
    named = durable(owners.select("key", "first_id").join(classes, "key", "left").withColumn("root", F.coalesce("root", "key")))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.select("id", "key").join(named.select("key", "root").join(smallest, "root"), "key").select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of `docs` (all their columns) that stand first in their component, one for each component.

    Rows link where their sets of five-word shingles have a Jaccard similarity of 0.8 or more; fingerprints only propose pairs.
    First is the smallest (id, text hash), null ids last. Rows that repeat both count as copies too: one of them stays. Only ids,
    hashes and the shingles of proposed pairs go through the search.
    """
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    found = similar_components(docs.select(key.alias("id"), F.col(text_col).alias("t")), **{**NEAR, **settings})
    best = found.groupBy("component_id").agg(F.sum((F.col("id") == F.col("component_id")).cast("long")).alias("__rows"))
    best = durable(best.select(F.to_json("component_id", {"ignoreNullFields": "false"}).alias("__key"), "__rows"))
    met = docs.withColumn("__key", F.to_json(key, {"ignoreNullFields": "false"})).join(best, "__key")
    once = met.where("__rows = 1").select(*docs.columns)
    again = met.where("__rows > 1").dropDuplicates(["__key"]).select(*docs.columns)
    return once.unionByName(again)
