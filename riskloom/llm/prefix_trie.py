"""Prefix trie of conversations, with prefix digests screened by a count-min sketch before anything is grouped.

A prefix digest is the sum, lane by lane, of the digests of (place, role, text) over its turns, so it comes from running sums and a
very long conversation is summed in blocks. The sketch never estimates too little: an estimate of one proves that no other
conversation has that prefix, and then none has a longer one. Such tails are finished where they are. Only prefixes whose
parent may be shared are shuffled and grouped on the whole digest (128 bits and the depth).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskloom.functions.durable import durable
from riskloom.functions.ranking import numbered

#: Turns of one conversation that a window holds at a time, conversation ids in one text of a member list, most nodes broadcast as hot.
BLOCK, IDS, HOT_NODES = 4_096, 512, 10_000
#: Sketch: rows, and bounds of the cells in a row (one byte each): at most 4 x 16 million bytes are broadcast at any size of table.
SKETCH_ROWS, LEAST_CELLS, MOST_CELLS = 4, 1 << 12, 1 << 24
_PIECE = 1 << 12
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
KEY = ["depth", "ka", "kb"]
LANES = ["l0", "l1", "l2", "l3"]


def digest_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, said, chars): each turn's place (from 1), the digest of its role and text, and its code points.

    Null roles and texts are empty. Turns stand by turn number, null first; equal numbers by digest, and repeated rows all stay.
    Rows with a null conversation id are no conversation and take no part. Texts do not move: only digests are sorted, and places
    come from counts of (conversation, run of turn numbers, turn number), so one conversation may hold most of the rows.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    at = F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**63)))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.floor(at / BLOCK).cast("long").alias("_run"), at.alias("_at"),
                                                         F.col(turn_col).isNotNull().alias("_is"), said.alias("said"), F.length(text).cast("long").alias("chars"))
    placed = numbered(rows, ["conv"], ["_run", "_at"], ["_is", "said"], "pos", keep=False)
    return placed.select("conv", F.col("pos").cast("long").alias("pos"), "said", "chars")


def running(df: DataFrame, key: str, at: str, values: list[str], down: bool = False) -> DataFrame:
    """`df` with each of `values` replaced by its inclusive running sum within `key` over `at` (backwards with `down`).

    Blocks of 4,096 places are summed by themselves and then the blocks' totals, so that no task needs a whole key."""
    block = F.floor(F.col(at) / BLOCK).cast("long")
    rows = df.withColumn("_block", block)
    turn = (lambda c: F.col(c).desc()) if down else F.col
    inner = W.partitionBy(key, "_block").orderBy(turn(at)).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(key).orderBy(turn("_block")).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_block").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    before = totals.select(key, "_block", *[F.coalesce(F.sum(f"_t{v}").over(outer), F.lit(0)).alias(f"_b{v}") for v in values])
    summed = rows.select(*[c for c in rows.columns if c not in values], *[F.sum(v).over(inner).alias(v) for v in values])
    return summed.join(before, [key, "_block"]).select(*[(F.col(c) + F.col(f"_b{c}")).alias(c) if c in values else F.col(c) for c in df.columns])


def _packed(a: Column, b: Column) -> Column:
    return F.shiftleft(F.pmod(a, F.lit(2**32)), 32).bitwiseOR(F.pmod(b, F.lit(2**32)))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, ka, kb, pa, pb, chars, last) for every prefix of every conversation, the empty one included; p is the parent's digest.

    turns(conv, pos, said, chars) with places from 1 without gaps; convs(conv, n) has every conversation once, also one without turns."""
    own = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("said")))
    lane = [F.conv(F.substring("_d", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    each = turns.withColumn("_d", own).select("conv", "pos", "chars", *[c.alias(n) for n, c in zip(LANES, lane)], *[c.alias(f"o{n}") for n, c in zip(LANES, lane)])
    upto = running(each, "conv", "pos", LANES)
    now = [F.col(n) for n in LANES]
    old = [F.col(n) - F.col(f"o{n}") for n in LANES]
    rows = upto.select("conv", F.col("pos").alias("depth"), _packed(now[0], now[1]).alias("ka"), _packed(now[2], now[3]).alias("kb"),
                       _packed(old[0], old[1]).alias("pa"), _packed(old[2], old[3]).alias("pb"), "chars")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), zero.alias("pa"), zero.alias("pb"), zero.alias("chars"), (F.col("n") == 0).alias("last"))
    return rows.join(convs, "conv").withColumn("last", F.col("depth") == F.col("n")).drop("n").unionByName(roots)


class CountMin:
    """Counts by `SKETCH_ROWS` hashes, each cell stopping at 255: never below the true count (up to 255)."""

    def __init__(self, cells: int, table: np.ndarray | None = None):
        self.cells = cells
        self.table = np.zeros(SKETCH_ROWS * cells, np.uint8) if table is None else table

    def places(self, depth: np.ndarray, ka: np.ndarray, kb: np.ndarray) -> list[np.ndarray]:
        x = ka.view(np.uint64) ^ (kb.view(np.uint64) * np.uint64(_MIX[0])) ^ depth.view(np.uint64)
        out = []
        for k in range(SKETCH_ROWS):
            y = (x + np.uint64(k + 1)) * np.uint64(_MIX[k])
            y = (y ^ (y >> np.uint64(31))) * np.uint64(_MIX[(k + 1) % 4])
            out.append(((y ^ (y >> np.uint64(29))) & np.uint64(self.cells - 1)).astype(np.int64) + k * self.cells)
        return out

    def add(self, *digest: np.ndarray) -> None:
        for at in self.places(*digest):
            cell, count = np.unique(at, return_counts=True)
            self.table[cell] = np.minimum(self.table[cell].astype(np.int64) + count, 255)

    def estimate(self, *digest: np.ndarray) -> np.ndarray:
        return np.min([self.table[at] for at in self.places(*digest)], axis=0)


def _digest(b: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(n)).to_numpy() for n in names]


def sketch(paths: DataFrame, cells: int) -> CountMin:
    """The sketch of all prefix digests. Tasks send the pieces they have touched; equal pieces are added up in parallel."""
    pieces = SKETCH_ROWS * cells // _PIECE

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CountMin(cells)
        for b in batches:
            own.add(*_digest(b, KEY))
        cut = own.table.reshape(pieces, _PIECE)
        used = np.flatnonzero(cut.any(axis=1))
        for i in range(0, len(used), 256):
            part = used[i:i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([cut[p].tobytes() for p in part], pa.binary())], names=["piece", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, summed = None, None
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                if p != piece:
                    if piece is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([summed.astype(np.uint8).tobytes()], pa.binary())], names=["piece", "cells"])
                    piece, summed = p, np.zeros(_PIECE, np.int64)
                summed = np.minimum(summed + np.frombuffer(c.as_py(), np.uint8), 255)
        if piece is not None:
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([summed.astype(np.uint8).tobytes()], pa.binary())], names=["piece", "cells"])

    kind = "piece long, cells binary"
    table = np.zeros((pieces, _PIECE), np.uint8)
    added = paths.select(*KEY).mapInArrow(fill, kind).repartition("piece").sortWithinPartitions("piece").mapInArrow(total, kind)
    for r in added.toLocalIterator():
        table[r["piece"]] = np.frombuffer(r["cells"], np.uint8)
    return CountMin(cells, table.reshape(-1))


def screened(paths: DataFrame, counts: CountMin) -> DataFrame:
    """`paths` with `alone`: the parent prefix is proved to belong to one conversation only, so this one does too."""
    held, cells = paths.sparkSession.sparkContext.broadcast(counts.table), counts.cells

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = CountMin(cells, held.value)
        for b in batches:
            depth, a, c = _digest(b, ["depth", "pa", "pb"])
            alone = (depth > 0) & (seen.estimate(depth - 1, a, c) == 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(alone)], names=[*b.schema.names, "alone"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema) + ", alone boolean"
    return paths.mapInArrow(ask, kinds)


def join_nodes(rows: DataFrame, nodes: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join in which the nodes that more than total / 10,000 rows ask for, so at most 10,000 of them, are broadcast."""
    hot = F.broadcast(nodes.where(F.col(weight) > total // HOT_NODES))
    cold = nodes.where(F.col(weight) <= total // HOT_NODES)
    rest = rows.join(hot.select(*on), on, "left_anti").join(cold, on)
    return rows.join(hot, on).unionByName(rest)


def member_hashes(ends: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256) over rows (depth, ka, kb, conv): SHA-256 of the ids in ascending order, joined by commas.

    Ids are first joined in runs of 512 possible ids, in parallel; a node's runs then pass one after another through one hash, so
    a node at which a third of all conversations end costs one stream of text and no memory."""
    run = F.floor(F.col("conv") / IDS).cast("long")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    runs = ends.groupBy(*KEY, run.alias("run")).agg(ids.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in key] + [pa.array([state.hexdigest()])], names=[*KEY, "ends_sha256"])

        for b in batches:
            for *now, ids in zip(*[c.to_pylist() for c in b.columns]):
                if now != key:
                    if key is not None:
                        yield row()
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield row()

    streamed = runs.repartition(*KEY).sortWithinPartitions(*KEY, "run").select(*KEY, "ids")
    return streamed.mapInArrow(hashed, "depth long, ka long, kb long, ends_sha256 string")


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of turns(conv, pos, said, chars) over convs(conv), whose ids are distinct and not null:

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes below it,
    itself included), saved_tokens (over its subtree, (n_convs - 1) times the code points of the node's last text) and
    ends_sha256 (of the ids that end here). Conversations without turns are members of the root; no conversations, no rows.
    A prefix shared by most conversations is one hot node: it is counted on the map side, and asked back by broadcast.
    """
    counted = turns.groupBy("conv").agg(F.count("*").alias("n"))
    known = convs.select("conv").join(counted, "conv", "left").select("conv", F.coalesce("n", F.lit(0)).alias("n"))
    paths = durable(prefixes(turns, known))
    total = paths.count()
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (8 * total).bit_length()))
    marked = screened(paths, sketch(paths, cells))
    zero, none = F.lit(0).cast("long"), F.sha2(F.lit(""), 256)
    own_hash = F.sha2(F.col("conv").cast("string"), 256)
    tails = marked.where("alone").select(F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                                         F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                                         zero.alias("saved_tokens"), F.when(F.col("last"), own_hash).otherwise(none).alias("ends_sha256"))

    maybe = durable(marked.where("NOT alone").drop("alone"))
    grouped = maybe.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"),
                                      F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("chars").alias("chars"))
    grouped = durable(grouped)
    below = grouped.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("_below"))
    # a node of one conversation that goes on, but not among these, is the top of a proved tail: its one child is emitted above
    tail = (F.col("n_convs") == 1) & (F.col("n_ends") == 0) & F.col("_below").isNull()
    nodes = durable(grouped.join(below, KEY, "left").select(*grouped.columns, tail.alias("tail"), F.coalesce("_below", tail.cast("long")).alias("n_children")))

    asked = join_nodes(maybe.select("conv", *KEY, "last"), nodes.select(*KEY, "conv_id", "n_convs", "n_children", "chars", "tail"), KEY, "n_convs", maybe.count())
    first = F.col("conv") == F.col("conv_id")
    # each conversation answers for the nodes of which it is the smallest member, and for the leaf it ends in
    leaf = F.col("tail") | (first & F.col("last") & (F.col("n_children") == 0))
    weighed = asked.select("conv", *KEY, F.when(first, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).alias("saved_tokens"), leaf.cast("long").alias("n_leaves"))
    sums = running(weighed, "conv", "depth", ["saved_tokens", "n_leaves"], down=True)
    trees = sums.groupBy(*KEY).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    parents = nodes.select(F.col("depth").alias("pd"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("asked"))
    rows = nodes.where("depth > 0").withColumn("pd", F.col("depth") - 1)
    under = join_nodes(rows, parents, ["pd", "pa", "pb"], "asked", rows.count())
    roots = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    placed = under.select(*roots.columns).unionByName(roots)
    ends = member_hashes(maybe.where("last").select(*KEY, "conv"))
    shared = placed.join(trees, KEY).join(ends, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    return shared.unionByName(tails)
