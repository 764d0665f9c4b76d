"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, as flat neighbour arrays; results merge.

Equal vectors are one point of the index that carries the smallest ids of its copies, so a vector shared by a third of all rows is
one node. Points are dealt to shards of about `shard_rows` by hash. A graph is built level by level from the top, points inserted
in batches: a beam search finds candidates, the diversity rule picks neighbours, back links are pruned by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.durable import durable

SHARD_ROWS, LINKS, BUILD_BEAM, BEAM, QUERY_BLOCK = 4_096, 16, 64, 128, 2_048


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...d,...d->...", d, d)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(points, squared distances) of the `beam` nearest met from `start` (and from `also`), per query, nearest first; -1 and inf where there are fewer.

    All queries take their steps together: each expands its nearest open point until none of its beam is open.
    """
    n = len(q)
    who = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, np.float32)
    shut = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for empty places
    rows = np.arange(n)
    for k, first in enumerate((start, also) if beam > 1 and also is not None else (start,)):
        new = ~seen[rows, first]
        who[new, k], far[new, k], shut[new, k] = first[new], _squares(x[first[new]], q[new]), False
        seen[rows, first] = True
    while len(rows):
        open_far = np.where(shut[rows], np.inf, far[rows])
        pick = open_far.argmin(1)
        alive = np.isfinite(open_far[np.arange(len(rows)), pick])
        rows, pick = rows[alive], pick[alive]
        if not len(rows):
            break
        shut[rows, pick] = True
        near = links[who[rows, pick]]
        safe = np.maximum(near, 0)
        new = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        d = np.where(new, _squares(x[safe], q[rows][:, None, :]), np.inf).astype(np.float32)
        all_far = np.concatenate((far[rows], d), 1)
        best = np.argsort(all_far, 1, kind="stable")[:, :beam]
        far[rows] = np.take_along_axis(all_far, best, 1)
        who[rows] = np.take_along_axis(np.concatenate((who[rows], np.where(new, near, -1)), 1), best, 1)
        shut[rows] = np.take_along_axis(np.concatenate((shut[rows], ~new), 1), best, 1)
    return np.where(np.isfinite(far), who, -1), far


def choose(x: np.ndarray, who: np.ndarray, far: np.ndarray, keep: int) -> np.ndarray:
    """Neighbours out of candidates sorted by distance: those nearer to the point than to any chosen one, then the nearest others."""
    n, width = who.shape
    v = x[np.maximum(who, 0)]
    norm = np.einsum("ncd,ncd->nc", v, v)
    apart = norm[:, :, None] + norm[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    valid = who >= 0
    least, taken, count = np.full((n, width), np.inf), np.zeros((n, width), bool), np.zeros(n, int)
    for c in range(width):
        ok = valid[:, c] & (count < keep) & (far[:, c] < least[:, c])
        taken[:, c] = ok
        count += ok
        least = np.where(ok[:, None], np.minimum(least, apart[:, c, :]), least)
    rank = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), 1, kind="stable")[:, :keep]
    out = np.take_along_axis(np.where(valid, who, -1), rank, 1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1) if out.shape[1] < keep else out


def _insert(x: np.ndarray, links: np.ndarray, points: np.ndarray, starts: np.ndarray, beam: int) -> None:
    """Links `points` into the graph `links` (changed in place); `starts` are points already in it."""
    keep = links.shape[1] - 1  # the last column is for bridges
    who, far = beam_search(x, links, x[points], starts, beam)
    inside = _squares(x[points][:, None, :], x[points][None, :, :]).astype(np.float32)
    np.fill_diagonal(inside, np.inf)
    k = min(keep, len(points) - 1)
    if k > 0:  # points of one batch also see each other
        mates = np.argpartition(inside, k - 1, 1)[:, :k]
        who = np.concatenate((who, points[mates]), 1)
        far = np.concatenate((far, np.take_along_axis(inside, mates, 1)), 1)
        order = np.argsort(far, 1, kind="stable")
        who, far = np.take_along_axis(who, order, 1), np.take_along_axis(far, order, 1)
    mine = choose(x, who, far, max(1, keep // 2))
    links[points, : mine.shape[1]] = mine
    a, b = np.repeat(points, mine.shape[1]), mine.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.lexsort((_squares(x[a], x[b]), b))
    a, b = a[order], b[order]
    place = np.arange(len(b)) - np.searchsorted(b, b)
    a, b, place = a[place < keep], b[place < keep], place[place < keep]
    targets, at = np.unique(b, return_inverse=True)
    extra = np.full((len(targets), keep), -1, np.int64)
    extra[at, place] = a
    for i in range(0, len(targets), 512):
        t = targets[i:i + 512]
        held = links[t, :keep]
        who = np.concatenate((held, np.where((extra[i:i + 512, :, None] == held[:, None, :]).any(2), -1, extra[i:i + 512])), 1)
        far = np.where(who >= 0, _squares(x[np.maximum(who, 0)], x[t][:, None, :]), np.inf).astype(np.float32)
        order = np.argsort(far, 1, kind="stable")
        links[t, :keep] = choose(x, np.take_along_axis(who, order, 1), np.take_along_axis(far, order, 1), keep)


def _bridge(x: np.ndarray, links: np.ndarray, members: np.ndarray, top: int, beam: int) -> None:
    """Pruning may cut points off; each then gets a link from a near point that can be reached, in that point's last column."""
    while True:
        met = np.zeros(len(x), bool)
        edge = np.array([top])
        while len(edge):
            met[edge] = True
            edge = np.unique(links[edge])
            edge = edge[(edge >= 0)]
            edge = edge[~met[edge]]
        lost = members[~met[members]]
        if not len(lost):
            return
        who, _ = beam_search(x, links, x[lost[:64]], np.full(len(lost[:64]), top), beam)
        for u, near in zip(lost, who):
            if met[u]:
                continue
            near = near[near >= 0]
            free = near[links[near, -1] < 0]
            if len(free):
                links[free[0], -1] = u
            else:  # every near point has its bridge: follow the chain of bridges to its end
                p = near[0] if len(near) else top
                while links[p, -1] >= 0:
                    p = links[p, -1]
                links[p, -1] = u
            met[u] = True  # bridges lead from points that can be reached to points that could not, so they form chains, and each round ends some


def build(x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top: (members, neighbours). Neighbours are rows of `x`, -1 where there are fewer; level 0 holds all points."""
    n = len(x)
    x = x.astype(np.float32)
    height = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 8)
    height[0] = max(1, height.max())
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(int(height[0]), -1, -1):
        members = np.flatnonzero(height >= level)
        members = members[np.lexsort((members, -height[members]))]  # those of the level above come first
        graph = np.full((n, links * (2 if level == 0 else 1) + 1), -1, np.int64)
        done = 1
        while done < len(members):
            batch = members[done:done + min(256, max(1, done))]
            starts = descend(x, levels, x[batch], members[0])
            starts = np.where(np.isin(starts, members[:done]), starts, members[0])
            _insert(x, graph, batch, starts, beam)
            done += len(batch)
        _bridge(x, graph, members, members[0], beam)
        members = np.sort(members)
        levels.append((members, graph[members] if level else graph))
    return levels


class Frame:
    """The vectors of a shard centred and scaled in double precision, so that large values and common offsets keep their order in float32.
    Queries are put into the same frame; one that lies very far outside is drawn in along its direction."""

    FAR = 1e4

    def __init__(self, x: np.ndarray):
        self.size = float(np.abs(x).max()) or 1.0
        y = x.astype(np.float64) / self.size
        self.centre = y.mean(0)
        self.spread = float(np.sqrt(((y - self.centre) ** 2).sum(1)).max()) or 1.0

    def place(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.clip((v.astype(np.float64) / self.size - self.centre) / self.spread, -1e150, 1e150)
            norm = np.sqrt((y ** 2).sum(1, keepdims=True))
            return np.where(norm > self.FAR, y * (self.FAR / np.maximum(norm, 1e-300)), y).astype(np.float32)


def merged(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, node of each row): rows that are equal in float32 are one node."""
    _, first, node = np.unique(x, axis=0, return_index=True, return_inverse=True)
    return x[first], node.reshape(-1)


def _full(level: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    members, rows = level
    if len(rows) == n:
        return rows
    out = np.full((n, rows.shape[1]), -1, np.int64)
    out[members] = rows
    return out


def descend(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, top: int = 0) -> np.ndarray:
    """The point that a narrow search through the levels above ends at, for each query."""
    at = np.full(len(q), top, np.int64)
    for level in levels:
        who, _ = beam_search(x, _full(level, len(x)), q, at, 4)
        at = who[:, 0]
    return at


def search(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Up to `beam` points per query, nearest first, -1 where there are fewer."""
    x, q = x.astype(np.float32), q.astype(np.float32)
    top = np.zeros(len(q), np.int64)  # point 0 stands on every level, and every point can be reached from it
    return beam_search(x, _full(levels[-1], len(x)), q, descend(x, levels[:-1], q), beam, top)[0]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim) of rows with an id and a vector that is not null, empty or zero and holds only finite components."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))


def _matrix(column, dtype) -> np.ndarray:
    return np.array([np.frombuffer(c, dtype) for c in column])


def index_vectors(points: DataFrame, k: int, dtype: str, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The index (shard, dim, x, ids, ends, node, levels) with one row per shard and dimension, and the number of shards.

    x holds the vectors, `ids` the smallest k + 1 ids of each, ending at `ends`, and `node` the node of the graph that stands for each;
    levels is an array of (members, width, neighbours) of nodes.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # equal vectors meet per batch first, each with its smallest ids
            rows = pd.DataFrame({"v": [np.array(v.values, dtype).tobytes() for v in b.column(1)], "id": b.column(0).to_numpy()})
            rows = rows.drop_duplicates().sort_values("id").groupby("v", sort=False).head(k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(rows["v"], pa.binary()), pa.array(rows["id"], pa.int64())], names=["v", "id"])

    packed = points.select("id", F.transform("v", lambda c: c + F.lit(0).cast("float" if dtype == "<f4" else "double")).alias("v")).mapInArrow(pack, "v binary, id long")
    first = packed.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = durable(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))  # k + 1 ids at most
    shards = max(1, -(-distinct.count() // shard_rows))
    width = 4 if dtype == "<f4" else 8

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        x = _matrix(pdf["v"], dtype)
        nodes, node = merged(Frame(x).place(x))
        levels = [{"members": m.astype("<i4").tobytes(), "width": g.shape[1], "neighbours": g.astype("<i4").tobytes()} for m, g in build(nodes)]
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], "x": [x.tobytes()], "ids": [np.concatenate(list(pdf["ids"])).astype("<i8").tobytes()],
                             "ends": [np.cumsum([len(i) for i in pdf["ids"]]).astype("<i4").tobytes()], "node": [node.astype("<i4").tobytes()], "levels": [levels]})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("dim", (F.octet_length("v") / width).cast("int"))
    index = dealt.groupBy("shard", "dim").applyInPandas(make, "shard int, dim int, x binary, ids binary, ends binary, node binary, levels array<struct<members: binary, width: int, neighbours: binary>>")
    return durable(index), shards


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision) of the k nearest found for each query.

    `queries` has the columns of `vectors`. Candidates are all usable rows of `vectors` of the query's dimension with another id;
    ties go to the smaller id; fewer candidates give fewer rows. Rows with unusable vectors or null ids take no part; rows that
    repeat id and vector count once. Every query visits every shard, in blocks; a block and a shard meet in one group.
    """
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    index, shards = index_vectors(usable(vectors, id_col, vec_col), k, dtype, shard_rows)
    asked = usable(queries, id_col, vec_col).dropDuplicates(["id", "v"])
    blocks = max(1, -(-asked.count() // query_block))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        row = left.iloc[0]
        dim = int(row["dim"])
        x = np.frombuffer(row["x"], dtype).reshape(-1, dim)
        ids, ends = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i4")
        starts = np.concatenate(([0], ends[:-1]))
        levels = [(np.frombuffer(lv["members"], "<i4").astype(np.int64), np.frombuffer(lv["neighbours"], "<i4").astype(np.int64).reshape(-1, lv["width"])) for lv in row["levels"]]
        q = np.stack([np.asarray(v, dtype) for v in right["v"]])
        frame, node, out = Frame(x), np.frombuffer(row["node"], "<i4"), []
        by_node = np.argsort(node, kind="stable")
        first = np.searchsorted(node[by_node], np.arange(node.max() + 2))
        nodes, placed = frame.place(x)[by_node[first[:-1]]], frame.place(q)
        for at in range(0, len(q), 256):
            for own, v, near in zip(right["id"].to_numpy()[at:at + 256], q[at:at + 256], search(nodes, levels, placed[at:at + 256], beam)):
                near = near[near >= 0]
                if not len(near):
                    continue
                points = np.concatenate([by_node[first[i]:first[i + 1]] for i in near])
                d = np.sqrt(((x[points].astype(np.float64) - v.astype(np.float64)) ** 2).sum(1))
                owners = [ids[starts[p]:ends[p]] for p in points]
                got, score = np.concatenate(owners), np.repeat(d, [len(o) for o in owners])
                got, score = got[got != own], score[got != own]
                best = np.lexsort((got, score))[:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": got[best], "score": score[best]}))
        return pd.concat(out) if out else empty

    found = (left.groupBy("shard", "dim", "block").cogroup(right.groupBy("shard", "dim", "block")).applyInPandas(run, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
