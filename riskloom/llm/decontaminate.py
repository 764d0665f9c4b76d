"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by up to `budget` edits. Cut into budget + 1 pieces, at least one piece then stands in the
passage unchanged: an Aho-Corasick automaton finds the pieces in one pass over the document, and Myers' bit-parallel distance
verifies the windows around the hits. Matching ignores case and the kind and amount of white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, LEAST_EDITS, LEAST_PIECE = 0.06, 6, 11
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int) -> int:
    """Edits allowed for an item of this many characters: 6 %, at least 6, as long as pieces have 11 characters or more."""
    return max(0, min(max(LEAST_EDITS, round(RATE * length)), length // LEAST_PIECE - 1))


def pieces(item: str) -> list[tuple[int, str]]:
    """budget + 1 pieces that cover the item, each with its offset."""
    n = budget(len(item)) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the part of `text` nearest to `pattern` in edits, the first of equals (Myers 1999, one word of any length)."""
    m = len(pattern)
    full, top, at = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(d | up)), up & d
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
                if not best:
                    break
        rise, fall = rise << 1, fall << 1
        up, down = full & (fall | ~(x | rise)), rise & x & full
    return best, end


class Matcher:
    """Finds items of one block of the benchmark in documents."""

    def __init__(self, items: list[tuple]):
        import ahocorasick

        self.items = [(i, n) for i, n in ((i, normal(t)) for i, t in items) if n]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str | None, first_only: bool = False) -> list[tuple]:
        """(item id, distance, budget) of the items that the text holds; an item below 22 characters must stand between blanks."""
        text = normal(text)
        if not text or not self.items:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                length = len(self.items[k][1])
                edits = budget(length)
                start = last + 1 - size - offset
                windows.setdefault(k, []).append((max(0, start - edits), min(len(text), start + length + edits)))
        out = []
        for k, spans in windows.items():
            item, pattern = self.items[k]
            allowed = budget(len(pattern))
            if not allowed:
                if f" {pattern} " in f" {text} " or (len(pattern) >= 2 * LEAST_PIECE and pattern in text):
                    out.append((item, 0, 0))
            else:
                best, (a, b), joined = allowed + 1, spans[0], []
                for s, e in sorted(spans)[1:]:
                    if s <= b:
                        a, b = min(a, s), max(b, e)
                    else:
                        joined.append((a, b))
                        a, b = s, e
                for s, e in [*joined, (a, b)]:
                    best = min(best, nearest(pattern, text[s:e])[0])
                    if not best:
                        break
                if best <= allowed:
                    out.append((item, best, allowed))
            if out and first_only:
                break
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of about `block_chars` characters; only one block at a time is held and sent to the tasks."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row and item in it: id, item, distance (edits, the least found), budget.

    Null and empty texts and items match nothing; repeated documents and items each give their rows; an empty table on either
    side gives no rows. Other columns are not read. A benchmark beyond `block_chars` characters is matched block by block.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, distance int, budget int"
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for b in batches:
                rows = [(i, *hit) for i, t in enumerate(b.column(1)) for hit in matcher.find(t.as_py())]
                if rows:
                    place, item, distance, allowed = zip(*rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int64())), pa.array(item), pa.array(distance, pa.int32()), pa.array(allowed, pa.int32())],
                                                     names=[id_col, item_col, "distance", "budget"])

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item. Same rules as `contaminated`; nothing is shuffled."""
    at = docs.columns.index(text_col)
    out = docs
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(t.as_py(), first_only=True) for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
