"""Periodic runs of words by an online sparse diagonal DP.

A run of period q is a stretch on the diagonal "word i equals word i - q". Words are read in order; each word's earlier occurrence
on a diagonal lengthens that lag's active match, and a diagonal that ends is emitted at once if it is long enough. Two exact
prunings keep the table of diagonals sparse. A run of at least `times` periods matches (times - 1) * q words in a row, so lags are
taken in bands [x, y] and an occurrence counts only with its context of L = (times - 1) * x words, y = L // 2. And since L is at
least twice the lag, the nearest earlier occurrence of such a context is the smallest period of the run it lies in (Fine and Wilf),
so each word touches at most one lag a band: n words cost n log n steps at worst, and texts without long repeats stop at the first bands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TIMES = 6, 4
_ROWS = 64


def word_ids(words: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _names(pairs: np.ndarray, size: int) -> np.ndarray:
    """A number for each value that stands more than once, -1 for the others, at its place in an array of `size`; pairs: (place, value)."""
    out = np.full(size, -1, np.int64)
    _, back, count = np.unique(pairs[1], return_inverse=True, return_counts=True)
    again = count[back] > 1
    out[pairs[0][again]] = back[again]
    return out


def _joined(names: np.ndarray, shift: int, n: int) -> np.ndarray:
    """(place, value) of the contexts made of the named one at a place and the one `shift` words on, where both stand more than once."""
    left, right = names[: n], names[shift: shift + n]
    at = np.flatnonzero((left >= 0) & (right >= 0))
    return np.stack((at, left[at] * len(names) + right[at]))


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of smallest period q and length of at least max(least, times * q), by start and period.

    `times` is 3 or more. No words, or too few of them, give no runs.
    """
    n, runs, x = len(ids), [], 1
    names, width = _names(np.stack((np.arange(n), ids)), n), 1
    while times * x <= n and (names >= 0).any():
        context = (times - 1) * x
        while 2 * width <= context:
            names, width = _names(_joined(names, width, n - 2 * width + 1), n), 2 * width
        at, value = _joined(names, context - width, n - context + 1)
        order = np.argsort(value, kind="stable")
        at, value = at[order], value[order]
        lag = at[1:] - at[:-1]
        good = (value[1:] == value[:-1]) & (lag >= x) & (lag <= context // 2)
        at, lag = at[1:][good], lag[good]
        order = np.argsort(at, kind="stable")
        active: dict[int, list[int]] = {}

        def ended(q: int, span: list[int]) -> None:
            length = span[1] - span[0] + context + q
            if length >= max(least, times * q):
                runs.append((span[0] - q, length, q))

        for i, q in zip(at[order].tolist(), lag[order].tolist()):
            span = active.get(q)
            if span is not None and span[1] == i - 1:
                span[1] = i
                continue
            if span is not None:
                ended(q, span)
            active[q] = [i, i]
        for q, span in active.items():
            ended(q, span)
        x = context // 2 + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, deep in zip(words, np.cumsum(edge).tolist()) if not deep]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per input row: id, n_words, runs (array of start, length, period in words), collapsed (the kept words, joined by spaces).

    Null and empty texts have no words, no runs and an empty collapsed text. Ids may be null or repeated; each row is worked out
    by itself, so nothing is shuffled and equal rows give equal rows. An empty table gives no rows. Other columns are not read.
    Memory is bounded by one text: its words and a few arrays of as many numbers.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                b = whole.slice(first, _ROWS)
                counts, found, texts = [], [], []
                for t in b.column(1):
                    words = WORD.findall(t.as_py() or "")
                    runs = find_runs(word_ids(words), least, times)
                    counts.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(" ".join(kept_words(words, runs)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())],
                                                 names=["id", "n_words", "runs", "collapsed"])

    id_type = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return got.withColumnRenamed("id", id_col)
