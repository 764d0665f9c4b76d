"""Keyword retrieval."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.blocks import BLOCK_CHARS, blocks_of
from riskloom.functions.ranking import top_n

TOKENS_KEPT, CANDIDATES_KEPT = 100_000, 100_000
FIELDS = (("title", 10), ("tags", 5), ("cwe_ids", 8))
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


class _Matcher:
    """Points of one block of queries for a document, in one pass over its distinct tokens."""

    def __init__(self, queries: list[tuple]):
        self.n = len(queries)
        words: dict[str, list[tuple[int, int]]] = {}
        whole: dict[str, list[int]] = {}
        for k, (_id, q) in enumerate(queries):
            counted = Counter(w for w in _SPACE.split(q) if w)
            for w, times in counted.items():
                words.setdefault(w, []).append((k, times))
            if counted:
                whole.setdefault(q, []).append(k)
        self.postings = [np.array(p, np.int64).T for p in words.values()]
        self.words, self.whole, self.seen = ahocorasick.Automaton(), ahocorasick.Automaton(), {}
        for i, w in enumerate(words):
            self.words.add_word(w, i)
        for q, ks in whole.items():
            self.whole.add_word(q, ks)
        self.empty = not words
        if not self.empty:
            self.words.make_automaton()
            self.whole.make_automaton()

    def _in_token(self, token: str) -> tuple[int, ...]:
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) >= TOKENS_KEPT:
                self.seen.clear()
            got = self.seen[token] = tuple({i for _, i in self.words.iter(token)})
        return got

    def points(self, content: str | None, fields: list[tuple[int, list]]) -> np.ndarray:
        found = {i for token in set(_SPACE.split(content or "")) if token for i in self._in_token(token)}
        out = np.zeros(self.n, np.int64)
        if found:
            q, times = np.concatenate([self.postings[i] for i in found], axis=1)
            out += np.bincount(q, times, self.n).astype(np.int64)
        for worth, values in fields:
            inside = {k for v in values if v for _, ks in self.whole.iter(v) for k in ks}
            if inside:
                out[list(inside)] += worth
        return out


def _best(rows: list[tuple], k: int) -> list[tuple]:
    """The first k rows (query, points, id) of each query: most points first, then the smallest id."""
    rows.sort(key=lambda r: (r[0], -r[1], r[2] is not None, r[2] if r[2] is not None else 0))
    seen: Counter = Counter()
    kept = []
    for r in rows:
        if seen[r[0]] < k:
            seen[r[0]] += 1
            kept.append(r)
    return kept


def retrieve_docs(queries: DataFrame, docs: DataFrame, k: int = 5, category: str | None = None, severity: str | None = None,
                  language: str | None = None) -> DataFrame:
    """(query_id, doc_id, score): the k best documents per query.

    +10 when the title holds the query, +5 for a tag, +8 for a CWE, +1 per query word in the text (a repeated word counts
    again). queries(query_id, text); docs(doc_id, title, tags, cwe_ids, content, ...). Every document is read once per block of
    queries; tasks keep the k best per query, so that tasks x queries x k rows are shuffled at most, never queries x documents.
    """
    if category:
        docs = docs.where(F.col("category") == category)
    if severity:
        docs = docs.where(F.col("severity") == severity)
    if language:
        docs = docs.where(F.exists("tags", lambda t: F.lower(t).contains(language.lower())))
    fields = [(f, worth) for f, worth in FIELDS if f in docs.columns]
    lists = [F.transform(F.array("title") if f == "title" else F.col(f), lambda x: F.lower(x)).alias(f) for f, _ in fields]
    texts = docs.select("doc_id", F.lower("content").alias("content"), *lists)
    qid, did = (d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (docs, "doc_id")))
    out = None
    for block in blocks_of(queries.select("query_id", F.lower("text").alias("q")).where("q IS NOT NULL"), "q", BLOCK_CHARS):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher, held, least = _Matcher(sent.value), [], np.ones(len(sent.value), np.int64)
            id_type = None
            for b in batches:
                id_type = b.column(0).type
                if matcher.empty:
                    continue
                for i, own in enumerate(b.column(0).to_pylist()):
                    got = matcher.points(b.column(1)[i].as_py(), [(worth, b.column(2 + j)[i].as_py() or []) for j, (_f, worth) in enumerate(fields)])
                    held += [(q, int(got[q]), own) for q in np.flatnonzero(got >= least).tolist()]
                    if len(held) > CANDIDATES_KEPT + len(least) * k:
                        held, full = _best(held, k), Counter()
                        for q, points, _own in held:
                            full[q] += 1
                            if full[q] == k:
                                least[q] = points
            if held:
                q, points, ids = zip(*_best(held, k))
                names = [sent.value[x][0] for x in q]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids, id_type), pa.array(points, pa.int64())], names=["query_id", "doc_id", "score"])

        part = texts.mapInArrow(run, f"query_id {qid}, doc_id {did}, score long")
        out = part if out is None else out.unionByName(part)
    return top_n(out, k, [F.col("score").desc(), F.col("doc_id")], by=["query_id"])
