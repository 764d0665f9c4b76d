"""Line de-duplication by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines chooses chunk ends, so an insertion moves only the chunks it touches. Chunks
of at least two filled lines that occur more than once anywhere are compared byte for byte; all but the first occurrence go.

Chunk ends are sparse, so chunks alone miss most passages of a few lines. `dedup_passages` finds every repeated run of lines of more
than `over` words: from each line the shortest run forwards, and to each line the shortest run backwards, with more than `over`
words. Such a run depends on its own lines only, so it is the same wherever the passage stands, and together the runs inside a
passage cover all its filled lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable

DIVISOR = 4
MULTIPLIER = 31


def cut_lines(text: str, divisor: int = DIVISOR) -> list[list[str]]:
    """The lines of a text in chunks; a chunk ends after a line where (hash before * 31 + hash) is a multiple of `divisor`.

    A line's hash is the first 32 bits of its MD5; before the first line it is 0.
    """
    out, chunk, before = [], [], 0
    for line in text.split("\n"):
        own = int.from_bytes(hashlib.md5(line.encode()).digest()[:4], "big")
        chunk.append(line)
        if (before * MULTIPLIER + own) % divisor == 0:
            out.append(chunk)
            chunk = []
        before = own
    if chunk:
        out.append(chunk)
    return out


def _filled(chunk: list[str]) -> int:
    return sum(1 for line in chunk if line.strip(" \t\r"))


def _chunks(docs: DataFrame, key: Column, text_col: str, with_body: bool, divisor: int, least: int) -> DataFrame:
    """(key, chunk, sig[, body]) of the chunks that can go."""
    source = docs.select(key.alias("key"), F.col(text_col).alias("t"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, chunk int, sig string" + (", body string" if with_body else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                place, number, sigs, bodies = [], [], [], []
                for i, t in enumerate(b.column(1)[at:at + 1024]):
                    for k, chunk in enumerate(cut_lines(t.as_py(), divisor) if t.is_valid else []):
                        if _filled(chunk) >= least:
                            body = "\n".join(chunk)
                            place.append(at + i)
                            number.append(k)
                            sigs.append(hashlib.md5(body.encode()).hexdigest())
                            bodies.append(body)
                cols = [b.column(0).take(pa.array(place, pa.int64())), pa.array(number, pa.int32()), pa.array(sigs, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(bodies, pa.string())] if with_body else []), names=["key", "chunk", "sig"] + ["body"] * with_body)

    return source.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, least: int = 2) -> DataFrame:
    """`docs` with repeated chunks cut out of the text, and `removed_chunks`, `removed_lines` (long, 0 if none).

    The first occurrence is the smallest (id, text hash, chunk number), null ids last. Rows with the same id and the same text
    count as one document and are treated alike. Null texts stay null; a text may become empty, its row stays. An empty table
    gives no rows; other columns pass, but columns named like the new ones are replaced. A chunk shared by a third of all rows
    is one key: counts and firsts are combined before the shuffle, and the joins on it have one row on the other side.
    """
    kept = [c for c in docs.columns if c not in ("removed_chunks", "removed_lines")]
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    narrow = durable(_chunks(docs, key, text_col, False, divisor, least))
    often = narrow.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
    bodies = _chunks(docs, key, text_col, True, divisor, least).join(often, "sig").groupBy("sig", "body").agg(F.min(F.struct("key", "chunk")).alias("first"))
    alike = bodies.groupBy("sig").agg(F.count("*").alias("c"), F.min("first").alias("first")).where("c = 1")  # bytes compared: one body for the signature
    gone = narrow.join(alike.select("sig", "first"), "sig").where(~F.struct("key", "chunk").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("key").alias("__key")).agg(F.collect_set("chunk").alias("__gone"))
    joined = docs.select(*kept, key.alias("__key")).join(gone, "__key", "left").drop("__key")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + ["removed_chunks long", "removed_lines long"])
    at_text = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, chunks, lines = [], [], []
            for t, drop in zip(b.column(at_text), b.column(b.num_columns - 1)):
                drop = set(drop.as_py() or ())
                if not t.is_valid or not drop:
                    texts.append(t.as_py())
                    chunks.append(0)
                    lines.append(0)
                    continue
                cut = cut_lines(t.as_py(), divisor)
                texts.append("\n".join([line for k, c in enumerate(cut) if k not in drop for line in c]))
                chunks.append(len(drop))
                lines.append(sum(len(cut[k]) for k in drop))
            cols = list(b.columns[:-1])
            cols[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols + [pa.array(chunks, pa.int64()), pa.array(lines, pa.int64())], names=kept + ["removed_chunks", "removed_lines"])

    return joined.mapInArrow(run, schema)


OVER_WORDS = 50


def spans(lines: list[str], over: int = OVER_WORDS, divisor: int = DIVISOR, least: int = 2) -> list[tuple[int, int]]:
    """(first line, line after the last) of the chunks of `least` filled lines and of the shortest runs of more than `over` words
    that start, or end, at each filled line."""
    words = [len(x.split()) for x in lines]
    out, at, upto, ends = set(), 0, [0], len(lines)
    for chunk in cut_lines("\n".join(lines), divisor):
        if _filled(chunk) >= least:
            out.add((at, at + len(chunk)))
        at += len(chunk)
    for n in words:
        upto.append(upto[-1] + n)
    end = start = 0
    for i in range(ends):
        if words[i]:
            while end < ends and upto[end] - upto[i] <= over:
                end += 1
            if upto[end] - upto[i] > over:
                out.add((i, end))
            while upto[i + 1] - upto[start + 1] > over:
                start += 1
            if upto[i + 1] - upto[start] > over:
                out.add((start, i + 1))
    return sorted(out)


def _spans(docs: DataFrame, key: Column, text_col: str, over: int, divisor: int, least: int) -> DataFrame:
    """(key, a, b, sig): lines a to b (b not included), signed by 128 bits over the hashes of their lines."""
    source = docs.select(key.alias("key"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                place, first, after, sigs = [], [], [], []
                for i, t in enumerate(b.column(1)[at:at + 256]):
                    lines = t.as_py().split("\n") if t.is_valid else []
                    own = [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines]
                    for a, z in spans(lines, over, divisor, least):
                        place.append(at + i)
                        first.append(a)
                        after.append(z)
                        sigs.append(hashlib.blake2b(b"".join(own[a:z]), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int64())), pa.array(first, pa.int32()), pa.array(after, pa.int32()), pa.array(sigs, pa.binary())],
                                                 names=["key", "a", "b", "sig"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, a int, b int, sig binary")


def _without(text: str, gone: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of the spans, and how many went. Blank lines between two lines that go, go too."""
    lines = text.split("\n")
    drop = bytearray(len(lines))
    for a, z in gone:
        drop[a:z] = b"\1" * (z - a)
    last, blank = None, 0  # whether the last filled line goes; blank lines since
    for i, line in enumerate(lines):
        if drop[i] or line.strip(" \t\r"):
            if drop[i] and last is not False:
                drop[i - blank:i] = b"\1" * blank
            last, blank = bool(drop[i]), 0
        else:
            blank += 1
    if last and blank:
        drop[-blank:] = b"\1" * blank
    return "\n".join([line for line, d in zip(lines, drop) if not d]), sum(drop)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", over: int = OVER_WORDS, divisor: int = DIVISOR, least: int = 2) -> DataFrame:
    """`docs` with repeated passages cut out of the text, and `removed_lines` (long, 0 if none): what `dedup_lines` cuts, and every
    run of whole lines of more than `over` words that stands somewhere before, whatever surrounds it.

    Order, rows and nulls are as in `dedup_lines`. Where a passage overlaps its own first occurrence, that one stays whole; every
    line that goes stands earlier, so nothing is lost. Equal means equal line hashes of 128 bits.
    """
    kept = [c for c in docs.columns if c != "removed_lines"]
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    found = durable(_spans(docs, key, text_col, over, divisor, least))
    firsts = found.groupBy("sig").agg(F.count("*").alias("c"), F.min(F.struct("key", "a", "b")).alias("first")).where("c > 1").select("sig", "first")
    same = F.col("key").eqNullSafe(F.col("first.key"))
    again = found.join(firsts, "sig").withColumn("a", F.when(same, F.greatest("a", "first.b")).otherwise(F.col("a"))).where("a < b")
    gone = again.groupBy(F.col("key").alias("__key")).agg(F.collect_set(F.struct("a", "b")).alias("__gone"))
    joined = docs.select(*kept, key.alias("__key")).join(gone, "__key", "left").drop("__key")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + ["removed_lines long"])
    at_text = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines = [], []
            for t, drop in zip(b.column(at_text), b.column(b.num_columns - 1)):
                text, n = t.as_py(), 0
                if text is not None and drop.is_valid:
                    text, n = _without(text, [(x["a"], x["b"]) for x in drop.as_py()])
                texts.append(text)
                lines.append(n)
            cols = list(b.columns[:-1])
            cols[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols + [pa.array(lines, pa.int64())], names=kept + ["removed_lines"])

    return joined.mapInArrow(run, schema)
