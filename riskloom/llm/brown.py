"""Language-model scores by Brown classes: exchange clustering puts words into classes; a text's probability is that of its class
transitions times that of each word within its class, mixed with the word's own share.

What the driver keeps is bounded by parameters, what the model counts is not: every training word is counted, has a class of its own
bigrams, and is looked up exactly when scoring. The `events` commonest words are exchanged one by one, together with `shapes` groups of
the others by their last three bytes. Then every other counted word leaves its group for the class under which its own neighbours,
all its occurrences, are likeliest; class bigrams are counted anew over the whole training text. A group's class is left only to words
that no training text holds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable

END = "\n"  # no word holds a line break
HEAD_WORDS, HEAD_BYTES = 131_072, 64
FLUSH = 250_000
GAP = 255  # in a sequence of classes: a word whose class comes from the whole table


@dataclass
class Settings:
    events: int = 2_048
    shapes: int = 512
    classes: int = 48
    rounds: int = 12
    mix: float = 0.9
    add: float = 0.5


@dataclass
class Model:
    """Bounded by Settings and HEAD_WORDS. `head` and `events` hold counts of the commonest words and their places in `class_of`, which after
    the first `events` + 1 has the shapes' classes; `counts` is the whole table in Spark: word, n, c (its class)."""

    settings: Settings
    tokens: int
    types: int
    head: dict
    events: dict
    class_of: np.ndarray
    transition: np.ndarray
    spread: np.ndarray
    counts: DataFrame


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts (binary column t); every text also ends in one END. Counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for b in batches:
            for t in b.column(0):
                seen.update(_words(t.as_py()))
                if len(seen) > FLUSH:
                    yield out()
            seen[END.encode()] += b.num_rows
        if seen:
            yield out()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _event_ids(words: list[bytes], events: dict, first_shape: int, shapes: int) -> np.ndarray:
    crc = zlib.crc32
    return np.fromiter((events[w] if w in events else first_shape + crc(w[-3:]) % shapes for w in words), np.int64, len(words))


def count_bigrams(texts: DataFrame, events: dict, s: Settings) -> DataFrame:
    """(pair, n): left event * size + right event, texts framed by END (event 0). At most size squared rows, size = events + shapes + 1."""
    size = s.events + s.shapes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def out() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for b in batches:
            for t in b.column(0):
                ids = np.concatenate(([0], _event_ids(_words(t.as_py()), events, s.events + 1, s.shapes), [0]))
                held.append(ids[:-1] * size + ids[1:])
                rows += len(held[-1])
                if rows > 4_000_000:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-12)), 0.0)


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, size: int, classes: int, rounds: int) -> np.ndarray:
    """Class of each event: every event in turn, the commonest first, moves to the class that raises the likelihood of the class
    bigrams most, until a round moves few or `rounds` are over. Event 0, the end, keeps class 0 to itself."""
    order = np.argsort(left, kind="stable")
    after_of, after_n, after_at = right[order], n[order].astype(float), np.searchsorted(left[order], np.arange(size + 1))
    order = np.argsort(right, kind="stable")
    before_of, before_n, before_at = left[order], n[order].astype(float), np.searchsorted(right[order], np.arange(size + 1))
    weight = np.bincount(left, n, size)
    itself = np.bincount(left[left == right], n[left == right], size)
    by_weight = [w for w in np.argsort(-weight, kind="stable").tolist() if w and weight[w]]
    class_of = np.ones(size, np.int64)
    class_of[by_weight] = 1 + np.arange(len(by_weight)) % (classes - 1)
    class_of[0] = 0
    pair = np.bincount(class_of[left] * classes + class_of[right], n, classes * classes).reshape(classes, classes)
    total = np.bincount(class_of, weight, classes)
    for _ in range(rounds):
        moved = 0
        for w in by_weight:
            own, self_n = class_of[w], itself[w]
            a, b = slice(after_at[w], after_at[w + 1]), slice(before_at[w], before_at[w + 1])
            after = np.bincount(class_of[after_of[a]], after_n[a], classes)
            before = np.bincount(class_of[before_of[b]], before_n[b], classes)
            after[own] -= self_n
            before[own] -= self_n
            pair[own] -= after
            pair[:, own] -= before
            pair[own, own] -= self_n
            total[own] -= weight[w]
            held = _xlogx(pair)
            row, col, corner = _xlogx(pair + after) - held, _xlogx(pair + before[:, None]) - held, pair.diagonal()
            gain = (row.sum(1) - row.diagonal() + col.sum(0) - col.diagonal() + _xlogx(corner + after + before + self_n) - _xlogx(corner)
                    - 2 * (_xlogx(total + weight[w]) - _xlogx(total)))
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            moved += best != own
            class_of[w] = best
            pair[best] += after
            pair[:, best] += before
            pair[best, best] += self_n
            total[best] += weight[w]
        if moved <= size // 200:
            break
    return class_of


def neighbours(texts: DataFrame, events: dict, class_of: np.ndarray, s: Settings) -> DataFrame:
    """(word, code, n), lists that count the classes beside the occurrences of a word that is no event: before it (class) and after it
    (classes + class). One row for a word from each piece of a task, at most 2 * classes codes in it."""
    sent = texts.sparkSession.sparkContext.broadcast((events, class_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events, class_of = sent.value
        wide = 2 * s.classes
        ids: dict = {}
        held: list[np.ndarray] = []
        rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(codes, np.arange(len(ids) + 1) * wide).astype(np.int32)  # ids have come in order, each with codes
            words, codes = pa.array([w.decode() for w in ids], pa.string()), (codes % wide).astype(np.int32)
            for i in range(0, len(words), 1 << 14):
                at = ends[i:i + (1 << 14) + 1]
                inside = slice(at[0], at[-1])
                lists = [pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(x[inside].astype(np.int32))) for x in (codes, n)]
                yield pa.RecordBatch.from_arrays([words[i:i + (1 << 14)], *lists], names=["word", "code", "n"])
            ids.clear()
            held.clear()

        for b in batches:
            for t in b.column(0):
                words = _words(t.as_py())
                c = class_of[np.concatenate(([0], _event_ids(words, events, s.events + 1, s.shapes), [0]))]
                at = [i for i, w in enumerate(words) if w not in events]
                if not at:
                    continue
                own = np.fromiter((ids.setdefault(words[i], len(ids)) for i in at), np.int64, len(at)) * wide
                held += [own + c[at], own + s.classes + c[np.array(at) + 2]]
                rows += len(at)
                if rows > 1_000_000 or len(ids) > FLUSH:
                    yield from out()
                    rows = 0
        if held:
            yield from out()

    return texts.mapInArrow(run, "word string, code array<int>, n array<int>")


def place(beside: DataFrame, log_step: np.ndarray, log_total: np.ndarray) -> DataFrame:
    """(word, c): the class, never that of the end, under which all occurrences of the word among their neighbours are likeliest."""
    k = len(log_total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4_096):
                b = whole.slice(i, 4_096)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy())
                seen = np.bincount(row * 2 * k + b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy().astype(float), b.num_rows * 2 * k).reshape(-1, 2 * k)
                before, after = seen[:, :k], seen[:, k:]
                gain = before @ log_step + after @ log_step.T - before.sum(1)[:, None] * log_total[None, :]
                gain[:, 0] = -np.inf
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gain.argmax(1).astype(np.int32))], names=["word", "c"])

    whole = beside.groupBy("word").agg(F.flatten(F.collect_list("code")).alias("code"), F.flatten(F.collect_list("n")).alias("n"))
    return whole.mapInArrow(run, "word string, c int")


def in_classes(docs: DataFrame, head: dict, events: dict, class_of: np.ndarray, counts: DataFrame, s: Settings) -> DataFrame:
    """(row, id, n_tokens, n_known, s, seq, gaps) for rows (id, t): classes of the text's words between two ends, one byte each, with gaps for
    words outside the head; `gaps` lists their classes and positions, met in the whole table. s: sum of log10(count + add)."""
    kind, add, end_count = docs.schema["id"].dataType.simpleString(), s.add, head.get(END.encode(), 0)
    sent = docs.sparkSession.sparkContext.broadcast({w: (int(class_of[events[w]]), float(np.log10(n + add))) for w, n in head.items()})
    schema = f"row long, word string, id {kind}, pos array<int>, tokens long, known long, counted double, seq binary"
    end_rate = float(np.log10(end_count + add))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, none = sent.value, (GAP, 0.0)
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows, words_out, ids, flat, ends, tokens, known, counted, seqs = ([] for _ in range(9))
                for row, own, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    words = _words(t.as_py())
                    found = [known_words.get(w, none) for w in words]
                    seq = bytes([0, *[x[0] for x in found], 0])
                    rest: dict = {}
                    for i in np.flatnonzero(np.frombuffer(seq, np.uint8) == GAP).tolist():
                        rest.setdefault(words[i - 1], []).append(i)
                    for w, places in rest.items():
                        flat += places
                        ends.append(len(flat))
                    rows += [row] * (len(rest) + 1)
                    words_out += [w.decode() for w in rest]
                    words_out.append(f"{END}{row}")  # meets no word
                    for column, empty, value in ((ids, None, own), (tokens, 0, len(words) + 1), (known, 0, len(words) - sum(map(len, rest.values())) + (end_count > 0)),
                                                 (counted, 0.0, sum([x[1] for x in found], end_rate)), (seqs, None, seq)):
                        column += [empty] * len(rest)
                        column.append(value)
                    ends.append(len(flat))
                pos = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat, pa.int32()))
                kinds = [(rows, pa.int64()), (words_out, pa.string()), (ids, b.column(1).type), (pos, None), (tokens, pa.int64()), (known, pa.int64()), (counted, pa.float64()), (seqs, pa.binary())]
                yield pa.RecordBatch.from_arrays([x if k is None else pa.array(x, k) for x, k in kinds], names=names)

    passed = docs.select(F.monotonically_increasing_id().alias("row"), "id", "t").mapInArrow(run, schema)
    met = passed.join(counts, "word", "left")
    n, tf = F.coalesce("n", F.lit(0)), F.size("pos")
    shapes = F.array(*[F.lit(int(c)) for c in class_of[s.events + 1:s.events + 1 + s.shapes]])
    c = F.coalesce("c", F.get(shapes, F.pmod(F.crc32(F.expr("substring(encode(word, 'UTF-8'), -3, 3)")), F.lit(s.shapes)).cast("int")))
    return met.groupBy("row").agg(F.max("id").alias("id"), F.sum("tokens").alias("n_tokens"), F.sum(F.col("known") + F.when(n > 0, tf).otherwise(0)).alias("n_known"),
                                  F.sum(F.col("counted") + F.when(tf > 0, tf * F.log10(n + add)).otherwise(0.0)).alias("s"), F.first("seq", ignorenulls=True).alias("seq"),
                                  F.collect_list(F.when(tf > 0, F.struct(c.alias("c"), "pos"))).alias("gaps"))


def _steps(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, next class, row) for every step of every text of a batch of `in_classes`, the steps to its first word and to its end included."""
    seq, gaps = b.column(b.schema.get_field_index("seq")).to_pylist(), b.column(b.schema.get_field_index("gaps"))
    sizes = np.array([len(x) for x in seq], np.int64)
    start, x = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(seq), np.uint8).copy()
    row, flat = np.repeat(np.arange(len(seq)), pc.list_value_length(gaps).to_numpy()), gaps.flatten()
    c, pos = flat.field("c").to_numpy(), flat.field("pos")
    n = pc.list_value_length(pos).to_numpy()
    x[np.repeat(start[row], n) + pos.flatten().to_numpy()] = np.repeat(c, n)
    inside = np.ones(len(x), bool)
    inside[start + sizes - 1] = False
    at = np.flatnonzero(inside)
    return x[at], x[at + 1], np.repeat(np.arange(len(seq)), sizes - 1)


def count_steps(classed: DataFrame, classes: int) -> np.ndarray:
    """Bigrams of classes over all texts of `in_classes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes**2, np.int64)
        for b in batches:
            left, right, _ = _steps(b)
            total += np.bincount(left.astype(np.int64) * classes + right, minlength=classes**2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes**2)), pa.array(total)], names=["pair", "n"])

    got = classed.select("seq", "gaps").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return np.bincount(got["pair"].to_numpy(), got["n"].to_numpy(), classes**2).reshape(classes, classes)


def train(docs: DataFrame, text_col: str = "text", settings: Settings | None = None) -> Model:
    """Learns from every row of `docs`. Null texts count as empty. No rows: an empty model, whose scores follow from no counts."""
    s = settings or Settings()
    if s.classes >= GAP:
        raise ValueError(f"fewer than {GAP} classes")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    counts = durable(count_words(texts))
    tokens, types = counts.agg(F.sum("n"), F.count("*")).first()
    short, step = F.octet_length("word") <= HEAD_BYTES, F.floor(F.log2("n") * 64)  # counts in at most 4,096 steps
    room, least = HEAD_WORDS, None
    for r in sorted(counts.where(short).groupBy(step.alias("k")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["k"]
    common = (F.col("word") == END) | (short & (step >= least if least is not None else F.lit(False)))
    top = counts.where(common).toArrow()  # at most HEAD_WORDS + 1 words, 8 MB
    head = {w.encode(): n for n, w in sorted(zip(top["n"].to_pylist(), top["word"].to_pylist()), key=lambda x: (-x[0], x[1]))}
    chosen = [w for w in head if w != END.encode()][: s.events]
    events = {w: k + 1 for k, w in enumerate(chosen)} | {END.encode(): 0}
    size = s.events + s.shapes + 1
    got = count_bigrams(texts, events, s).toArrow()
    pairs, n = got["pair"].to_numpy(), got["n"].to_numpy()
    left, right = (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)
    del got, pairs, top
    class_of = exchange(left, right, n, size, s.classes, s.rounds)
    pair = np.bincount(class_of[left] * s.classes + class_of[right], n, s.classes**2).reshape(s.classes, s.classes)
    step = np.log((pair + s.add) / (pair.sum(1, keepdims=True) + s.add * s.classes))
    placed = place(neighbours(texts, events, class_of, s), step, np.log(pair.sum(0) + s.add))
    kinds = spark.createDataFrame([(w.decode(), int(class_of[k])) for w, k in events.items()], "word string, e int")  # at most `events` + 1 rows
    counts = durable(counts.join(placed, "word", "left").join(F.broadcast(kinds), "word", "left").select("word", "n", F.coalesce("e", "c").alias("c")))
    own = counts.where(common).select("word", "c").toArrow()  # the head again
    own = dict(zip(own["word"].to_pylist(), own["c"].to_pylist()))
    later = [w for w in head if w not in events]
    events |= {w: size + k for k, w in enumerate(later)}
    class_of = np.append(class_of, np.array([own[w.decode()] for w in later], np.int64))
    pair = count_steps(in_classes(texts.select(F.lit(0).alias("id"), "t"), head, events, class_of, counts, s), s.classes)
    transition = (pair + s.add) / (pair.sum(1, keepdims=True) + s.add * s.classes)
    spread = np.full(s.classes, s.add)
    for c, n, v in counts.groupBy("c").agg(F.sum("n"), F.count("*")).collect():
        spread[c] = n + s.add * (v + 1)
    return Model(s, tokens or 0, types or 0, head, events, class_of, transition, spread, counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score per input row (log10 over the whole text and its end).

    A word's count and class come from the bounded head or, for the rest, from a join with the whole table; rows that repeat a word meet it
    once. Null and empty texts have one token, the end. Repeated rows each give a row; other columns are not read.
    """
    s, kind = model.settings, docs.schema[id_col].dataType.simpleString()
    whole = model.tokens + s.add * (model.types + 1)
    logs = np.log10(s.mix * model.transition / model.spread[None, :] + (1 - s.mix) / whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right, row = _steps(b)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.bincount(row, logs[left, right], b.num_rows))], names=["id", "n_tokens", "n_known", "s", "m"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    classed = in_classes(texts, model.head, model.events, model.class_of, model.counts, s)
    sums = classed.select("id", "n_tokens", "n_known", "s", "seq", "gaps").mapInArrow(run, f"id {kind}, n_tokens long, n_known long, s double, m double")
    return sums.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
                       (F.col("s") - F.col("n_tokens") * float(np.log10(whole))).alias("base_score"), (F.col("s") + F.col("m")).alias("score"))
