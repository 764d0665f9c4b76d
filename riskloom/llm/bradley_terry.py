"""Quality classifier by Bradley-Terry pairwise ranking.

Every pair of a document labelled 1 and one labelled 0 is a preference; a linear score is learnt by logistic loss on the
difference of the two feature vectors. The threshold is the quantile of the training scores at the share of label 0, and scores
are squashed so that this quantile stands at `cut`. Every labelled row takes part: means, scales and the threshold are exact over all of
them, and the weights are the mean of what groups of bounded size learn (parameter mixing), worked out in Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable
from riskloom.functions.joins import growing
from riskloom.llm.html_text import STOP_WORDS

GROUP_ROWS = 6_000
UNIT = float(1 << 20)
CUT = 0.3
_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"*#%$&@~^=+<>_|\\/", b"\"'()[]{}-`")
_N = len(_KINDS) + 2  # the others: bytes of non-ASCII characters, control bytes
_KIND = np.full(256, _N - 1, np.int32)
_KIND[128:] = _N - 2
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k
_STOPS = frozenset(w.encode() for w in STOP_WORDS)
N_FEATURES = _N**3 + _N + 12


def features(text: str | None) -> np.ndarray:
    """Shares of character kinds and of their runs of three, and measures of words and lines, over the whole text."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES, np.float32)
    if not raw:
        return out
    runs, kinds = np.zeros(_N**3, np.int64), np.zeros(_N, np.int64)
    data = np.frombuffer(raw, np.uint8)
    for i in range(0, len(data), 1 << 20):
        k = _KIND[data[i:i + (1 << 20) + 2]]
        kinds += np.bincount(k[:1 << 20], minlength=_N)
        if len(k) > 2:
            runs += np.bincount((k[:-2] * _N + k[1:-1]) * _N + k[2:], minlength=_N**3)
    out[:_N**3] = np.log1p(1000.0 * runs / len(data))
    out[_N**3:_N**3 + _N] = np.sqrt(kinds / len(data))
    words, lines = raw.lower().split(), raw.split(b"\n")
    n = max(1, len(words))
    distinct = set(words)
    plain = [w.strip(b".,;:!?\"'()*#%$&|") for w in words]
    filled = [x for x in lines if x.strip()]
    out[_N**3 + _N:] = (np.log1p(len(data)), np.log1p(n), sum(map(len, words)) / n / 10, len(distinct) / n, sum(w in _STOPS for w in plain) / n,
                        sum(p != w for p, w in zip(plain, words)) / n, np.log1p(len(lines)), len(set(filled)) / max(1, len(filled)),
                        np.log1p(len(data) / len(lines)), max(map(len, words), default=0) > 40, np.log1p(n / max(1, len(distinct))), sum(len(w) < 3 for w in words) / n)
    return out


class Ranker:
    """Linear Bradley-Terry scores; `score` is in 0..1, `cut` is the value of the threshold quantile."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, cut: float = CUT):
        self.mean, self.scale, self.weights, self.threshold, self.cut = mean, scale, weights, threshold, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.raw(x).astype(np.float64) - self.threshold, -30, 30) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-z))


def moments(rows: Iterable[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and sums of squares of feature rows, in whole units of 2**-20, so that no order of adding changes them."""
    n, total, squares = 0, np.zeros(N_FEATURES, np.int64), np.zeros(N_FEATURES, np.int64)
    for x in rows:
        units = np.rint(np.frombuffer(x, np.float32).astype(np.float64) * UNIT)
        n, total, squares = n + 1, total + units.astype(np.int64), squares + np.rint(units * units / UNIT).astype(np.int64)
    return n, total, squares


def descend(z: np.ndarray, y: np.ndarray, steps: int = 1_500, pairs: int = 256, rate: float = 0.02, decay: float = 2e-3, seed: int = 7) -> np.ndarray:
    """Adam on random preference pairs of scaled rows that hold both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w, m, v, rng = np.zeros(z.shape[1]), 0.0, 0.0, np.random.default_rng(seed)
    for t in range(1, steps + 1):
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        g = decay * w - d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) / pairs
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _pack(x: np.ndarray) -> bytes:
    """Places and values of what is not zero."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n, out = len(raw) // 6, np.zeros(N_FEATURES, np.float32)
    out[np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw[2 * n:], np.float32, n)
    return out


def _at_rank(scores: DataFrame, rank: int) -> float:
    """The score of a rank (from 0) among all, found by the upper and then the lower half of its float32 bits: two counts of at most 65,536 groups."""
    low, part = 0, scores
    for shift in (16, 0):
        counts = part.groupBy(F.shiftright("bits", shift).alias("k")).count().collect()
        for k, n in sorted((r["k"], r["count"]) for r in counts):
            if rank < n:
                break
            rank -= n
        low, part = k, part.where(F.shiftright("bits", shift) == k)
    return float(_from_bits(np.array([low], np.int64))[0])


def _to_bits(x: np.ndarray) -> np.ndarray:
    """float32 as whole numbers of the same order."""
    b = (x.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64)
    return np.where(b < 0, -(b & 0x7FFFFFFF), b)


def _from_bits(b: np.ndarray) -> np.ndarray:
    return np.where(b < 0, -b | -0x80000000, b).astype(np.int32).view(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", group_rows: int = GROUP_ROWS, cut: float = CUT) -> Ranker:
    """Learns from every labelled row. Null ids and labels other than 0 and 1 do not count; an id with both labels takes the lower.

    Means, scales and the threshold come from all rows. Rows are dealt by their hash to groups of about `group_rows`, each group descends on its
    own pairs, and the weights are the mean of the groups' weights by their rows; groups without both labels have no pairs.
    Without both labels anywhere weights stay zero and every score equals `cut`.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("y"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(growing(known), "__id").select("t", F.col("y").cast("int").alias("y"), F.xxhash64("__id", "t").alias("h"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([pa.array([_pack(features(t.as_py())) for t in part.column(0)], pa.binary()), part.column(1), part.column(2)], names=["x", "y", "h"])

    kept = durable(rows.mapInArrow(read, "x binary, y int, h long"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = moments(_unpack(x.as_py()).tobytes() for b in batches for x in b.column(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (n, total.tobytes(), squares.tobytes())], names=["n", "total", "squares"])

    sums = kept.select("x").mapInArrow(add, "n long, total binary, squares binary").collect()  # 22 KB a task
    of = {r["y"]: r["count"] for r in kept.groupBy("y").count().collect()}
    n, bad = sum(of.values()), of.get(0, 0)
    if not bad or bad == n:
        return Ranker(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), np.zeros(N_FEATURES, np.float32), 0.0, cut)
    total, squares = (sum(np.frombuffer(r[c], np.int64) for r in sums) / UNIT for c in ("total", "squares"))
    mean = total / n
    scale = (np.sqrt(np.maximum(squares / n - mean * mean, 0)) + 1e-3).astype(np.float32)
    mean = mean.astype(np.float32)
    groups = max(1, -(-n // group_rows))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["x", "y"])
        y = part["y"].to_numpy()
        if not (y == 0).any() or not (y == 1).any():
            return pd.DataFrame({"g": [], "n": [], "w": []}, dtype=object)
        z = np.clip((np.stack([_unpack(x) for x in part["x"]]) - mean) / scale, -8, 8)
        return pd.DataFrame({"g": [int(part["g"].iloc[0])], "n": [len(y)], "w": [descend(z, y).tobytes()]})

    dealt = kept.withColumn("g", F.pmod("h", F.lit(groups)).cast("int"))
    learnt = sorted((r["g"], r["n"], r["w"]) for r in dealt.groupBy("g").applyInPandas(learn, "g int, n long, w binary").collect())  # 11 KB a group
    w = sum((k * np.frombuffer(x, np.float64) for _, k, x in learnt), np.zeros(N_FEATURES)) / max(1, sum(k for _, k, _ in learnt))
    ranker = Ranker(mean, scale, w.astype(np.float32), 0.0, cut)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                raw = ranker.raw(np.stack([_unpack(x.as_py()) for x in b.column(0).slice(at, 500)]))
                yield pa.RecordBatch.from_arrays([pa.array(_to_bits(raw))], names=["bits"])

    scores = durable(kept.select("x").mapInArrow(rate, "bits long"))
    place = bad / n * (n - 1)
    ranker.threshold = (_at_rank(scores, int(np.floor(place))) + _at_rank(scores, int(np.ceil(place)))) / 2
    return ranker


def with_scores(docs: DataFrame, ranker: Ranker, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score of every whole text. Null and empty texts score as empty; repeated rows stay; an existing column `out` is replaced."""
    def score(texts: pd.Series) -> pd.Series:
        parts = [ranker.score(np.stack([features(t) for t in texts[i:i + 256]])) for i in range(0, len(texts), 256)]  # few feature rows at a time
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return docs.withColumn(out, F.pandas_udf(score, "double")(F.col(text_col)))
