"""Byte-level BPE over Arrow batches: the tokenizers library's BPE model, fed with the pieces of the split pattern.

Ranks come from a public `.tiktoken` file whose path is a parameter; it must exist on every worker (or be shipped with
`addFile`). Each byte stands for one printable character, so merges work on bytes; each match of the pattern is encoded
separately. Ids of pieces are remembered per task in a bounded table, as most pieces of a corpus repeat. Ids are spelt out by Arrow.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES_KEPT = 150_000


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteTable:
    """Decoder alone: the bytes of each id, held once per worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: dict[int, bytes] = {r: w for w, r in ranks.items()}
        self.spelt = pa.array([self.tokens.get(i) for i in range(max(self.tokens, default=-1) + 1)], pa.binary())

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_lists(self, lists: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list of ids; a null list gives null."""
        spelt = self.spelt.take(lists.flatten())
        if spelt.null_count:
            raise KeyError("an id that the vocabulary does not hold")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        starts = pa.array(np.append(0, ends), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(starts, spelt, mask=lists.is_null()), b"")

    def decode(self, ids) -> str:
        """Text of the ids; characters split over tokens are put together, bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


class Pieces(dict):
    """Ids by piece, at most `kept` of them; those of a piece not met before are worked out when it is looked up."""

    def __init__(self, ids_of: Callable[[str], bytes], kept: int):
        self.ids_of, self.kept = ids_of, kept

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        self[piece] = ids = self.ids_of(piece)
        return ids


class ByteBPE(ByteTable):
    """Encoder and decoder of one vocabulary. Unknown ids and ids out of range raise on decoding."""

    def __init__(self, ranks_path: str, pattern: str, kept: int = PIECES_KEPT):
        import regex
        from tokenizers import models

        ranks = read_ranks(ranks_path)
        super().__init__(ranks)
        char = byte_characters()
        self._spell = dict(enumerate(char))
        spell = lambda w: "".join([char[b] for b in w])
        merges = []
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            cuts = [(word[:i], word[i:]) for i in range(1, len(word))]
            cuts = [(a, b) for a, b in cuts if ranks.get(a, rank) < rank and ranks.get(b, rank) < rank]
            merges += [(spell(a), spell(b)) for a, b in cuts]
        self.model = models.BPE(vocab={spell(w): r for w, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.find, self._ids = regex.compile(pattern).findall, Pieces(self._piece_ids, kept)

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text, each match of the pattern by itself; special tokens in the text are ordinary text."""
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers. Each text's pieces are looked up while they are at hand."""
        return [b"".join(map(self._ids.__getitem__, self.find(t))) for t in texts]

    def encode_lists(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text as a list of 32-bit numbers."""
        made = self.encode_many(texts)
        ends = np.cumsum([len(x) // 4 for x in made])
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(made), "<i4")))

    def _piece_ids(self, piece: str) -> bytes:
        spelt = piece.encode("utf-8").decode("latin-1").translate(self._spell)
        return np.array([token.id for token in self.model.tokenize(spelt)], "<u4").tobytes()

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """First and end character of each token. A token that holds part of a character's bytes covers the whole character."""
        lengths = np.array([len(self.tokens[i]) for i in ids], np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
        ends = np.cumsum(lengths)
        starts = ends - lengths
        return (char_of[starts].tolist(), (char_of[ends - 1] + 1).tolist()) if len(ids) else ([], [])


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def _coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(path, pattern)
    return _LOADED[path, pattern]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """`docs` with `token_ids` array<int> and, if asked for, `token_starts`, `token_ends` (characters). Null texts encode as empty.

    Whole texts, in the order of the input; an empty table gives no rows; columns of these names are replaced.
    """
    new = ["token_ids"] + (["token_starts", "token_ends"] if with_offsets else [])
    kept = [c for c in docs.columns if c not in new]
    source = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + [f"{n} array<int>" for n in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for at in range(0, b.num_rows, 512):  # ids and offsets of some texts at a time
                part = texts[at:at + 512].to_pylist()
                cols = [coder.encode_lists(part)]
                if with_offsets:
                    spans = [coder.offsets(t, i) for t, i in zip(part, cols[0].to_pylist())]
                    cols += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([c[at:at + 512] for c in b.columns[:-1]] + cols, names=kept + new)

    return source.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ranks_path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`rows` with the binary column `out`: the bytes of the ids, exactly those of the encoded text. Null ids decode to null."""
    kept = [c for c in rows.columns if c != out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema] + [f"`{out}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteTable(read_ranks(ranks_path))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, coder.decode_lists(b.column(kept.index(ids_col)))], names=kept + [out])

    return rows.select(*kept).mapInArrow(run, schema)


def encode_and_check(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """`docs` with `token_ids` array<int>, `n_tokens` long and `round_trip`: whether the bytes of the ids are those of the text.

    What `encode_texts` and `decode_ids` give, in one pass, so that texts and ids go through Python once. Rules for rows, nulls and
    columns are those of `encode_texts`.
    """
    new = ["token_ids", "n_tokens", "round_trip"]
    kept = [c for c in docs.columns if c not in new]
    source = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + ["token_ids array<int>, n_tokens long, round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # ids of some texts at a time
                b = whole.slice(at, 512)
                texts = b.column(b.num_columns - 1)
                ids = coder.encode_lists(texts.to_pylist())
                cols = [ids, pc.list_value_length(ids).cast(pa.int64()), pc.equal(coder.decode_lists(ids), texts.cast(pa.binary()))]
                yield pa.RecordBatch.from_arrays(b.columns[:-1] + cols, names=kept + new)

    return source.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256 (of the bytes decoded from the ids).

    The same encoder and decoder as above, in one pass, so that ids need not travel between them.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sha = _coder(ranks_path, pattern), hashlib.sha256
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for at in range(0, b.num_rows, 256):
                for ids in coder.encode_many([t.as_py() or "" for t in b.column(1)[at:at + 256]]):
                    counts.append(len(ids) // 4)
                    of_ids.append(sha(ids).hexdigest())
                    of_bytes.append(sha(coder.decode_bytes(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                                             names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
