"""Rows between Spark and Python a few at a time, whatever the size of an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS, OUT_CHARS = 1_000, 1_000_000


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows as Python values, one by one: no more than one text of a batch is a Python string at a time."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def map_rows(df: DataFrame, each: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """The rows that `each()` yields for every row of `df`, in order. `each` is called once per task. A task holds one Arrow batch, one row, and
    at most `OUT_ROWS` made rows or about `OUT_CHARS` characters of them."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = each()
        held: list[tuple] = []
        chars = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)

        for row in rows_of(batches):
            for made in make(*row):
                held.append(made)
                chars += sum(len(v) for v in made if isinstance(v, (str, list)))
                if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield out()
                    held, chars = [], 0
        if held:
            yield out()

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], order: list[str], each: Callable[[pa.Table, list[int]], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows of `each(table, ends)` over whole groups of `keys`, sorted by `order`; `ends` says where each group of the table ends.

    Many small groups pass Python in one Arrow batch, where a function per group pays for a frame each. A task holds one batch and
    the group that it breaks off, so groups must be bounded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            new = np.zeros(max(t.num_rows - 1, 0), bool)
            for k in keys:
                c = pc.fill_null(t[k].cast(pa.string()), "\x00")
                new |= pc.not_equal(c.slice(1), c.slice(0, max(t.num_rows - 1, 0))).to_numpy()
            ends = (np.flatnonzero(new) + 1).tolist()
            held = t.slice(ends[-1]) if ends else t
            if ends:
                yield each(t.slice(0, ends[-1]), ends)
        if held is not None and held.num_rows:
            yield each(held, [held.num_rows])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
