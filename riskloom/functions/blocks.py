"""Rows handed to tasks in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

BLOCK_CHARS = 4_000_000


def blocks_of(rows: DataFrame, text: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """All rows, in blocks of about `chars` characters of the column `text`. The driver and each task hold one block at a time."""
    total = rows.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, -(-total // chars))
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(n)) == k).collect()]
