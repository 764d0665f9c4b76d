"""Joins whose sides all grow with the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame


def growing(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: its join is shuffled. Spark guesses a size from the columns it reads, and texts or arrays worked
    out of them may be a thousand times larger, so a side it takes for small would be gathered whole in the driver."""
    return df.hint("merge")
