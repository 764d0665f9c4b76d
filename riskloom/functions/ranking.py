"""Numbering and top-n that stay distributed when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom.functions.durable import durable


def numbered(df: DataFrame, keys: list[str], levels: list[str], order: list[str], out: str = "rn", keep: bool = True) -> DataFrame:
    """Gap-free row numbers within `keys`, ordered by `levels` (coarse to fine) and then `order`.

    A plain row_number() sorts each key in one task. Here only the rows below the finest level are
    numbered in one task (say, those of one file); the start of each level comes from running sums
    over counts, which are combined on the map side before they move. Levels nest: the running
    sums of the finest level are added to those of the level above, so no window ever holds more
    than the distinct children of one parent. Key and level columns must not be null.
    The rows are worked out once and kept: the counts and the numbering both read them, and a scan of texts may stand behind them.
    Without `keep` they are worked out twice, which is less where little stands behind them.
    """
    df = durable(df) if keep else df
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    finest = keys + levels
    counts = df.groupBy(*finest).agg(F.count("*").alias("_n"))
    starts = []
    level_counts = counts
    for i in range(len(levels), 0, -1):
        parent, here = keys + levels[: i - 1], keys + levels[:i]
        if i < len(levels):
            level_counts = level_counts.groupBy(*here).agg(F.sum("_n").alias("_n"))
        w = W.partitionBy(*parent).orderBy(levels[i - 1]).rowsBetween(W.unboundedPreceding, -1)
        starts.append((here, level_counts.select(*here, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_s{i}"))))
    base = starts[0][1]
    for here, part in starts[1:]:
        base = base.join(part, here)
    total = sum((F.col(f"_s{i}") for i in range(1, len(levels) + 1)), F.lit(0))
    base = base.select(*finest, total.alias("_base"))
    # the window and the join share their keys, so the rows move once
    inner = df.withColumn("_rn", F.row_number().over(W.partitionBy(*finest).orderBy(*order_cols)))
    return inner.join(base, finest).withColumn(out, F.col("_rn") + F.col("_base")).select(*df.columns, out)


def top_n(df: DataFrame, n: int | None, order: list, by: list[str] | None = None) -> DataFrame:
    """The first n rows overall, or per group; every row with n=None. Spark limits each map task before the shuffle."""
    if n is None:
        return df
    if not by:
        return df.orderBy(*order).limit(n)
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: one map-side combined aggregate, no sort of the group.

    `order` holds columns that ascend; wrap a number in a minus for descending.
    """
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    picked = df.groupBy(*keys).agg(F.min_by(row, rank).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])
