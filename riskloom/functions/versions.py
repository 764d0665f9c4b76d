"""An order of version numbers as text that sorts, and ranges of versions as tables of bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Words that come before a release, in order; words that mean the release itself; words that come after it.
BEFORE = {"a": 1, "alpha": 1, "b": 2, "beta": 2, "m": 3, "milestone": 3, "rc": 4, "cr": 4, "pre": 4, "preview": 4, "snapshot": 5, "dev": 5}
RELEASE = ["ga", "final", "release", "jre", "android"]
AFTER = ["sp", "patch"]


def version_key(version: Column) -> Column:
    """A text that sorts as versions do; null where a version has no number (`any`, a property that was not resolved).

    Numbers compare as numbers of any length and stand above words; a word before the release (alpha, beta, milestone, rc,
    snapshot) puts a version below the same one without it, unknown words put it above. Zeros at the end of the numbers say
    nothing (2, 2.0 and 2.0.0.Final are equal), nor do a leading v, ^, ~, = or build data after +.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(version)), r"^[^0-9a-z]*v?(?=[0-9])", ""), r"\+.*$", "")
    words = F.create_map(*[x for w, n in BEFORE.items() for x in (F.lit(w), F.lit(f",{n}"))], *[x for w in RELEASE for x in (F.lit(w), F.lit(",6"))],
                         *[x for w in AFTER for x in (F.lit(w), F.lit(",7"))])

    def code(token: Column) -> Column:
        digits = F.substring(F.regexp_replace(token, "^0+", ""), 1, 99)
        number = F.concat(F.lit(",9"), F.lpad(F.length(digits).cast("string"), 2, "0"), digits)
        return F.when(token.rlike("^[0-9]"), number).otherwise(F.coalesce(F.try_element_at(words, token), F.concat(F.lit(",8"), token)))

    joined = F.concat(F.array_join(F.transform(F.regexp_extract_all(plain, F.lit("[0-9]+|[a-z]+"), F.lit(0)), code), ""), F.lit(",6"))
    short = F.regexp_replace(F.regexp_replace(joined, r"(?:,900)+(?=,[1-8])", ""), r"(?:,6)+$", ",6")
    return F.when(plain.rlike("^[0-9]"), short)


def range_bounds(df: DataFrame, column: str = "affected") -> DataFrame:
    """A row for each interval of ranges such as `[2.0,2.14.1]`, `(,1.2.80]`, `[5.2,5.2.20),[5.3,5.3.18)` or `[2.15.0]`:
    low_key, low_in, high_key, high_in beside the other columns. An open end has a null key. Null and unreadable ranges give no rows."""
    spelled = F.regexp_replace(F.regexp_replace(column, r"\s", ""), r"\[([^,\[\]()]+)\]", r"[$1,$1]")
    one = r"([\[(])([^,\[\]()]*),([^,\[\]()]*)([\])])"
    parts = [F.regexp_extract_all(spelled, F.lit(one), F.lit(i)) for i in range(1, 5)]
    rows = df.withColumn("_r", F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abcd")])))
    bound = lambda c: F.when(F.col(c) != "", version_key(F.col(c)))
    return rows.select(*df.columns, bound("_r.b").alias("low_key"), (F.col("_r.a") == "[").alias("low_in"), bound("_r.c").alias("high_key"), (F.col("_r.d") == "]").alias("high_in"))


def inside(key: Column) -> Column:
    """Whether a version key lies in the interval of the same row."""
    above = F.col("low_key").isNull() | (key > F.col("low_key")) | (F.col("low_in") & (key == F.col("low_key")))
    below = F.col("high_key").isNull() | (key < F.col("high_key")) | (F.col("high_in") & (key == F.col("high_key")))
    return above & below
