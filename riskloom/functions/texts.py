"""Text measures: tokens, lines, masks, windows of lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CJK = "[\\u4e00-\\u9fff]"
PUNCTUATION = "[.,;:!?，。；：！？\"\"''（）()\\[\\]{}]"


def estimate_tokens(text: Column, method: str = "words") -> Column:
    """Token estimate without a tokenizer.

    `words`: CJK characters * 2 + words * 1.3 + punctuation * 0.5.
    `chars`: CJK characters * 2 + other characters * 0.3.
    `quarter`: a quarter of the length.
    """
    text = F.coalesce(text, F.lit(""))
    if method == "quarter":
        return F.ceil(F.length(text) / F.lit(4.0))
    cjk = F.regexp_count(text, F.lit(CJK))
    if method == "chars":
        return F.ceil(cjk * F.lit(2.0) + (F.length(text) - cjk) * F.lit(0.3))
    spaced = F.regexp_replace(text, CJK, " ")
    words = F.regexp_count(spaced, F.lit("\\S+"))
    marks = F.regexp_count(text, F.lit(PUNCTUATION))
    return F.ceil(cjk * F.lit(2.0) + words * F.lit(1.3) + marks * F.lit(0.5))


def lines_of(content: Column) -> Column:
    return F.split(content, "\n", -1)


def line_of_offset(content: Column, offset: Column) -> Column:
    """1-based line holding the character at a 0-based offset."""
    head = F.substring(content, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1


def line_window(lines: Column, line_no: Column, before: int, after: int) -> Column:
    """The lines from line_no-before to line_no+after, cut at both ends of the file."""
    start = F.greatest(line_no - before, F.lit(1))
    stop = F.least(line_no + after, F.size(lines))
    return F.when(stop >= start, F.slice(lines, start, stop - start + 1)).otherwise(
        F.array().cast("array<string>"))


def near_lines(line_no: Column, before: int, after: int) -> Column:
    """The lines from line_no-before to line_no+after out of the carried lines `_around`, the first of which is line `_from`."""
    start = F.greatest(line_no - before, F.col("_from"))
    stop = F.least(line_no + after, F.col("_from") + F.size("_around") - 1)
    return F.when(stop >= start, F.slice("_around", start - F.col("_from") + 1, stop - start + 1)).otherwise(
        F.array().cast("array<string>"))


def near_line(line_no: Column) -> Column:
    """One of the carried lines; null beyond the end of the file. line_no must not lie before `_from`."""
    return F.try_element_at("_around", line_no - F.col("_from") + 1)


def near_text(line_no: Column, before: int, after: int) -> Column:
    return F.array_join(near_lines(line_no, before, after), "\n")


def context_lines(line_no: Column) -> Column:
    """array<struct<line,content,is_target>> of the carried lines."""
    return F.transform("_around", lambda text, i: F.struct(
        (F.col("_from") + i).alias("line"), text.alias("content"), (F.col("_from") + i == line_no).alias("is_target")))


def snippet(line_no: Column) -> Column:
    return near_text(line_no, 2, 2)


def mask_secret(col: Column) -> Column:
    """First and last four characters stay; eight characters or less are hidden entirely."""
    col = F.coalesce(col, F.lit(""))
    n = F.length(col)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.left(col, F.lit(4)), F.lit("***"), F.right(col, F.lit(4))))


def any_match(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """True when one of the patterns occurs; one alternation, compiled once per task."""
    flag = "(?i)" if ignore_case else ""
    return text.rlike(flag + "|".join(f"(?:{p})" for p in patterns))


def count_matching(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """How many of the patterns occur at least once.

    Counted in an array, which keeps long pattern lists out of one generated method.
    """
    flag = "(?i)" if ignore_case else ""
    return F.size(F.filter(F.array(*[text.rlike(flag + p) for p in patterns]), lambda hit: hit))
