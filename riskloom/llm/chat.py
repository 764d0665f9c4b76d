"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all turns up to and with that reply; only the reply is trainable. A conversation that ends in turns without a
reply also gives one example without a target, so no turn is lost; `complete` marks the example that holds the whole
conversation. Each turn is written as `<|turn|>role<|say|>text<|end|>` and a line break. Control strings inside roles and texts
get a backslash after their first character (one more if they already have some), which is undone on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
TAIL = END + "\n"
# The template's own strings and those of common chat templates, which no text may pass on.
CONTROLS = r"(<|\[)(\\*)(\|turn\||\|say\||\|end\||\|im_start\||\|im_end\||\|endoftext\||/?s>|<SYS>>|</SYS>>|/?INST\])"
ESCAPED = CONTROLS.replace(r"(\\*)", r"\\(\\*)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def expand_prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                    target_role: str = "assistant") -> DataFrame:
    """One row per example: conv id, example (from 0), n_turns, target (0-based turn or null), text, loss_start, loss_chars, complete.

    The loss mask is the span of code points [loss_start, loss_start + loss_chars) of `text`. Null roles and texts count as
    empty; turns order by turn number (null first), then role, then text, so ties and repeated rows have one order and all stay.
    Rows with a null conversation id form one conversation. An empty table gives no rows; other columns are not read.
    A conversation is gathered into one row, which its longest example needs anyway; conversations are spread by id.
    """
    one = F.struct(F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    head = F.concat(F.lit(TURN), escape(F.col("u.r")), F.lit(SAY))
    whole = turns.select(F.col(conv_col).alias("conv"), one.alias("u")).select(
        "conv", F.struct("u.t", "u.r", "u.x", head.alias("h"), escape(F.col("u.x")).alias("e")).alias("u"))
    convs = whole.groupBy("conv").agg(F.array_sort(F.collect_list("u")).alias("us"))
    written = "array_join(transform(us, u -> concat(u.h, u.e, '" + END + "\\n')), '')"
    starts = ("aggregate(us, named_struct('at', 0L, 'all', cast(array() AS array<bigint>)), (s, u) -> named_struct("
              f"'at', s.at + length(u.h) + length(u.e) + {len(TAIL)}, 'all', array_append(s.all, s.at))).all")
    spans = convs.select("conv", "us", F.expr(written).alias("whole"), F.expr(starts).alias("starts")).withColumn(
        "targets", F.expr(f"filter(sequence(0, size(us) - 1), i -> us[i].r = '{target_role}' OR i = size(us) - 1)"))
    rows = spans.select("conv", "us", "whole", "starts", F.posexplode("targets").alias("example", "i"))
    turn, start = F.expr("us[i]"), F.expr("starts[i]")
    trains = F.col("u.r") == target_role
    return rows.select("conv", "example", "i", turn.alias("u"), start.alias("at"), "whole", F.expr("i = size(us) - 1").alias("complete")).select(
        F.col("conv").alias(conv_col), F.col("example").cast("long").alias("example"), (F.col("i") + 1).cast("long").alias("n_turns"), F.when(trains, F.col("i")).alias("target"),
        F.expr(f"substring(whole, 1, cast(at + length(u.h) + length(u.e) + {len(TAIL)} AS int))").alias("text"),
        F.when(trains, F.col("at") + F.length("u.h")).cast("long").alias("loss_start"), F.when(trains, F.length("u.e")).otherwise(0).cast("long").alias("loss_chars"), "complete")


def read_turns(text: Column) -> Column:
    """Turns of a formatted text as array<struct<role, text>>, unescaped."""
    parts = F.split(text, r"<\|end\|>\n")
    body = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(body, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1), SAY, 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, SAY) + len(SAY), F.lit(2**31 - 1))).alias("text")))


def digests(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples.

    Turns are read from the example that holds the whole conversation; trained texts from the loss span of every example, in order.
    """
    trained = unescape(F.expr("substring(text, cast(loss_start + 1 AS int), cast(loss_chars AS int))"))
    turns = F.when(F.col("complete"), read_turns(F.col("text")))
    spelled = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(conv_col, "example", F.size(turns).cast("long").alias("n"), F.sha2(spelled, 256).alias("sha"), F.length("text").alias("chars"),
                           F.when(F.col("target").isNotNull(), trained).alias("trained"))
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", F.coalesce("trained", F.lit("")).alias("x")))), lambda t: t["x"]), "")
    got = read.groupBy(conv_col).agg(F.max(F.when(F.col("sha").isNotNull(), F.col("n"))).alias("n_turns"), F.max("sha").alias("turns_sha256"), loss.alias("loss"),
                                     F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_examples"))
    return got.select(conv_col, "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
