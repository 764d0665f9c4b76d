"""Conversations: token counts, what to keep, and rounds against a limit."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom.functions.texts import estimate_tokens

OVERHEAD, MARGIN, PER_MESSAGE = 512, 0.85, 4


def message_tokens(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    return messages.groupBy(key).agg(F.count("*").alias("messages"), F.sum(estimate_tokens(F.col("text")) + PER_MESSAGE).alias("tokens"))


def token_precheck(messages: DataFrame, max_tokens: int, key: str = "conv_id", overhead: int = OVERHEAD, margin: float = MARGIN) -> DataFrame:
    """Does the conversation fit the safe part of the context?"""
    limit = math.floor(max_tokens * margin)
    total = F.col("tokens") + overhead
    return message_tokens(messages, key).select(
        key, total.alias("current_tokens"), F.lit(limit).alias("max_tokens"), (total <= limit).alias("ok"),
        F.format_string("%.1f", total * F.lit(100.0) / F.lit(limit)).alias("usage_percent"))


# How earlier messages mention findings and tools.
FINDING_NOTE, TOOL_NOTE = r"(?i)(?:发现|漏洞|vulnerability|finding)[:\s]+([^，,。\n]+)", r"(?i)(?:使用工具|tool|call)[:\s]+([^，,。\n]+)"


def keep_recent_messages(messages: DataFrame, n: int = 10, key: str = "conv_id") -> DataFrame:
    """System messages, one summary of what is left out, and the last n others, in order.

    Conversations with at most n other messages stay whole. Old messages are reduced to at most five
    notes each before they are gathered. Windows run per conversation.
    """
    other = F.col("role") != "system"
    w = W.partitionBy(key)
    df = messages.withColumn("_back", F.row_number().over(W.partitionBy(key, other).orderBy(F.col("turn").desc())))
    df = df.withColumn("_old", other & (F.col("_back") > n))
    kept = df.where(~F.col("_old")).select(key, F.when(other, 2).otherwise(0).alias("part"), "turn", "role", "text")
    old = df.where("_old").select(key, "turn", F.slice(F.regexp_extract_all("text", F.lit(FINDING_NOTE), F.lit(0)), 1, 5).alias("f"),
                                  F.transform(F.regexp_extract_all("text", F.lit(TOOL_NOTE), F.lit(1)), lambda t: F.trim(t)).alias("t"))
    counts = old.groupBy(key).agg(F.count("*").alias("n_old"))

    def first(col, k, distinct):
        rows = old.select(key, "turn", F.posexplode(col).alias("pos", "v"))
        if distinct:
            rows = rows.groupBy(key, "v").agg(F.min(F.struct("turn", "pos")).alias("o")).select(key, "v", "o.turn", "o.pos")
        few = rows.withColumn("_r", F.row_number().over(w.orderBy("turn", "pos"))).where(F.col("_r") <= k)
        return few.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "v"))), lambda x: x["v"]), ", ").alias(col))

    s = counts.join(first("f", 3, False), key, "left").join(first("t", 5, True), key, "left")
    text = F.concat_ws(" | ", F.when(F.col("f").isNotNull(), F.concat(F.lit("earlier findings: "), F.col("f"))),
                       F.when(F.col("t").isNotNull(), F.concat(F.lit("tools used: "), F.col("t"))),
                       F.concat(F.lit("["), F.col("n_old"), F.lit(" earlier messages left out]")))
    note = s.select(key, F.lit(1).alias("part"), F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"),
                    F.concat(F.lit("<memory_summary>"), text, F.lit("</memory_summary>")).alias("text"))
    return kept.unionByName(note)


ROUND_SCHEMA = "round int, total long, ratio double, soft boolean, hard boolean, compressions int, rounds_left long"


def advance(state: tuple, used_in: int, used_out: int, max_tokens: int, soft: float, hard: float, keep: float):
    """One round: (new state, row). state is (input, output, rounds, soft, hard, compressions).

    At the hard limit the history is compressed to `keep` of the context, which resets the flags.
    """
    tin, tout, rounds, is_soft, is_hard, comp = state
    tin, tout, rounds = tin + used_in, tout + used_out, rounds + 1
    total = tin + tout
    ratio = total / max_tokens if max_tokens > 0 else 0.0
    if max_tokens > 0:
        is_hard = is_hard or ratio >= hard
        is_soft = is_soft or (ratio >= soft and ratio < hard)
    mean = total / rounds if rounds else 0
    left = max(0, math.floor((max_tokens * hard - total) / mean)) if mean > 0 else 0
    row = (rounds, total, math.floor(ratio * 100 + 0.5) / 100, is_soft, is_hard, comp, left)
    if is_hard:
        tin, tout, is_soft, is_hard, comp = math.floor(max_tokens * keep), 0, False, False, comp + 1
    return (tin, tout, rounds, is_soft, is_hard, comp), row


def token_rounds(rounds: DataFrame, max_tokens: int, soft: float = 0.60, hard: float = 0.80, keep: float = 0.2, key: str = "conv_id") -> DataFrame:
    """Cumulative tokens per round with soft and hard triggers and compression at the hard one.

    rounds(key, turn, input_tokens, output_tokens). Resets make the sum depend on itself, so each
    conversation is walked in order; a conversation is bounded by its own length.
    """
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = (0, 0, 0, False, False, 0), []
        pdf = pdf.sort_values("turn")
        for k, turn, i, o in pdf[[key, "turn", "input_tokens", "output_tokens"]].itertuples(index=False):
            state, row = advance(state, int(i), int(o), max_tokens, soft, hard, keep)
            rows.append((k, turn, *row))
        return pd.DataFrame(rows, columns=[key, "turn", "round", "total", "ratio", "soft", "hard", "compressions", "rounds_left"])

    kind = rounds.schema[key].dataType.simpleString()
    return rounds.groupBy(key).applyInPandas(walk, f"{key} {kind}, turn long, {ROUND_SCHEMA}")
