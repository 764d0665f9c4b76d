"""Severity labels, ranks and clamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskloom.dims import lookup

# Labels of every accepted vocabulary.
LEVELS = {"critical": "blocker", "严重": "blocker", "blocker": "blocker", "high": "major", "高危": "major",
          "major": "major", "medium": "minor", "中危": "minor", "minor": "minor"}
NAMES = {"严重": "critical", "高危": "high", "中危": "medium", "低危": "low", "critical": "critical",
         "high": "high", "medium": "medium", "low": "low", "info": "info"}
PREFIXES = {"critical": "C", "严重": "C", "high": "H", "高危": "H", "medium": "M", "中危": "M", "low": "L",
            "低危": "L"}
RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
DOWN = {"critical": "high", "high": "medium", "medium": "low", "low": "low"}
MULTIPLIERS = {"critical": 1.0, "high": 0.9, "medium": 0.7, "low": 0.5}
CVSS_BY_SEVERITY = {"critical": 9.5, "high": 7.5, "medium": 5.0, "low": 2.5, "info": 0.1}


def severity_level(col: Column) -> Column:
    """blocker / major / minor / info; anything unknown counts as info."""
    return lookup(LEVELS, F.lower(F.coalesce(col, F.lit(""))), "info")


def severity_map(col: Column) -> Column:
    """Any accepted label to critical / high / medium / low / info; unknown becomes medium."""
    return lookup(NAMES, F.lower(F.coalesce(col, F.lit(""))), "medium")


def severity_prefix(col: Column) -> Column:
    return lookup(PREFIXES, F.lower(F.coalesce(col, F.lit(""))), "L")


def severity_rank(col: Column) -> Column:
    """4 for critical down to 1 for low, 0 for everything else."""
    return lookup(RANKS, F.lower(F.coalesce(col, F.lit(""))), 0)


def severity_weight(col: Column) -> Column:
    """The rank used in sums: unknown labels weigh as much as low."""
    return F.greatest(severity_rank(severity_map_strict(col)), F.lit(1))


def severity_map_strict(col: Column) -> Column:
    return lookup(NAMES, F.lower(F.coalesce(col, F.lit(""))))


def downgrade(col: Column) -> Column:
    """One step down; a label outside the scale is kept."""
    return F.coalesce(lookup(DOWN, F.lower(col)), col)


def clamp_confidence(col: Column) -> Column:
    number = col.try_cast("double")
    number = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
    # greatest() and least() pass over nulls, so a missing number is caught first
    return F.when(number.isNull(), F.lit(0.65)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def clamp_cvss(col: Column) -> Column:
    number = col.try_cast("double")
    number = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
    return F.when(number.isNull(), F.lit(5.0)).otherwise(
        round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(10.0), number)), 1))


def safe_string(col: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.trim(col.cast("string")), F.lit("")), F.lit(fallback))


def round_half_up(col: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity, on the double itself (no decimal detour)."""
    scale = 10.0 ** digits
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale) if digits else F.floor(col + F.lit(0.5))


def or_default(col: Column, other) -> Column:
    """Empty text counts as missing."""
    return F.coalesce(F.nullif(col, F.lit("")), other if isinstance(other, Column) else F.lit(other))
