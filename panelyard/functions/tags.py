"""Membership tags: parsing, size tier, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions.exprs import to_snake


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _list(values: list[str]) -> str:
    return ", ".join(_text(v) for v in values)


def parse_tags(c: Column | str) -> Column:
    """Comma-joined cell to an array of trimmed, non-blank tags; null to an empty array."""
    text = F.col(c) if isinstance(c, str) else c
    parts = F.transform(F.split(text, ","), lambda t: F.trim(t))
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def size_tier(tags: str = "tags", rules: list[tuple[str, str]] | None = None) -> Column:
    """First matching rule wins."""
    rules = rules or K.TIER_TAGS
    cases = " ".join(f"WHEN array_contains({tags}, {_text(t)}) THEN {_text(tier)}" for t, tier in rules)
    return F.expr(f"CASE {cases} ELSE {_text(K.NO_TIER)} END")


def in_group(members: list[str], tags: str = "tags") -> Column:
    return F.expr(f"arrays_overlap({tags}, array({_list(members)}))")


def tag_flags(names: list[str], tags: str = "tags") -> dict[str, Column]:
    """One boolean per given tag, named ``idx_<snake>``."""
    return {f"idx_{to_snake(n)}": F.expr(f"array_contains({tags}, {_text(n)})") for n in sorted(names)}


def add_tag_columns(
    df: DataFrame,
    tag_column: str = "index_tags",
    tag_names: list[str] | None = None,
    tier_rules: list[tuple[str, str]] | None = None,
    factors: dict[str, list[str]] | None = None,
    ownership: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Tags, tier, tag count, per-tag booleans, group rollups and the any-factor flag."""
    factors = K.FACTOR_TAGS if factors is None else factors
    ownership = K.OWNERSHIP_TAGS if ownership is None else ownership
    rollups = {f"is_{g}": in_group(m) for g, m in {**factors, **ownership}.items()}
    return df.withColumn("tags", parse_tags(tag_column)).withColumns(
        {
            "cap_tier": size_tier("tags", tier_rules),
            "index_count": F.size("tags"),
            **tag_flags(tag_names or []),
            **rollups,
            "is_any_factor": in_group([t for members in factors.values() for t in members]),
        }
    )


def distinct_tags(df: DataFrame, tag_column: str = "index_tags") -> DataFrame:
    return df.select(F.explode(parse_tags(tag_column)).alias("tag")).distinct()
