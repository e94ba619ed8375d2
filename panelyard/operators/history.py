"""Comparisons and series across dated snapshots of the entity frame.

Snapshots are aligned on the stable key, never on the symbol: a renamed symbol is the
same entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions.exprs import count_where, share, signed_change
from panelyard.operators import order_stats
from panelyard.operators.order_stats import median
from panelyard.operators.screen import Filter, check_fields, check_numeric, where_all

DATE = "snapshot_date"


def at(history: DataFrame, date: str) -> DataFrame:
    """One snapshot; the date filter prunes partitions."""
    return history.where(F.col(DATE) == F.lit(date).cast("date"))


def dates(history: DataFrame) -> DataFrame:
    return history.select(DATE).distinct().orderBy(DATE)


def latest_pair(history: DataFrame) -> DataFrame:
    """One row: the previous and the latest snapshot (before, after; equal if one is held)."""
    last = history.select(DATE).distinct().orderBy(F.col(DATE).desc()).limit(2)
    return last.agg(F.min(DATE).cast("string").alias("before"), F.max(DATE).cast("string").alias("after"))


def resolve_pair(history: DataFrame, before: str | None = None, after: str | None = None) -> tuple[str, str]:
    """Given dates, or the previous and the latest snapshot."""
    if before and after:
        return before, after
    last = [str(r[0]) for r in history.select(DATE).distinct().orderBy(F.col(DATE).desc()).limit(2).collect()]
    if len(last) < 2:
        raise ValueError("only one snapshot is held; nothing to compare")
    return before or last[1], after or last[0]


def _paired(history: DataFrame, metric: str, before: str, after: str, key: str) -> DataFrame:
    check_numeric(history, metric)
    a = at(history, before).where(F.col(metric).isNotNull()).select(key, F.col(metric).alias("before"))
    b = at(history, after).where(F.col(metric).isNotNull())
    return a.join(b, key).withColumn("after", F.col(metric))


def changes(
    history: DataFrame, metric: str, before: str, after: str, n: int | None = 15, key: str = "isin",
) -> DataFrame:
    """Entities by how far a metric moved between two snapshots."""
    move = F.col("after") - F.col("before")
    rows = _paired(history, metric, before, after, key).select(
        key, "symbol", "name", "cap_tier", "sector", "market_cap", "before", "after",
        move.alias("delta"), signed_change("after", "before").alias("pct_change"),
    )
    ordered = rows.orderBy(F.abs("delta").desc(), key)
    return ordered.limit(n) if n else rows


def change_summary(history: DataFrame, metric: str, before: str, after: str, key: str = "isin") -> DataFrame:
    rows = _paired(history, metric, before, after, key)
    a, b = F.col("before"), F.col("after")
    return order_stats.aggregate(
        rows, [],
        {
            "compared": F.count("*"), "up": count_where(b > a), "down": count_where(b < a),
            "flat": count_where(b == a),
        },
        {"median_delta": median(b - a)},
    )


def split_movers(moved: DataFrame, n: int = 6) -> DataFrame:
    """First ``n`` rises and first ``n`` falls of a change list, largest move first."""
    first = [F.abs("delta").desc(), F.col("symbol")]
    up = moved.where("delta > 0").orderBy(*first).limit(n).withColumn("side", F.lit("up"))
    down = moved.where("delta < 0").orderBy(*first).limit(n).withColumn("side", F.lit("down"))
    return up.unionByName(down)


def universe_changes(history: DataFrame, before: str, after: str, key: str = "isin") -> DataFrame:
    """Entities that entered or left, marked by ``change``."""
    a, b = at(history, before), at(history, after)
    shown = [key, "symbol", "name", "sector", "cap_tier", "market_cap"]
    entered = b.join(a.select(key), key, "left_anti").select(*shown, F.lit("entered").alias("change"))
    left = a.join(b.select(key), key, "left_anti").select(*shown, F.lit("left").alias("change"))
    return entered.unionByName(left)


def tier_moves(history: DataFrame, before: str, after: str, key: str = "isin") -> DataFrame:
    a = at(history, before).select(key, F.col("cap_tier").alias("from_tier"))
    b = at(history, after)
    return a.join(b, key).where(F.col("from_tier") != F.col("cap_tier")).select(
        key, "symbol", "name", "from_tier", F.col("cap_tier").alias("to_tier"), "market_cap"
    )


def universe_stability(history: DataFrame, before: str, after: str, key: str = "isin") -> DataFrame:
    return universe_changes(history, before, after, key).agg(
        count_where(F.col("change") == "entered").alias("entered"),
        count_where(F.col("change") == "left").alias("left"),
    ).withColumn("stable", (F.col("entered") == 0) & (F.col("left") == 0))


SHOWN = ["symbol", "name", "sector", "cap_tier", "market_cap", "perf_1y_pct"]


def screen_changes(
    history: DataFrame, filters: Sequence[Filter], before: str, after: str, key: str = "isin",
) -> DataFrame:
    """Entities that entered or exited a screen between two snapshots."""
    a = at(where_all(history, filters), before).select(key, *SHOWN)
    b = at(where_all(history, filters), after).select(key, *SHOWN)
    entered = b.join(a.select(key), key, "left_anti").withColumn("change", F.lit("entered"))
    exited = a.join(b.select(key), key, "left_anti").withColumn("change", F.lit("exited"))
    return entered.unionByName(exited).orderBy(F.coalesce("market_cap", F.lit(0.0)).desc(), key)


def screen_change_counts(
    history: DataFrame, filters: Sequence[Filter], before: str, after: str, key: str = "isin",
) -> DataFrame:
    """Sizes before and after, and held / entered / exited, in one pass over both dates."""
    marks = where_all(history, filters).where(F.col(DATE).isin([before, after])).groupBy(key).agg(
        F.max(F.col(DATE) == F.lit(before).cast("date")).alias("was"),
        F.max(F.col(DATE) == F.lit(after).cast("date")).alias("now"),
    )
    was, now = F.col("was"), F.col("now")
    return marks.agg(
        count_where(was).alias("count_before"), count_where(now).alias("count_after"),
        count_where(now & ~was).alias("entered_n"), count_where(was & ~now).alias("exited_n"),
        count_where(was & now).alias("held_n"),
    )


def universe_series(history: DataFrame, metric: str = "perf_1y_pct") -> DataFrame:
    """Distribution of a metric and breadth per snapshot."""
    check_numeric(history, metric)
    value = F.col(metric)
    return order_stats.aggregate(
        history, [DATE],
        {
            "companies": F.count("*"),
            "pct_above_ema200": share(F.col("above_ema_200")),
            "pct_ema_stacked": share(F.col("ema_stack_bullish")),
            "mcap_lakh_cr": F.sum("market_cap") / 1e12,
        },
        {"median": median(value), "p25": (value, 0.25), "p75": (value, 0.75)},
    ).orderBy(DATE)


def entity_series(
    history: DataFrame, symbol: str, metrics: Sequence[str] | None = None, key: str = "isin",
) -> DataFrame:
    """One entity across snapshots. The symbol is resolved to its key first, so a rename
    does not cut the series."""
    wanted = list(metrics) if metrics else [m for m in K.SERIES_METRICS if m in history.columns]
    check_fields(history, wanted)
    keys = history.where(F.upper("symbol") == symbol.upper()).select(key).distinct()
    return history.join(keys, key, "left_semi").select(DATE, *wanted).orderBy(DATE)


def first_to_last(history: DataFrame, metric: str, key: str = "isin") -> DataFrame:
    """Change of a metric from the first to the last snapshot of each entity."""
    check_numeric(history, metric)
    ends = history.groupBy(key).agg(
        F.min_by(metric, DATE).alias("first"), F.max_by(metric, DATE).alias("last"),
        F.count("*").alias("points"),
    )
    return ends.withColumn("change_pct", signed_change("last", "first"))


def snapshot_counts(history: DataFrame) -> DataFrame:
    return history.groupBy(DATE).agg(F.count("*").alias("companies")).orderBy(DATE)
