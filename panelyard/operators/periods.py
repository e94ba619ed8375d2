"""Profit history: quarterly and annual series, streaks, trailing years and records.

A feed is wide, one row per key (``QL1..`` / ``FYL1..``, 1 = latest). All summaries work
on one array per row, index 0 = latest, so a wide feed needs no shuffle and a long
series exactly one (partial aggregation per key first). An array holds at most the
fixed number of periods, whatever the size of the data.

Zero is the missing-value sentinel of these series; losses are negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions.exprs import count_where
from panelyard.functions.text import change, finite, growth, nonzero, ratio, total
from panelyard.operators import order_stats

PREFIX = {"Q": "QL", "FY": "FYL"}
LENGTH = {"Q": K.QUARTERS, "FY": K.YEARS}


def period_names(freq: str, periods: int | None = None) -> list[str]:
    return [f"{PREFIX[freq]}{i}" for i in range(1, (periods or LENGTH[freq]) + 1)]


def with_series(df: DataFrame, freq: str, periods: int | None = None, out: str = "p") -> DataFrame:
    """Wide feed to one array of period values per row, sentinels as nulls."""
    cells = ", ".join(nonzero(c) for c in period_names(freq, periods))
    return df.withColumn(out, F.expr(f"array({cells})"))


def series_from_long(
    long: DataFrame, periods: int, key: str = "isin", value: str = "pat", out: str = "p",
) -> DataFrame:
    """Long (key, periods_ago, value) to one array per key."""
    cells = ", ".join(f"max({nonzero(value)}) FILTER (WHERE periods_ago = {k})" for k in range(periods))
    return long.groupBy(key).agg(F.expr(f"array({cells})").alias(out))


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def to_long(df: DataFrame, freq: str, key: str | list[str] = "isin", periods: int | None = None) -> DataFrame:
    """Wide feed to (key, period, pat, periods_ago, freq); sentinels and nulls left out."""
    names = period_names(freq, periods)
    wide = df.selectExpr(*_keys(key), *[f"{nonzero(c)} AS {c}" for c in names])
    long = wide.unpivot(_keys(key), names, "period", "pat").where("pat IS NOT NULL")
    ago = F.regexp_extract("period", r"(\d+)$", 1).cast("int") - 1
    return long.select(*_keys(key), "period", "pat", ago.alias("periods_ago"), F.lit(freq).alias("freq"))


# Expressions over a series array named ``p``; index 0 is the latest period.
def _count(p: str, test: str) -> str:
    return f"CAST(size(filter({p}, v -> {test})) AS BIGINT)"


def _at(p: str, i: int) -> str:
    """Element ``i`` or null past the end."""
    return f"try_element_at({p}, {i + 1})"


def _sum(values: str) -> str:
    return f"aggregate({values}, 0D, (acc, v) -> acc + v)"


def _exact_sum(values: str) -> str:
    """Sum of money amounts as decimals, cast once, so that it equals a figure reported with as
    many digits. Amounts that no such decimal holds are added as doubles."""
    amount = "TRY_CAST(v AS DECIMAL(28,4))"
    total_ = f"aggregate({values}, CAST(0 AS DECIMAL(28,4)), (acc, v) -> TRY_CAST(try_add(acc, {amount}) AS DECIMAL(28,4)))"
    return f"coalesce(CAST({total_} AS DOUBLE), {_sum(values)})"


def _sum_of_four(p: str, start: int | str) -> str:
    """Sum of four periods from ``start``; null unless all four are present."""
    window = f"slice({p}, {start} + 1, 4)"
    return f"CASE WHEN size({window}) = 4 AND NOT exists({window}, v -> v IS NULL) THEN {_exact_sum(window)} END"


def leading_run(p: str, broken: str) -> str:
    """Number of leading elements before the first for which ``broken`` (over the value
    ``v`` and its index ``i``) holds."""
    return f"CAST(coalesce(array_min(transform({p}, (v, i) -> CASE WHEN {broken} THEN i END)), size({p})) AS BIGINT)"


def profit_streak(p: str) -> str:
    """Consecutive positive periods from the latest; null or a loss ends the run."""
    return leading_run(p, "v IS NULL OR v <= 0")


def growth_streak(p: str) -> str:
    """Consecutive periods above the one before, from the latest."""
    return leading_run(p, f"NOT coalesce(v > try_element_at({p}, i + 2), false)")


def _volatility(p: str) -> str:
    """Sample deviation over the absolute mean, in percent."""
    values = f"filter({p}, v -> v IS NOT NULL)"
    mean = f"try_divide({_sum(values)}, size({values}))"
    # The mean is bound to a name by a one-element transform.
    squares = f"transform(array({mean}), m -> aggregate({values}, 0D, (acc, v) -> acc + (v - m) * (v - m)))[0]"
    deviation = f"sqrt(try_divide({squares}, nullif(size({values}) - 1, 0)))"
    return f"{ratio(deviation, f'abs({mean})')} * 100"


def is_record(value: str, peak: str) -> str:
    """At or above a positive peak."""
    return total(f"{value} >= {peak} AND {peak} > 0")


def rolling_year_peak(p: str) -> str:
    """Highest sum of four consecutive present quarters."""
    return f"array_max(transform(sequence(0, greatest(size({p}) - 4, 0)), i -> {_sum_of_four(p, 'i')}))"


Columns = dict[str, str]


def quarterly_columns(p: str) -> tuple[Columns, Columns]:
    """Quarterly trajectory of a series array: figures read from the array, and figures
    derived from those."""
    first = {
        "qtrs_available": _count(p, "v IS NOT NULL"),
        "pat_latest_q": _at(p, 0),
        "pat_yoy_q_pct": change(_at(p, 0), _at(p, 4)),
        "pat_qoq_pct": change(_at(p, 0), _at(p, 1)),
        "pat_ttm": _sum_of_four(p, 0),
        "pat_ttm_prev": _sum_of_four(p, 4),
        "profitable_qtrs": _count(p, "v > 0"),
        "loss_qtrs": _count(p, "v < 0"),
        "pat_qtr_volatility": _volatility(p),
        "profit_streak_qtrs": profit_streak(p),
        "pat_peak_q": f"array_max({p})",
        "pat_ttm_peak_rolling": rolling_year_peak(p),
    }
    # A key that is missing in the feed has no flags, not negative ones.
    known = "CASE WHEN qtrs_available IS NOT NULL THEN {} END"
    then = {
        "pat_ttm_growth_pct": change("pat_ttm", "pat_ttm_prev"),
        "profitable_qtr_pct": f"{ratio('profitable_qtrs', 'qtrs_available')} * 100",
        "pat_q_vs_peak_pct": change("pat_latest_q", "pat_peak_q"),
        "pat_q_at_ath": known.format(is_record("pat_latest_q", "pat_peak_q")),
        "pat_ttm_vs_peak_rolling_pct": change("pat_ttm", "pat_ttm_peak_rolling"),
        "pat_ttm_at_ath_rolling": known.format(is_record("pat_ttm", "pat_ttm_peak_rolling")),
    }
    return first, then


def yearly_columns(p: str, ttm: str | None) -> tuple[Columns, Columns]:
    """Annual trajectory of a series array. A growth horizon of n years compares the
    latest with the n-th year back, which is n - 1 years of compounding."""
    fy1 = _at(p, 0)
    first = {
        "fy_available": _count(p, "v IS NOT NULL"),
        "pat_ttm_reported": "CAST(NULL AS DOUBLE)" if ttm is None else nonzero(ttm),
        "pat_fy1": fy1,
        **{f"pat_cagr_{n}y_pct": growth(fy1, _at(p, n - 1), n - 1) for n in K.CAGR_HORIZONS},
        "profitable_fy": _count(p, "v > 0"),
        "loss_fy": _count(p, "v < 0"),
        "pat_peak_fy": f"array_max({p})",
        "profit_streak_fy": profit_streak(p),
        "pat_growth_streak_fy": growth_streak(p),
    }
    record = is_record("pat_fy1", "pat_peak_fy")
    then = {
        "profitable_fy_pct": f"{ratio('profitable_fy', 'fy_available')} * 100",
        "pat_vs_peak_pct": change("pat_fy1", "pat_peak_fy"),
        "pat_fy_at_ath": f"CASE WHEN fy_available IS NOT NULL THEN {record} END",
    }
    return first, then


def verdict_columns() -> Columns:
    """Trailing year against every reported year, and latest quarter against every
    quarter; both must hold. Total: a missing half is a plain False."""
    ttm_record = is_record("pat_ttm", "pat_peak_fy")
    return {
        "pat_ttm_vs_fy_peak_pct": change("pat_ttm", "pat_peak_fy"),
        "pat_ttm_at_ath": ttm_record,
        "pat_both_at_ath": f"{ttm_record} AND {is_record('pat_latest_q', 'pat_peak_q')}",
    }


def _project(df: DataFrame, key: str | list[str], parts: list[tuple[Columns, Columns]], last: Columns | None = None) -> DataFrame:
    first = [f"{sql} AS {name}" for one, _ in parts for name, sql in one.items()]
    then = [f"{sql} AS {name}" for _, two in parts for name, sql in two.items()]
    then += [f"{sql} AS {name}" for name, sql in (last or {}).items()]
    return df.selectExpr(*_keys(key), *first).selectExpr("*", *then)


def summarise_quarterly(df: DataFrame, p: str = "p", key: str = "isin") -> DataFrame:
    return _project(df, key, [quarterly_columns(p)])


def summarise_yearly(df: DataFrame, p: str = "p", key: str = "isin", ttm: str | None = None) -> DataFrame:
    return _project(df, key, [yearly_columns(p, ttm)])


def summarise(
    quarterly: DataFrame, yearly: DataFrame, p: str = "p", key: str | list[str] = "isin", ttm: str | None = None,
) -> DataFrame:
    """Quarterly and annual summaries and the record verdict, one row per key of either
    feed. The two feeds are aligned once; everything else is one projection. A key in
    one feed only has nulls for the other and a negative verdict."""
    q = quarterly.select(*_keys(key), F.col(p).alias("q_series"))
    y = yearly.select(*_keys(key), F.col(p).alias("y_series"), *([ttm] if ttm else []))
    parts = [quarterly_columns("q_series"), yearly_columns("y_series", ttm)]
    return _project(q.join(y, _keys(key), "full_outer"), key, parts, verdict_columns())


VERDICT = ["pat_ttm_vs_fy_peak_pct", "pat_ttm_at_ath", "pat_both_at_ath"]


def record_verdict(quarterly: DataFrame, yearly: DataFrame, p: str = "p", key: str = "isin") -> DataFrame:
    """The verdict alone; unused figures are pruned from the projection."""
    return summarise(quarterly, yearly, p, key).select(key, *VERDICT)


def stored_verdicts(
    quarterly: DataFrame, yearly: DataFrame, fetched_at: Column, p: str = "p", key: str = "isin",
) -> DataFrame:
    """The verdict rows kept for a scan, with the figures that explain them."""
    return summarise(quarterly, yearly, p, key).withColumn("pat_fy_peak", F.col("pat_peak_fy")).select(
        *[key if c == "isin" else c for c in K.VERDICT_COLUMNS], fetched_at.alias("fetched_at")
    )


def entity_series(
    entities: DataFrame, long: DataFrame, symbol: str, freq: str | None = None, key: str = "isin",
) -> DataFrame:
    """One entity's period series, latest first, looked up by symbol."""
    found = entities.where(F.upper("symbol") == symbol.upper()).select(key)
    rows = long.join(found, key, "left_semi")
    if freq:
        rows = rows.where(F.col("freq") == freq)
    return rows.select("period", "periods_ago", "pat").orderBy("periods_ago")


def history_depth(df: DataFrame) -> DataFrame:
    """How deep the period series reach, one row per series, from one pass."""
    series = [
        (name, col, full, half)
        for name, col, full, half in (
            ("quarterly PAT", "qtrs_available", K.QUARTERS, 24), ("annual PAT", "fy_available", K.YEARS, 8),
        )
        if col in df.columns
    ]
    plain, medians = {}, {}
    for i, (_, col, full, half) in enumerate(series):
        plain[f"full{i}"] = count_where(F.col(col) == full)
        plain[f"half{i}"] = count_where(F.col(col) < half)
        medians[f"median{i}"] = order_stats.median(col)
    rows = ", ".join(
        f"named_struct('series', '{name}', 'max_periods', {full}L, 'median_available', median{i}, "
        f"'full_history_n', full{i}, 'under_half_n', half{i})"
        for i, (name, _, full, _) in enumerate(series)
    )
    return order_stats.aggregate(df, [], plain, medians).selectExpr(f"inline(array({rows}))")


def pad_periods(df: DataFrame, freq: str, periods: int | None = None) -> DataFrame:
    """Add the period columns a feed leaves out, as nulls."""
    missing = [c for c in period_names(freq, periods) if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else df


def as_numbers(df: DataFrame) -> DataFrame:
    """Period columns as doubles; text that is no number becomes null."""
    periods = [c for c in df.columns if c.startswith(("QL", "FYL")) or c == "TTM"]
    return df.withColumns({c: F.expr(finite(f"TRY_CAST(`{c}` AS DOUBLE)")) for c in periods})
