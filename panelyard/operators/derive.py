"""Derived columns of the entity frame. A column appears only where its inputs exist.

Each column is one SQL expression, so a frame of hundreds of columns costs the driver
one parse per column and the cluster one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions.text import away, ratio, total

# name, columns needed, expression
Spec = tuple[str, list[str], str]

# reference level -> name part of the distance column
MEAN_LEVELS = {"ema_20": "ema_20", "ema_50": "ema_50", "ema_200": "ema_200", "sma_50": "sma_50", "sma_200": "sma_200"}
HIGH_LEVELS = {
    "high_52w": "52w_high", "high_all_time": "ath", "high_6m": "6m_high", "high_3m": "3m_high",
    "donchian_20_upper": "20d_high",
}
LOW_LEVELS = {"low_52w": "52w_low", "low_all_time": "atl"}
WINDOWS = ["perf_1w_pct", "perf_1m_pct", "perf_3m_pct", "perf_6m_pct", "perf_1y_pct"]


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def reconstructed() -> list[Spec]:
    shares = ratio("market_cap", "price")
    return [
        ("shares_implied", ["market_cap", "price"], shares),
        ("revenue_ttm", ["market_cap", "price", "revenue_per_share"], f"revenue_per_share * {shares}"),
        ("price_to_book", ["price", "book_value_per_share"], ratio("price", "book_value_per_share")),
        ("pe_forward_derived", ["price", "eps_estimate_annual"], ratio("price", "eps_estimate_annual")),
    ]


def trend() -> list[Spec]:
    emas = ["price", "ema_20", "ema_50", "ema_200"]
    return [
        *[(f"dist_{part}_pct", ["price", ref], away("price", ref)) for ref, part in {**MEAN_LEVELS, **HIGH_LEVELS}.items()],
        *[(f"above_{part}_pct", ["price", ref], away("price", ref)) for ref, part in LOW_LEVELS.items()],
        ("ema_stack_bullish", emas, total("price > ema_20 AND ema_20 > ema_50 AND ema_50 > ema_200")),
        ("ema_stack_bearish", emas, total("price < ema_20 AND ema_20 < ema_50 AND ema_50 < ema_200")),
        ("above_ema_200", ["price", "ema_200"], total("price > ema_200")),
        ("above_sma_200", ["price", "sma_200"], total("price > sma_200")),
        ("pct_of_52w_range", ["price", "high_52w", "low_52w"], f"({ratio('(price - low_52w)', '(high_52w - low_52w)')}) * 100"),
    ]


def momentum(columns: list[str]) -> list[Spec]:
    present = [c for c in WINDOWS if c in columns]
    up = " + ".join(f"CAST({total(f'{c} > 0')} AS BIGINT)" for c in present) or "0"
    year, month = "(1 + perf_1y_pct / 100)", "(1 + perf_1m_pct / 100)"
    return [
        ("momentum_12_1_pct", ["perf_1y_pct", "perf_1m_pct"], f"(({ratio(year, month)}) - 1) * 100"),
        ("momentum_per_beta", ["perf_1y_pct", "beta_1y"], ratio("perf_1y_pct", "beta_1y")),
        ("momentum_accel", ["perf_3m_pct", "perf_1y_pct"], "perf_3m_pct - perf_1y_pct / 4"),
        *([("positive_windows", [], up)] if present else []),
    ]


def valuation() -> list[Spec]:
    return [
        ("pe_vs_own_5y_pct", ["pe_ratio", "historical_pe_5y"], away("pe_ratio", "historical_pe_5y")),
        ("pe_vs_industry_pct", ["pe_ratio", "industry_pe"], away("pe_ratio", "industry_pe")),
        ("upside_to_target_pct", ["target_price_1y", "price"], away("target_price_1y", "price")),
        ("earnings_yield_pct", ["pe_ratio"], ratio("100", "pe_ratio")),
    ]


def own_book_value() -> list[Spec]:
    """Needs the rebuilt ``price_to_book``."""
    return [("pbv_vs_own_5y_pct", ["price_to_book", "historical_pbv_5y"], away("price_to_book", "historical_pbv_5y"))]


def conflicts() -> list[Spec]:
    bull, bear = _quoted(K.BULLISH), _quoted(K.BEARISH)
    bull_bear = f"analyst_rating IN ({bull}) AND technical_rating IN ({bear})"
    bear_bull = f"analyst_rating IN ({bear}) AND technical_rating IN ({bull})"
    ratings, drift = ["analyst_rating", "technical_rating"], ["perf_1y_pct", "net_income_growth_ttm_yoy"]
    return [
        ("analyst_bull_tech_bear", ratings, total(bull_bear)),
        ("analyst_bear_tech_bull", ratings, total(bear_bull)),
        ("rating_conflict", ratings, f"{total(bull_bear)} OR {total(bear_bull)}"),
        ("price_up_earnings_down", drift, total("perf_1y_pct > 0 AND net_income_growth_ttm_yoy < 0")),
        ("price_down_earnings_up", drift, total("perf_1y_pct < 0 AND net_income_growth_ttm_yoy > 0")),
    ]


def _add(df: DataFrame, specs: list[Spec]) -> DataFrame:
    have = set(df.columns)
    new = {name: F.expr(sql) for name, needs, sql in specs if have.issuperset(needs)}
    return df.withColumns(new) if new else df


def add_reconstructed(df: DataFrame) -> DataFrame:
    return _add(df, reconstructed())


def add_trend(df: DataFrame) -> DataFrame:
    return _add(df, trend())


def add_momentum(df: DataFrame) -> DataFrame:
    return _add(df, momentum(df.columns))


def add_valuation(df: DataFrame) -> DataFrame:
    return _add(df, valuation())


def add_own_book_value(df: DataFrame) -> DataFrame:
    return _add(df, own_book_value())


def add_conflicts(df: DataFrame) -> DataFrame:
    return _add(df, conflicts())


def add_all(df: DataFrame) -> DataFrame:
    first = [*reconstructed(), *trend(), *momentum(df.columns), *valuation(), *conflicts()]
    return add_own_book_value(_add(df, first))
