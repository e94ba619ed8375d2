"""Cross-sectional aggregates of an entity frame: group medians, breadth, quantile
spreads, cohort counts, overlaps and quadrants."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions.exprs import count_where, share, tier_order
from panelyard.operators import order_stats
from panelyard.operators.order_stats import median

DIMENSIONS = {"sector": "sector", "industry": "industry", "tier": "cap_tier"}
TRILLION = 1e12


def group_medians(
    df: DataFrame,
    dimension: str,
    metrics: Sequence[str] | None = None,
    masked: Sequence[str] | None = None,
    sector_value: str = K.MASKED_SECTOR,
    min_n: int = 1,
    sort_metric: str | None = None,
    descending: bool = True,
) -> DataFrame:
    """Count, metric medians, total size and two trend shares per group.

    Metrics that do not apply to one sector leave its rows out of their median; a group
    holding only that sector gets null. ``min_n`` and ``sort_metric`` rank the groups.
    """
    if dimension not in DIMENSIONS:
        raise ValueError(f"dimension must be one of {list(DIMENSIONS)}")
    wanted = list(metrics) if metrics else [m for m in K.GROUP_METRICS if m in df.columns]
    unknown = [m for m in wanted if m not in df.columns]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    hidden = set(K.MASKED_METRICS if masked is None else masked)
    outside = F.coalesce(F.col("sector") != sector_value, F.lit(False))
    group = DIMENSIONS[dimension]
    rows = df.where(F.col(group).isNotNull()).withColumn("group", F.col(group))
    out = order_stats.aggregate(
        rows,
        ["group"],
        {
            "n": F.count("*"),
            "mcap_lakh_cr": F.sum("market_cap") / TRILLION,
            "pct_above_ema200": share(F.col("above_ema_200")),
            "pct_ema_stacked": share(F.col("ema_stack_bullish")),
        },
        {
            f"{m}_median": median(F.when(outside, F.col(m)) if m in hidden else F.col(m))
            for m in wanted
        },
    )
    if min_n > 1:
        out = out.where(F.col("n") >= min_n)
    if sort_metric:
        c = F.col(sort_metric)
        return out.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "group")
    return out.orderBy(F.col("n").desc(), "group")


def headline(df: DataFrame) -> DataFrame:
    return order_stats.aggregate(
        df,
        [],
        {
            "companies": F.count("*"),
            "total_mcap_lakh_cr": F.sum("market_cap") / TRILLION,
            "advancing": count_where(F.col("chg_1d_pct") > 0),
            "declining": count_where(F.col("chg_1d_pct") < 0),
            "total_employees": F.sum(F.coalesce(F.col("employees"), F.lit(0))),
        },
        {
            "median_pe": median("pe_ratio"),
            "median_1y_return": median("perf_1y_pct"),
            "median_from_52w_high": median("dist_52w_high_pct"),
            "median_from_ath": median("dist_ath_pct"),
        },
    )


def breadth(df: DataFrame) -> DataFrame:
    """Share of all rows meeting each of five conditions; null counts as not met."""
    return df.agg(
        share(F.col("above_ema_200")).alias("pct_above_ema200"),
        share(F.col("above_sma_200")).alias("pct_above_sma200"),
        share(F.col("ema_stack_bullish")).alias("pct_ema_stacked"),
        share(F.col("perf_1y_pct") > 0).alias("pct_positive_1y"),
        share(F.col("dist_52w_high_pct") > -10).alias("pct_near_52w_high"),
    )


def _by_tier(df: DataFrame, plain: dict[str, Column], quantiles: dict | None = None) -> DataFrame:
    rows = df.withColumn("tier", F.col("cap_tier"))
    out = (
        order_stats.aggregate(rows, ["tier"], plain, quantiles)
        if quantiles
        else rows.groupBy("tier").agg(*[c.alias(o) for o, c in plain.items()])
    )
    return out.orderBy(tier_order("tier"), "tier")


def tier_summary(df: DataFrame) -> DataFrame:
    return _by_tier(
        df,
        {
            "n": F.count("*"),
            "mcap_lakh_cr": F.sum("market_cap") / TRILLION,
            "pct_above_ema200": share(F.col("above_ema_200")),
        },
        {"median_1y": median("perf_1y_pct"), "median_pe": median("pe_ratio")},
    )


def value_counts(df: DataFrame, field: str, out: str = "value") -> DataFrame:
    return (
        df.where(F.col(field).isNotNull())
        .groupBy(F.col(field).alias(out))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), out)
    )


def enum_values(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Value counts of several categorical fields in one pass: (field, value, n)."""
    wanted = [f for f in (fields or K.ENUM_FIELDS) if f in df.columns]
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in wanted
    ])
    return (
        df.select(F.inline(cells)).where("value IS NOT NULL")
        .groupBy("field", "value").agg(F.count("*").alias("n"))
    )


def rating_conflicts(df: DataFrame) -> DataFrame:
    return df.agg(count_where(F.col("rating_conflict")).alias("n"))


def breadth_by_group(df: DataFrame, by: str = "sector", min_n: int = 5) -> DataFrame:
    if by not in DIMENSIONS:
        raise ValueError(f"by must be one of {list(DIMENSIONS)}")
    rows = df.where(F.col(DIMENSIONS[by]).isNotNull()).withColumn("group", F.col(DIMENSIONS[by]))
    out = order_stats.aggregate(
        rows,
        ["group"],
        {
            "n": F.count("*"),
            "pct_above_ema200": share(F.col("above_ema_200")),
            "pct_stacked": share(F.col("ema_stack_bullish")),
            "pct_positive_1y": share(F.col("perf_1y_pct") > 0),
            "pct_profit_ath": share(F.col("pat_both_at_ath")),
        },
        {"median_1y": median("perf_1y_pct")},
    )
    return out.where(F.col("n") >= min_n).orderBy(F.col("pct_above_ema200").desc_nulls_last(), "group")


def distance_histogram(df: DataFrame) -> DataFrame:
    d = F.col("dist_52w_high_pct")
    return df.agg(
        count_where(d > -2).alias("at_high"),
        count_where((d <= -2) & (d > -10)).alias("within_10"),
        count_where((d <= -10) & (d > -25)).alias("down_10_25"),
        count_where((d <= -25) & (d > -50)).alias("down_25_50"),
        count_where(d <= -50).alias("down_50"),
    )


def high_low(df: DataFrame) -> DataFrame:
    at = F.col("pct_of_52w_range")
    return order_stats.aggregate(
        df,
        [],
        {
            "new_highs": count_where(F.col("dist_52w_high_pct") > -1),
            "new_lows": count_where(F.col("above_52w_low_pct") < 5),
            "upper_quartile": count_where(at > 75),
            "lower_quartile": count_where(at < 25),
        },
        {"median_range_position": median("pct_of_52w_range")},
    )


def record_profit_counts(df: DataFrame) -> DataFrame:
    """Record-profit cohorts and drawdown buckets. Three-valued logic is kept: a negated
    null flag is null and counts nowhere."""
    ttm, q = F.col("pat_ttm_at_ath"), F.col("pat_q_at_ath")
    off = F.col("pat_ttm_vs_fy_peak_pct")
    return df.agg(
        F.count("*").alias("universe"),
        count_where(ttm).alias("ttm_at_ath"),
        count_where(q).alias("q_at_ath"),
        count_where(F.col("pat_both_at_ath")).alias("both_at_ath"),
        count_where(F.col("pat_fy_at_ath")).alias("fy_at_ath"),
        count_where(ttm & ~q).alias("ttm_only"),
        count_where(q & ~ttm).alias("q_only"),
        count_where(~ttm & (off > -10)).alias("ttm_within_10"),
        count_where(~ttm & (off <= -10) & (off > -25)).alias("ttm_10_25"),
        count_where(~ttm & (off <= -25) & (off > -50)).alias("ttm_25_50"),
        count_where(off <= -50).alias("ttm_below_50"),
    )


def record_profit_by_tier(df: DataFrame) -> DataFrame:
    return _by_tier(
        df,
        {
            "n": F.count("*"),
            "ttm_at_ath": count_where(F.col("pat_ttm_at_ath")),
            "q_at_ath": count_where(F.col("pat_q_at_ath")),
            "both_at_ath": count_where(F.col("pat_both_at_ath")),
            "both_pct": share(F.col("pat_both_at_ath")),
        },
    )


def _largest(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(F.col("market_cap").desc_nulls_last(), "symbol").limit(n).select(*columns)


DIVERGENT = "pat_both_at_ath AND perf_1y_pct < 0"


def divergent(df: DataFrame, n: int = 10) -> DataFrame:
    """Record profit on both horizons with a falling price, largest first."""
    columns = ["symbol", "name", "cap_tier", "market_cap", "perf_1y_pct", "dist_ath_pct", "pat_yoy_q_pct"]
    return _largest(df.where(DIVERGENT), columns, n)


def divergent_count(df: DataFrame) -> DataFrame:
    return df.where(DIVERGENT).agg(F.count("*").alias("n"))


def rolling_over(df: DataFrame, n: int = 10) -> DataFrame:
    """Record trailing year whose latest quarter is no record any more."""
    columns = ["symbol", "name", "cap_tier", "market_cap", "pat_q_vs_peak_pct", "pat_yoy_q_pct", "perf_1y_pct"]
    return _largest(df.where("pat_ttm_at_ath AND NOT pat_q_at_ath"), columns, n)


def valuation_by_tier(df: DataFrame) -> DataFrame:
    pe = F.col("pe_ratio")
    return _by_tier(
        df.where(pe > 0),
        {"n": F.count("*")},
        {
            "p25": (pe, 0.25), "p50": (pe, 0.5), "p75": (pe, 0.75), "p90": (pe, 0.9),
            "peg": median("peg_ratio"), "earnings_yield": median("earnings_yield_pct"),
        },
    )


def valuation_by_sector(df: DataFrame, min_n: int = 5) -> DataFrame:
    out = order_stats.aggregate(
        df.where(F.col("sector").isNotNull() & (F.col("pe_ratio") > 0)),
        ["sector"],
        {"n": F.count("*")},
        {
            "pe": median("pe_ratio"), "pb": median("price_to_book"),
            "earnings_yield": median("earnings_yield_pct"), "vs_own_5y": median("pe_vs_own_5y_pct"),
        },
    )
    return out.where(F.col("n") >= min_n).orderBy(F.col("pe").asc_nulls_last(), "sector")


def ownership_by_tier(df: DataFrame) -> DataFrame:
    return _by_tier(
        df,
        {"n": F.count("*")},
        {
            "fii": median("fii_holding"),
            "dii": median("dii_holding"),
            "promoter": median("promoter_holding"),
            "fii_chg_3y": median("chg_fii_holding_3y"),
            "dii_chg_3y": median("chg_dii_holding_3y"),
            "promoter_chg_3y": median("chg_promoter_holding_3y"),
        },
    )


def ownership_changes(df: DataFrame, n: int = 6) -> DataFrame:
    """Largest rises (``added``) and falls (``cut``) of one holding."""
    change = F.col("chg_fii_holding_3y")
    rows = df.where(change.isNotNull()).select("symbol", "name", "cap_tier", "fii_holding", "chg_fii_holding_3y")
    added = rows.orderBy(change.desc(), "symbol").limit(n).withColumn("side", F.lit("added"))
    cut = rows.orderBy(change.asc(), "symbol").limit(n).withColumn("side", F.lit("cut"))
    return added.unionByName(cut)


def factor_columns(df: DataFrame) -> list[str]:
    """The rollup flags of a frame."""
    return [c for c in df.columns if c.startswith("is_") and c not in ("is_sme", "is_any_factor")]


def overlap_matrix(df: DataFrame, flags: Sequence[str], top: int | None = None) -> DataFrame:
    """Rows shared by every pair of boolean columns and their share of the first.

    One pass of conditional counts: the work is one row per task whatever the size of a
    group, and no pairs of rows are formed. The pairs are pairs of columns.
    """
    flags = list(flags)
    members = {f: F.coalesce(F.col(f), F.lit(False)) for f in flags}
    counts = df.agg(
        *[count_where(members[f]).alias(f"n_{i}") for i, f in enumerate(flags)],
        *[
            count_where(members[a] & members[b]).alias(f"p_{flags.index(a)}_{flags.index(b)}")
            for a, b in combinations(flags, 2)
        ],
    )
    short = [f.removeprefix("is_") for f in flags]
    cells = F.array(*[
        F.struct(
            F.lit(short[i]).alias("a"), F.lit(short[j]).alias("b"),
            F.col(f"p_{i}_{j}").alias("overlap"),
            (F.try_divide(F.col(f"p_{i}_{j}") * F.lit(100.0), F.col(f"n_{i}"))).alias("pct_of_a"),
        )
        for i, j in combinations(range(len(flags)), 2)
    ])
    pairs = counts.select(F.inline(cells)).where("overlap > 0").orderBy(F.col("overlap").desc(), "a", "b")
    return pairs.limit(top) if top else pairs


def factor_stats(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Size, trend state and medians of every factor's members, in one pass: a row is
    repeated once per factor it belongs to, at most ``len(flags)`` times."""
    held = F.array_compact(
        F.array(*[F.when(F.col(f), F.lit(f.removeprefix("is_"))) for f in flags])
    )
    rows = df.select(
        F.explode(held).alias("factor"), "above_ema_200", "ema_stack_bullish", "perf_1y_pct", "pe_ratio"
    )
    return order_stats.aggregate(
        rows,
        ["factor"],
        {
            "n": F.count("*"),
            "above_ema200": count_where(F.col("above_ema_200")),
            "stacked": count_where(F.col("ema_stack_bullish")),
            "pct_above_ema200": share(F.col("above_ema_200")),
            "pct_stacked": share(F.col("ema_stack_bullish")),
        },
        {"median_1y": median("perf_1y_pct"), "median_pe": median("pe_ratio")},
    )


def factors_by_tier(df: DataFrame, flags: Sequence[str] | None = None) -> DataFrame:
    flags = flags or ["is_momentum", "is_quality", "is_value", "is_low_volatility"]
    short = {"is_low_volatility": "low_vol"}
    return _by_tier(df, {short.get(f, f.removeprefix("is_")): count_where(F.col(f)) for f in flags})


def drawdown_points(df: DataFrame) -> DataFrame:
    earnings, price = F.col("pat_ttm_vs_fy_peak_pct"), F.col("dist_ath_pct")
    return df.where(price.isNotNull() & (earnings > -150)).select(
        "symbol", "cap_tier", "sector", earnings.alias("earnings"), price.alias("price"), "market_cap"
    )


def drawdown_quadrants(df: DataFrame) -> DataFrame:
    e, p = F.col("pat_ttm_vs_fy_peak_pct"), F.col("dist_ath_pct")
    return df.where(e.isNotNull() & p.isNotNull()).agg(
        count_where((e > -10) & (p > -20)).alias("both_near_high"),
        count_where((e > -10) & (p <= -20)).alias("earnings_high_price_low"),
        count_where((e <= -10) & (p > -20)).alias("price_high_earnings_low"),
        count_where((e <= -10) & (p <= -20)).alias("both_low"),
    )


def tier_band_violations(
    df: DataFrame, expected: dict[str, int] | None = None, nominal: int = K.UNIVERSE_EXPECTED,
    slack: int = K.TIER_SLACK,
) -> DataFrame:
    """Tiers whose size leaves its band, and too many unclassified rows. A tier may run
    short by as many rows as the universe lacks, plus the slack."""
    expected = expected or K.TIER_EXPECTED
    tiers = [*expected, K.NO_TIER]
    counts = df.agg(
        F.count("*").alias("total"),
        *[count_where(F.col("cap_tier") == t).alias(f"t{i}") for i, t in enumerate(tiers)],
    )
    missing = F.greatest(F.lit(0), F.lit(nominal) - F.col("total"))
    cells = [
        F.struct(
            F.lit(t).alias("tier"), F.col(f"t{i}").alias("got"),
            (F.lit(expected[t]) - missing - slack if t in expected else F.lit(0)).cast("bigint").alias("low"),
            F.lit(expected[t] + slack if t in expected else slack).cast("bigint").alias("high"),
        )
        for i, t in enumerate(tiers)
    ]
    return counts.select(F.inline(F.array(*cells))).where("got < low OR got > high")
