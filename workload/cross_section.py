"""Queries on the cross-section of customers: screens, groups, tags, ranks, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions import exprs as X
from panelyard.functions import tags as T
from panelyard.operators import catalog as C
from panelyard.operators import clean, groups, matching, order_stats, quality, screen, views
from workload import frames as Fr
from workload import sql as S
from workload.registry import r, register, rounded

E = S.with_(S.entities())
ID = ["isin", "symbol", "sector", "cap_tier"]
MASK = {"masked": Fr.MASKED, "sector_value": Fr.SECTOR_MASKED}
FLAGS = ["is_momentum", "is_quality", "is_value", "is_low_volatility", "is_mnc"]


def ent(spark, sf):
    return Fr.entities(spark, sf)


# ------------------------------------------------------------------ filters
def _filter(name, filters, where, extra=()):
    cols = [*ID, *extra]
    register(
        name,
        lambda spark, sf: screen.where_all(ent(spark, sf), filters).select(*cols),
        f"{E} SELECT {', '.join(cols)} FROM e WHERE {where}",
    )


_filter("filter_eq_ne", [("sector", "eq", "BUILDING"), ("analyst_rating", "ne", "Buy")],
        "sector = 'BUILDING' AND analyst_rating <> 'Buy'", ["analyst_rating"])
_filter("filter_bounds", [("roe", "gt", 10), ("roe", "lte", 60), ("dist_ath_pct", "gte", -80), ("debt_to_equity", "lt", 2)],
        "roe > 10 AND roe <= 60 AND dist_ath_pct >= -80 AND debt_to_equity < 2", ["roe", "dist_ath_pct"])
_filter("filter_between", [("rsi_14", "between", [20, 45])], "rsi_14 BETWEEN 20 AND 45", ["rsi_14"])
_filter("filter_in", [("cap_tier", "in", ["Mid", "Small"])], "cap_tier IN ('Mid', 'Small')")
_filter("filter_not_in", [("technical_rating", "not_in", ["Buy", "Sell"])],
        "technical_rating NOT IN ('Buy', 'Sell')", ["technical_rating"])
_filter("filter_contains", [("name", "contains", "nation_1%5")], "lower(name) LIKE '%nation_1%5%'", ["name"])
_filter("filter_null", [("dividend_yield", "is_null")], "dividend_yield IS NULL")
_filter("filter_not_null", [("dividend_yield", "not_null")], "dividend_yield IS NOT NULL")
_filter("filter_flag", [("ema_stack_bullish", "eq", True), ("is_any_factor", "eq", True)], "ema_stack_bullish AND is_any_factor")

register(
    "screen_page",
    lambda spark, sf: screen.screen(
        ent(spark, sf), [("perf_1y_pct", "gt", 0)], [("perf_1y_pct", "desc")],
        ["symbol", "market_cap", "perf_1y_pct", "roce"], limit=50, offset=25, mask=False, tiebreak="isin",
    ),
    f"{E} SELECT symbol, market_cap, perf_1y_pct, roce, sector FROM e WHERE perf_1y_pct > 0 "
    "ORDER BY perf_1y_pct DESC NULLS LAST, isin LIMIT 50 OFFSET 25",
)
register(
    "screen_masked",
    lambda spark, sf: screen.screen(
        ent(spark, sf), [("roce", "gt", 0)], [("roce", "desc"), ("market_cap", "asc")],
        ["symbol", "roce", "roic", "debt_to_equity", "pe_ratio"], limit=200, tiebreak="isin", **MASK,
    ).withColumn("_masked_fields", F.array_join("_masked_fields", ",")),
    f"""{E}, p AS (SELECT symbol, roce, roic, debt_to_equity, pe_ratio, sector FROM e WHERE roce > 0
    ORDER BY roce DESC NULLS LAST, market_cap ASC NULLS LAST, isin LIMIT 200)
    SELECT symbol, CASE WHEN sector <> 'MACHINERY' THEN roce END AS roce, CASE WHEN sector <> 'MACHINERY' THEN roic END AS roic,
      CASE WHEN sector <> 'MACHINERY' THEN debt_to_equity END AS debt_to_equity, pe_ratio, sector,
      CASE WHEN sector = 'MACHINERY' THEN array_to_string(list_filter([
        CASE WHEN roce IS NOT NULL THEN 'roce' END, CASE WHEN debt_to_equity IS NOT NULL THEN 'debt_to_equity' END,
        CASE WHEN roic IS NOT NULL THEN 'roic' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS _masked_fields FROM p""",
)
register(
    "screen_total",
    lambda spark, sf: screen.total(ent(spark, sf), [("roe", "gte", 15), ("perf_1y_pct", "gt", 0)]),
    f"{E} SELECT count(*) AS n FROM e WHERE roe >= 15 AND perf_1y_pct > 0",
)
register(
    "sorted_page_nulls_last",
    lambda spark, sf: screen.page(
        screen.order_by(ent(spark, sf), [("dividend_yield", "asc"), ("rsi_14", "desc")], "isin"), 100, 900
    ).select("isin", "dividend_yield", "rsi_14"),
    f"{E} SELECT isin, dividend_yield, rsi_14 FROM e ORDER BY dividend_yield ASC NULLS LAST, rsi_14 DESC NULLS LAST, isin LIMIT 100 OFFSET 900",
)
register(
    "health_counts",
    lambda spark, sf: screen.health(ent(spark, sf), 12),
    f"{E} SELECT count(*) AS companies, CAST(12 AS BIGINT) AS columns FROM e",
)
_filter("preset_quality_momentum", K.SCREENS["quality-momentum"],
        "ema_stack_bullish AND roe >= 15 AND debt_to_equity <= 1 AND perf_1y_pct > 0")
_filter("preset_value_smallcap", K.SCREENS["value-smallcap"],
        "cap_tier IN ('Small','Micro') AND pe_ratio BETWEEN 5 AND 20 AND peg_ratio <= 1 AND roe >= 12")
_filter("preset_near_high", K.SCREENS["near-high"], "dist_52w_high_pct >= -5 AND above_ema_200")
for _view in ("momentum", "trend", "value", "quality", "growth", "ownership"):
    _held = {
        "momentum": K.VIEWS["momentum"],
        "trend": ["market_cap", "price", "chg_1d_pct", "above_ema_200", "above_sma_200", "ema_stack_bullish", "dist_ema_200_pct", "technical_rating"],
        "value": ["market_cap", "pe_ratio", "peg_ratio", "price_to_book", "earnings_yield_pct", "dividend_yield", "pe_vs_own_5y_pct", "pe_vs_industry_pct"],
        "quality": ["market_cap", "roe", "roce", "roic", "debt_to_equity"],
        "growth": ["market_cap", "revenue_growth_ttm_yoy", "net_income_growth_ttm_yoy"],
        "ownership": ["market_cap", "promoter_holding", "fii_holding", "dii_holding", "analyst_rating", "target_price_1y"],
    }[_view]
    register(
        f"view_{_view}",
        lambda spark, sf, v=_view: screen.named_view(ent(spark, sf), v),
        f"{E} SELECT symbol, name, sector, cap_tier, {', '.join(_held)} FROM e",
    )
register(
    "search",
    lambda spark, sf: screen.search(ent(spark, sf), "00012", 25),
    f"""{E} SELECT symbol, name, sector, cap_tier, market_cap FROM e
    WHERE lower(symbol) LIKE '%00012%' OR lower(name) LIKE '%00012%'
    ORDER BY CASE WHEN lower(symbol) = '00012' THEN 0 WHEN lower(symbol) LIKE '00012%' THEN 1 ELSE 2 END, market_cap DESC NULLS LAST, symbol LIMIT 25""",
)
register(
    "lookup_symbol",
    lambda spark, sf: screen.by_symbol(ent(spark, sf), "customer#000000042").select(*ID, "price"),
    f"{E} SELECT {', '.join(ID)}, price FROM e WHERE upper(symbol) = 'CUSTOMER#000000042'",
)
register(
    "movers",
    lambda spark, sf: screen.movers(ent(spark, sf), "perf_1y_pct", 20),
    f"""{E}, m AS (SELECT symbol, name, sector, cap_tier, market_cap, perf_1y_pct FROM e WHERE perf_1y_pct IS NOT NULL)
    SELECT * FROM (SELECT *, 'top' AS side FROM m ORDER BY perf_1y_pct DESC, symbol LIMIT 20)
    UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM m ORDER BY perf_1y_pct, symbol LIMIT 20)""",
)
register(
    "movers_in_tier",
    lambda spark, sf: screen.movers(ent(spark, sf), "market_cap", 10, "Mid"),
    f"""{E}, m AS (SELECT symbol, name, sector, cap_tier, market_cap FROM e WHERE market_cap IS NOT NULL AND cap_tier = 'Mid')
    SELECT * FROM (SELECT *, 'top' AS side FROM m ORDER BY market_cap DESC, symbol LIMIT 10)
    UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM m ORDER BY market_cap, symbol LIMIT 10)""",
)
SPECS = [
    {"name": "symbol", "label": "Symbol", "unit": "text", "fmt": "text"},
    {"name": "market_cap", "label": "Market Cap", "unit": "inr", "fmt": "cr"},
    {"name": "above_ema_200", "label": "Above EMA", "unit": "bool", "fmt": "text"},
    {"name": "roce", "label": "ROCE", "unit": "pct", "fmt": "0.1f%"},
    {"name": "as_of", "label": "As Of", "unit": "date", "fmt": "text"},
]
register(
    "export_rows",
    lambda spark, sf: screen.export_frame(
        screen.mask_sector(ent(spark, sf).withColumn("as_of", F.lit("2001-08-02 00:00:00")), **MASK), SPECS
    ).select("Symbol", "Above EMA", "As Of", F.col("ROCE").try_cast("double").alias("ROCE"),
             (F.col("ROCE") == "n/a").alias("masked"), F.col("Market Cap (₹ Cr)").cast("double").alias("mcap_cr")),
    f"""{E} SELECT symbol AS "Symbol", CASE WHEN above_ema_200 THEN 'Yes' ELSE 'No' END AS "Above EMA", '2001-08-02' AS "As Of",
    CASE WHEN sector <> 'MACHINERY' THEN roce END AS "ROCE", sector = 'MACHINERY' AS masked, round_even(market_cap / 1e7, 2) AS mcap_cr FROM e""",
)

# ------------------------------------------------------------------ groups
METRICS = ["market_cap", "pe_ratio", "roe", "roce", "perf_1y_pct", "dist_ath_pct", "dividend_yield"]


def _group_sql(col, extra=""):
    med = ", ".join(
        r(f"median({m}) FILTER (WHERE {'true' if m not in Fr.MASKED else 'sector <> ' + repr(Fr.SECTOR_MASKED)})") + f" AS {m}_median"
        for m in METRICS
    )
    return f"""SELECT {col} AS "group", count(*) AS n, {med}, {r('sum(market_cap) / 1e12', 9)} AS mcap_lakh_cr,
    {S.share('above_ema_200')} AS pct_above_ema200, {S.share('ema_stack_bullish')} AS pct_ema_stacked
    FROM e WHERE {col} IS NOT NULL GROUP BY 1 {extra}"""


def _group(df):
    return rounded(rounded(df, [f"{m}_median" for m in METRICS]), ["mcap_lakh_cr"], 9)


for _d, _c in groups.DIMENSIONS.items():
    register(
        f"group_medians_{_d}",
        lambda spark, sf, d=_d: _group(groups.group_medians(ent(spark, sf), d, METRICS, **MASK)),
        f"{E} {_group_sql(_c)}",
    )
register(
    "group_medians_bucketed",
    lambda spark, sf: rounded(order_stats.aggregate(
        ent(spark, sf), ["sector"], {"n": F.count("*")},
        {"roe_p10": (F.col("roe"), 0.1), "roe_p50": (F.col("roe"), 0.5), "perf_p50": (F.col("perf_1y_pct"), 0.5), "div_p90": (F.col("dividend_yield"), 0.9)},
        buckets=64,
    ), ["roe_p10", "roe_p50", "perf_p50", "div_p90"]),
    f"""{E} SELECT sector, count(*) AS n, {r('quantile_cont(roe, 0.1)')} AS roe_p10, {r('median(roe)')} AS roe_p50,
    {r('median(perf_1y_pct)')} AS perf_p50, {r('quantile_cont(dividend_yield, 0.9)')} AS div_p90 FROM e GROUP BY sector""",
)
register(
    "ranked_groups",
    lambda spark, sf: _group(groups.group_medians(ent(spark, sf), "industry", METRICS, min_n=60, sort_metric="roe_median", **MASK)),
    f"{E} {_group_sql('industry', 'HAVING count(*) >= 60')}",
)
HEAD = ["median_pe", "median_1y_return", "median_from_52w_high", "median_from_ath"]
register(
    "headline",
    lambda spark, sf: rounded(rounded(groups.headline(ent(spark, sf)), HEAD), ["total_mcap_lakh_cr"], 9),
    f"""{E} SELECT count(*) AS companies, {r('sum(market_cap) / 1e12', 9)} AS total_mcap_lakh_cr, {r('median(pe_ratio)')} AS median_pe,
    {r('median(perf_1y_pct)')} AS median_1y_return, {r('median(dist_52w_high_pct)')} AS median_from_52w_high, {r('median(dist_ath_pct)')} AS median_from_ath,
    {S.cnt('chg_1d_pct > 0')} AS advancing, {S.cnt('chg_1d_pct < 0')} AS declining, CAST(sum(coalesce(employees, 0)) AS BIGINT) AS total_employees FROM e""",
)
register(
    "breadth",
    lambda spark, sf: groups.breadth(ent(spark, sf)),
    f"""{E} SELECT {S.share('above_ema_200')} AS pct_above_ema200, {S.share('above_sma_200')} AS pct_above_sma200,
    {S.share('ema_stack_bullish')} AS pct_ema_stacked, {S.share('perf_1y_pct > 0')} AS pct_positive_1y, {S.share('dist_52w_high_pct > -10')} AS pct_near_52w_high FROM e""",
)
register(
    "tier_summary",
    lambda spark, sf: rounded(rounded(groups.tier_summary(ent(spark, sf)), ["median_1y", "median_pe"]), ["mcap_lakh_cr"], 9),
    f"""{E} SELECT cap_tier AS tier, count(*) AS n, {r('sum(market_cap) / 1e12', 9)} AS mcap_lakh_cr, {S.share('above_ema_200')} AS pct_above_ema200,
    {r('median(perf_1y_pct)')} AS median_1y, {r('median(pe_ratio)')} AS median_pe FROM e GROUP BY 1""",
)
register(
    "rating_counts",
    lambda spark, sf: groups.value_counts(ent(spark, sf), "analyst_rating", "rating"),
    f"{E} SELECT analyst_rating AS rating, count(*) AS n FROM e WHERE analyst_rating IS NOT NULL GROUP BY 1",
)
register(
    "enum_values",
    lambda spark, sf: groups.enum_values(ent(spark, sf)),
    f"{E} " + " UNION ALL ".join(
        f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM e WHERE {f} IS NOT NULL GROUP BY 2"
        for f in ("sector", "industry", "cap_tier", "analyst_rating", "technical_rating")
    ),
)
register("rating_conflicts", lambda spark, sf: groups.rating_conflicts(ent(spark, sf)), f"{E} SELECT {S.cnt('rating_conflict')} AS n FROM e")


def _with_profit_flag(df):
    return df.withColumn("pat_both_at_ath", X.flag(F.col("positive_windows") == 5))


for _d, _c in groups.DIMENSIONS.items():
    register(
        f"breadth_by_{_d}",
        lambda spark, sf, d=_d: rounded(groups.breadth_by_group(_with_profit_flag(ent(spark, sf)), d), ["median_1y"]),
        f"""{E} SELECT {_c} AS "group", count(*) AS n, {S.share('above_ema_200')} AS pct_above_ema200, {S.share('ema_stack_bullish')} AS pct_stacked,
        {S.share('perf_1y_pct > 0')} AS pct_positive_1y, {S.share('positive_windows = 5')} AS pct_profit_ath, {r('median(perf_1y_pct)')} AS median_1y
        FROM e WHERE {_c} IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""",
    )
register(
    "distance_histogram",
    lambda spark, sf: groups.distance_histogram(ent(spark, sf)),
    f"""{E} SELECT {S.cnt('dist_52w_high_pct > -2')} AS at_high, {S.cnt('dist_52w_high_pct <= -2 AND dist_52w_high_pct > -10')} AS within_10,
    {S.cnt('dist_52w_high_pct <= -10 AND dist_52w_high_pct > -25')} AS down_10_25, {S.cnt('dist_52w_high_pct <= -25 AND dist_52w_high_pct > -50')} AS down_25_50,
    {S.cnt('dist_52w_high_pct <= -50')} AS down_50 FROM e""",
)
register(
    "high_low",
    lambda spark, sf: rounded(groups.high_low(ent(spark, sf)), ["median_range_position"]),
    f"""{E} SELECT {S.cnt('dist_52w_high_pct > -1')} AS new_highs, {S.cnt('above_52w_low_pct < 5')} AS new_lows, {S.cnt('pct_of_52w_range > 75')} AS upper_quartile,
    {S.cnt('pct_of_52w_range < 25')} AS lower_quartile, {r('median(pct_of_52w_range)')} AS median_range_position FROM e""",
)
register(
    "valuation_by_tier",
    lambda spark, sf: rounded(groups.valuation_by_tier(ent(spark, sf)), ["p25", "p50", "p75", "p90", "peg", "earnings_yield"]),
    f"""{E} SELECT cap_tier AS tier, count(*) AS n, {', '.join(r(f'quantile_cont(pe_ratio, {p})') + f' AS {o}' for o, p in (('p25', .25), ('p50', .5), ('p75', .75), ('p90', .9)))},
    {r('median(peg_ratio)')} AS peg, {r('median(earnings_yield_pct)')} AS earnings_yield FROM e WHERE pe_ratio > 0 GROUP BY 1""",
)
register(
    "valuation_by_sector",
    lambda spark, sf: rounded(groups.valuation_by_sector(ent(spark, sf)), ["pe", "pb", "earnings_yield", "vs_own_5y"]),
    f"""{E} SELECT sector, count(*) AS n, {r('median(pe_ratio)')} AS pe, {r('median(price_to_book)')} AS pb, {r('median(earnings_yield_pct)')} AS earnings_yield,
    {r('median(pe_vs_own_5y_pct)')} AS vs_own_5y FROM e WHERE sector IS NOT NULL AND pe_ratio > 0 GROUP BY 1 HAVING count(*) >= 5""",
)
OWN = {"fii": "fii_holding", "dii": "dii_holding", "promoter": "promoter_holding", "fii_chg_3y": "chg_fii_holding_3y",
       "dii_chg_3y": "chg_dii_holding_3y", "promoter_chg_3y": "chg_promoter_holding_3y"}
register(
    "ownership_by_tier",
    lambda spark, sf: rounded(groups.ownership_by_tier(ent(spark, sf)), OWN),
    f"{E} SELECT cap_tier AS tier, count(*) AS n, {', '.join(r(f'median({c})') + f' AS {o}' for o, c in OWN.items())} FROM e GROUP BY 1",
)
register(
    "ownership_changes",
    lambda spark, sf: groups.ownership_changes(ent(spark, sf)),
    f"""{E}, m AS (SELECT symbol, name, cap_tier, fii_holding, chg_fii_holding_3y FROM e WHERE chg_fii_holding_3y IS NOT NULL)
    SELECT * FROM (SELECT *, 'added' AS side FROM m ORDER BY chg_fii_holding_3y DESC, symbol LIMIT 6)
    UNION ALL SELECT * FROM (SELECT *, 'cut' AS side FROM m ORDER BY chg_fii_holding_3y, symbol LIMIT 6)""",
)
_PAIRS = f"""{E}, t AS (SELECT isin, unnest(list_filter([{', '.join(f"CASE WHEN {f} THEN '{f[3:]}' END" for f in FLAGS)}], lambda x: x IS NOT NULL)) AS f FROM e),
n AS (SELECT f, count(*) AS n FROM t GROUP BY 1), ord AS (SELECT * FROM (VALUES {', '.join(f"('{f[3:]}', {i})" for i, f in enumerate(FLAGS))}) o(f, i)),
p AS (SELECT a.f AS a, b.f AS b, count(*) AS overlap FROM t a JOIN t b USING (isin) JOIN ord oa ON oa.f = a.f JOIN ord ob ON ob.f = b.f WHERE oa.i < ob.i GROUP BY 1, 2),
o AS (SELECT a, b, overlap, overlap * 100e0 / n AS pct_of_a FROM p JOIN n ON n.f = a) """
register("factor_overlap", lambda spark, sf: groups.overlap_matrix(ent(spark, sf), groups.factor_columns(ent(spark, sf))), f"{_PAIRS} SELECT * FROM o")
register("factor_overlap_top", lambda spark, sf: groups.overlap_matrix(ent(spark, sf), FLAGS, 8), f"{_PAIRS} SELECT * FROM o ORDER BY overlap DESC, a, b LIMIT 8")
register(
    "factor_stats",
    lambda spark, sf: rounded(groups.factor_stats(ent(spark, sf), FLAGS), ["median_1y", "median_pe"]),
    f"{E} " + " UNION ALL ".join(
        f"""SELECT '{f[3:]}' AS factor, count(*) AS n, {S.cnt('above_ema_200')} AS above_ema200, {S.cnt('ema_stack_bullish')} AS stacked,
        {S.share('above_ema_200')} AS pct_above_ema200, {S.share('ema_stack_bullish')} AS pct_stacked, {r('median(perf_1y_pct)')} AS median_1y,
        {r('median(pe_ratio)')} AS median_pe FROM e WHERE {f}""" for f in FLAGS
    ),
)
register(
    "factors_by_tier",
    lambda spark, sf: groups.factors_by_tier(ent(spark, sf)),
    f"""{E} SELECT cap_tier AS tier, {S.cnt('is_momentum')} AS momentum, {S.cnt('is_quality')} AS quality, {S.cnt('is_value')} AS value,
    {S.cnt('is_low_volatility')} AS low_vol FROM e GROUP BY 1""",
)
BANDS = {"Large": 1100, "Mid": 220, "Small": 60, "Micro": 20}
register(
    "tier_band_violations",
    lambda spark, sf: groups.tier_band_violations(ent(spark, sf), BANDS, nominal=1500, slack=5),
    f"""{E}, n AS (SELECT greatest(0, 1500 - count(*)) AS missing FROM e), x AS (SELECT * FROM (VALUES ('Large', 1100), ('Mid', 220), ('Small', 60), ('Micro', 20), ('Unclassified', NULL)) t(tier, want)),
    g AS (SELECT tier, want, (SELECT count(*) FROM e WHERE cap_tier = tier) AS got FROM x)
    SELECT tier, got, CASE WHEN want IS NULL THEN 0 ELSE want - missing - 5 END AS low, coalesce(want + 5, 5) AS high FROM g, n
    WHERE got < CASE WHEN want IS NULL THEN 0 ELSE want - missing - 5 END OR got > coalesce(want + 5, 5)""",
)

# ------------------------------------------------------------------ tags
register(
    "tag_columns",
    lambda spark, sf: ent(spark, sf).select("isin", "cap_tier", F.col("index_count").cast("bigint").alias("index_count"), *Fr.SNAKE_TAGS, *FLAGS, "is_any_factor"),
    f"{E} SELECT isin, cap_tier, index_count, {', '.join(Fr.SNAKE_TAGS + FLAGS)}, is_any_factor FROM e",
)
register(
    "parsed_tags",
    lambda spark, sf: Fr.table(spark, sf, "part").select(
        "p_partkey", F.array_join(T.parse_tags(F.concat(F.lit(" ,"), F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(", ,"), "p_type")), "|").alias("tags")
    ),
    "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(' ,' || replace(p_name, ' ', ' , ') || ', ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM part",
)
register(
    "distinct_tags",
    lambda spark, sf: T.distinct_tags(ent(spark, sf)),
    f"{E} SELECT DISTINCT unnest(tags) AS tag FROM e",
)

# ------------------------------------------------------------------ derived
DERIVED = [
    "shares_implied", "revenue_ttm", "price_to_book", "pe_forward_derived", "dist_ema_20_pct", "dist_ema_50_pct", "dist_ema_200_pct",
    "dist_sma_50_pct", "dist_sma_200_pct", "dist_52w_high_pct", "dist_ath_pct", "dist_6m_high_pct", "dist_3m_high_pct", "dist_20d_high_pct",
    "above_52w_low_pct", "above_atl_pct", "ema_stack_bullish", "ema_stack_bearish", "above_ema_200", "above_sma_200", "pct_of_52w_range",
]
MOMENTUM = ["momentum_12_1_pct", "momentum_per_beta", "momentum_accel", "positive_windows"]
VALUATION = ["pe_vs_own_5y_pct", "pe_vs_industry_pct", "upside_to_target_pct", "earnings_yield_pct", "pbv_vs_own_5y_pct"]
CONFLICTS = ["analyst_bull_tech_bear", "analyst_bear_tech_bull", "rating_conflict", "price_up_earnings_down", "price_down_earnings_up"]
for _n, _cols in (("derived_trend", DERIVED), ("derived_momentum", MOMENTUM), ("derived_valuation", VALUATION), ("derived_conflicts", CONFLICTS)):
    _flags = {c for c in _cols if c.startswith(("ema_stack", "above_ema", "above_sma", "analyst_", "rating_", "price_up", "price_down")) or c == "positive_windows"}
    register(
        _n,
        lambda spark, sf, cols=_cols, fl=_flags: rounded(ent(spark, sf).select("isin", *cols), [c for c in cols if c not in fl]),
        f"{E} SELECT isin, {', '.join(c if c in _flags else r(c) + ' AS ' + c for c in _cols)} FROM e",
    )

# ------------------------------------------------------------------ ranks
RANKED = ["pe_ratio", "roe", "dividend_yield", "perf_1y_pct"]


def _rank(m, part=""):
    over = f"OVER (PARTITION BY {part + ', ' if part else ''}{m} IS NULL ORDER BY {m})"
    peers = f"OVER (PARTITION BY {part + ', ' if part else ''}{m})"
    whole = f"OVER ({'PARTITION BY ' + part if part else ''})"
    return f"CASE WHEN {m} IS NOT NULL {'AND ' + part + ' IS NOT NULL' if part else ''} THEN (rank() {over} + (count({m}) {peers} - 1) / 2e0) / count({m}) {whole} * 100 END"


RANK_COLUMNS = {f"pct_rank_{m}{s}": _rank(m, p) for m in RANKED for s, p in (("", ""), ("_in_sector", "sector"), ("_in_tier", "cap_tier"))}
RANK_SQL = f"SELECT isin, {', '.join(f'round({x}, 6) AS {c}' for c, x in RANK_COLUMNS.items())} FROM e"
for _n, _b in (("percentile_ranks", None), ("percentile_ranks_bucketed", 32)):
    register(
        _n,
        lambda spark, sf, b=_b: rounded(order_stats.add_percentile_ranks(
            ent(spark, sf).select("isin", "sector", "cap_tier", *RANKED), "isin", RANKED, {"sector": "sector", "tier": "cap_tier"}, b
        ).select("isin", *RANK_COLUMNS), RANK_COLUMNS),
        f"{E} {RANK_SQL}",
    )

# ------------------------------------------------------------------ catalog, quality
META = [
    ("market_cap", "Overview", "inr", "cr", "neutral"), ("price", "Performance", "inr", "0.2f", "neutral"),
    ("pe_ratio", "Valuation", "ratio", "0.2f", "lower_better"), ("peg_ratio", "Valuation", "ratio", "0.2f", "lower_better"),
    ("roe", "Profitability", "pct", "0.1f%", "higher_better"), ("roce", "Profitability", "pct", "0.1f%", "higher_better"),
    ("roic", "Profitability", "pct", "0.1f%", "higher_better"), ("debt_to_equity", "Balance Sheet", "ratio", "0.2f", "lower_better"),
    ("dividend_yield", "Dividend", "pct", "0.1f%", "higher_better"), ("high_3m", "Trend & Momentum", "inr", "0.2f", "neutral"),
    ("perf_1y_pct", "Trend & Momentum", "pct", "0.1f%", "higher_better"), ("beta_1y", "Trend & Momentum", "ratio", "0.2f", "lower_better"),
    ("symbol", "Overview", "text", "text", "neutral"), ("sector", "Overview", "text", "text", "neutral"),
    ("idx_5_low", "Index Membership", "bool", "text", "neutral"), ("analyst_rating", "Forecasts", "text", "text", "neutral"),
]
NAMES = [m[0] for m in META]


def metadata(spark):
    rows = [(n, n.upper(), seg, "Main", "", "none", "tradingview", "derived" if n.startswith("perf") else "reported", u, f, p, "") for n, seg, u, f, p in META]
    return spark.createDataFrame(rows, C.METADATA)


def catalog(spark, sf, df=None):
    df = ent(spark, sf).select(*NAMES) if df is None else df
    return C.build(df, metadata(spark), Fr.MASKED)


COV = ", ".join(f"(SELECT count({n}) FROM e) AS c{i}" for i, n in enumerate(NAMES))
COVERAGE = f"""{E}, m AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', '{seg}', '{u}', '{p}')" for i, (n, seg, u, f, p) in enumerate(META))}) t(i, name, segment, unit, polarity)),
tot AS (SELECT count(*) AS n FROM e),
nn AS (SELECT * FROM (VALUES {', '.join(f"({i}, (SELECT count({n}) FROM e))" for i, n in enumerate(NAMES))}) t(i, non_null)),
cat AS (SELECT name, segment, unit, polarity, non_null, round_even(non_null * 100e0 / n, 1) AS coverage_pct,
  name NOT IN ('roce', 'debt_to_equity', 'roic') AS finance_valid,
  name LIKE 'idx\\_%' ESCAPE '\\' OR (round_even(non_null * 100e0 / n, 1) >= 50 AND unit NOT IN ('text', 'date')) AS screenable,
  CASE WHEN name LIKE 'perf%' THEN 'derived' ELSE 'reported' END AS provenance FROM m JOIN nn USING (i), tot) """
register(
    "catalog",
    lambda spark, sf: catalog(spark, sf).select(
        "name", "segment", "unit", "polarity", "coverage_pct", "finance_valid", "screenable", "provenance", F.array_join("flags", ",").alias("flags")
    ),
    f"""{COVERAGE} SELECT name, segment, unit, polarity, coverage_pct, finance_valid, screenable, provenance,
    array_to_string(list_filter([CASE WHEN coverage_pct < 50 THEN 'low_coverage_' || CAST(round_even(coverage_pct, 0) AS INTEGER) || 'pct' END,
    CASE WHEN name LIKE 'idx%' THEN 'index_membership' END, CASE WHEN provenance <> 'reported' THEN provenance END], lambda x: x IS NOT NULL), ',') AS flags FROM cat""",
)
register("numeric_fields", lambda spark, sf: screen.numeric_fields(catalog(spark, sf)), f"{COVERAGE} SELECT name FROM cat WHERE unit IN ('pct','inr','ratio','count')")
register("screenable_fields", lambda spark, sf: screen.screenable_fields(catalog(spark, sf)), f"{COVERAGE} SELECT name FROM cat WHERE screenable")
register(
    "columns_by_segment",
    lambda spark, sf: C.by_segment(catalog(spark, sf)).select("segment", "n", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("names")),
    f"{COVERAGE} SELECT segment, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM cat GROUP BY 1",
)
register(
    "segment_summary",
    lambda spark, sf: rounded(C.segment_summary(catalog(spark, sf)), ["median_coverage"]),
    f"{COVERAGE} SELECT segment, count(*) AS columns, {S.cnt('screenable')} AS screenable, min(coverage_pct) AS min_coverage, {r('median(coverage_pct)')} AS median_coverage FROM cat GROUP BY 1",
)


def report(spark, sf):
    df = ent(spark, sf).select(*NAMES)
    return df, quality.coverage_report(df, catalog(spark, sf, df))


register(
    "coverage_report",
    lambda spark, sf: report(spark, sf)[1].select("column", "non_null", "coverage_pct", "segment", "screenable"),
    f"{COVERAGE} SELECT name AS column, non_null, coverage_pct, segment, screenable FROM cat",
)
register(
    "segment_coverage",
    lambda spark, sf: rounded(quality.segment_coverage(report(spark, sf)[1]), ["median_coverage"]),
    f"{COVERAGE} SELECT segment, count(*) AS columns, min(coverage_pct) AS min_coverage, {r('median(coverage_pct)')} AS median_coverage FROM cat GROUP BY 1",
)
register(
    "report_totals",
    lambda spark, sf: quality.totals(report(spark, sf)[1]),
    f"""{COVERAGE} SELECT count(*) AS columns_retained, {S.cnt('coverage_pct = 100')} AS fully_populated_columns,
    {S.cnt('coverage_pct < 50')} AS columns_below_50pct, {S.cnt('NOT screenable')} AS non_screenable_columns FROM cat""",
)
register(
    "masking_impact",
    lambda spark, sf: quality.masking_impact(ent(spark, sf), catalog(spark, sf), Fr.SECTOR_MASKED).withColumn("masked_list", F.array_join("masked_list", ",")),
    f"""{COVERAGE} SELECT (SELECT count(*) FROM e WHERE sector = 'MACHINERY') AS finance_companies, {S.cnt('NOT finance_valid')} AS masked_metrics,
    string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT finance_valid) AS masked_list,
    (SELECT count(*) FROM e WHERE sector = 'MACHINERY') * 100e0 / (SELECT n FROM tot) AS finance_pct_of_universe FROM cat""",
)
TWO = """WITH sold AS (SELECT l_partkey, CAST(sum(CAST(l_extendedprice / l_quantity AS DECIMAL(28,10))) AS DOUBLE) / count(*) AS b FROM lineitem GROUP BY 1),
p AS (SELECT CAST(p_partkey AS VARCHAR) AS isin, p_retailprice AS price, b AS price_screener FROM part LEFT JOIN sold ON p_partkey = l_partkey) """
register(
    "source_conflicts",
    lambda spark, sf: rounded(matching.disagreeing_pairs(Fr.parts_two_sources(spark, sf)), ["correlation", "median_abs_diff_pct"]),
    f"""{TWO} SELECT 'Price' AS concept, 'price' AS primary_col, 'price_screener' AS secondary_col, count(*) AS n_overlap, {r('corr(price, price_screener)')} AS correlation,
    {r('median(abs((price / nullif(price_screener, 0) - 1) * 100))')} AS median_abs_diff_pct,
    CASE WHEN median(abs((price / nullif(price_screener, 0) - 1) * 100)) > 5 THEN 'both retained' ELSE 'primary' END AS resolution
    FROM p WHERE price IS NOT NULL AND price_screener IS NOT NULL HAVING count(*) >= 10""",
)


def four_pairs(spark, sf):
    """Every concept that two sources report, over all parts: close, apart, and one too thin."""
    p = Fr.parts_two_sources(spark, sf)
    size, other = F.col("size").cast("double"), F.col("price_screener")
    return p.withColumns({
        "pe_ratio": F.col("price") / size, "pe_ratio_screener": other / size, "dividend_yield": size, "dividend_yield_screener": size * 1.02,
        "roce": size, "roce_screener": F.when(F.col("isin").cast("int") <= 5, size),
    })


_PAIRS = [("Price", "price", "price_screener"), ("P/E", "pe_ratio", "pe_ratio_screener"), ("Dividend yield", "dividend_yield", "dividend_yield_screener"), ("ROCE", "roce", "roce_screener")]
_GAP = "median(abs(({a} / nullif({b}, 0) - 1) * 100))"
register(
    "source_conflicts_all",
    lambda spark, sf: rounded(matching.disagreeing_pairs(four_pairs(spark, sf)), ["correlation", "median_abs_diff_pct"]),
    f"""{TWO}, f AS (SELECT p.*, price / p_size AS pe_ratio, price_screener / p_size AS pe_ratio_screener, p_size::DOUBLE AS dividend_yield, p_size * 1.02e0 AS dividend_yield_screener,
    p_size::DOUBLE AS roce, CASE WHEN p_partkey <= 5 THEN p_size::DOUBLE END AS roce_screener FROM p JOIN part ON isin = CAST(p_partkey AS VARCHAR)) """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS concept, '{a}' AS primary_col, '{b}' AS secondary_col, count(*) AS n_overlap, {r(f'corr({a}, {b})')} AS correlation, {r(_GAP.format(a=a, b=b))} AS median_abs_diff_pct,
        CASE WHEN {_GAP.format(a=a, b=b)} > 5 THEN 'both retained' ELSE 'primary' END AS resolution FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL HAVING count(*) >= 10"""
        for c, a, b in _PAIRS
    ),
)
register(
    "reconstruction_check",
    lambda spark, sf: rounded(quality.reconstruction_check(Fr.parts_two_sources(spark, sf), "price", "price_screener"), ["median_abs_err_pct"]),
    f"""{TWO} SELECT 'price_screener' AS field, 'checked' AS status, count(*) AS n_overlap, {r('median(abs((price / nullif(price_screener, 0) - 1) * 100))')} AS median_abs_err_pct,
    median(abs((price / nullif(price_screener, 0) - 1) * 100)) < 5 AS within_tolerance FROM p WHERE price IS NOT NULL AND price_screener IS NOT NULL""",
)

# ------------------------------------------------------------------ cleaning
def raw_parts(spark, sf):
    """Part prices as a raw export: awkward headers, a repeat, a currency, a thin column."""
    k = F.col("p_partkey")
    return Fr.table(spark, sf, "part").select(
        F.concat(F.lit("P"), k.cast("string")).alias("ISIN"), F.col("p_name").alias("Description"), F.col("p_retailprice").alias("Price"),
        F.lit("INR").alias("Price - Currency"), F.col("p_retailprice").alias("Price.1"),
        F.when(k % 10 == 0, F.col("p_size")).alias("Net revenue, Trailing 12 months"),
        F.lit(None).cast("string").alias("Credit rating"), F.when(k % 4 == 0, F.col("p_size")).alias("Size & weight %, 1 day"),
        (F.col("p_size") * 2).alias("Twice"), F.when(k % 2 == 0, F.col("p_size")).alias("Twice.1"),
    )


register(
    "dropped_columns",
    lambda spark, sf: clean.dropped_columns(raw_parts(spark, sf)),
    """SELECT * FROM (VALUES ('Price - Currency', 'currency', 'all values INR'), ('Price.1', 'duplicate', 're-export of ''Price'''),
    ('Credit rating', 'empty', 'no populated values'), ('Twice.1', 'duplicate', 're-export of ''Twice'' (values differ; base kept)'),
    ('Net revenue, Trailing 12 months', 'low_coverage', printf('%.1f', (SELECT count(*) FILTER (WHERE p_partkey % 10 = 0) * 100e0 / count(*) FROM part)) || '% populated; reconstructed as ''revenue_ttm'''))
    t("column", reason, detail)""",
)
register(
    "drop_reasons",
    lambda spark, sf: quality.drop_reasons(clean.dropped_columns(raw_parts(spark, sf))),
    "SELECT * FROM (VALUES ('currency', 1), ('duplicate', 2), ('empty', 1), ('low_coverage', CASE WHEN (SELECT count(*) FROM part) > 0 THEN 1 END)) t(reason, n)",
)
register(
    "normalised_names",
    lambda spark, sf: clean.normalise_names(clean.drop_dead_columns(raw_parts(spark, sf).withColumnRenamed("ISIN", "isin"))[0]),
    """SELECT 'P' || p_partkey AS isin, p_name AS name, p_retailprice AS price,
    CASE WHEN p_partkey % 4 = 0 THEN p_size END AS size_and_weight_pct_1_day, p_size * 2 AS twice FROM part""",
)
register(
    "snake_case_values",
    lambda spark, sf: Fr.table(spark, sf, "part").select("p_partkey", X.to_snake_col(F.concat("p_type", F.lit(" % of "), "p_name", F.lit(" & "), "p_brand")).alias("snake")),
    """SELECT p_partkey, regexp_replace(regexp_replace(replace(replace(lower(trim(p_type || ' % of ' || p_name || ' & ' || p_brand)), '%', ' pct '), '&', ' and '), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake FROM part""",
)


def raw_customers(spark, sf):
    k = F.col("c_custkey")
    return Fr.table(spark, sf, "customer").select(
        F.when(k % 50 != 0, k - k % 20).alias("isin"), F.when(k % 9 == 0, "USD").when(k % 4 != 0, "INR").alias("Price - Currency"),
        F.when(k % 7 == 0, "EUR").otherwise("INR").alias("Assets - Currency"),
    )


register(
    "currency_violations",
    lambda spark, sf: clean.currency_violations(raw_customers(spark, sf)),
    """SELECT 'Price - Currency' AS column, 'USD' AS value, count(*) AS n FROM customer WHERE c_custkey % 9 = 0
    UNION ALL SELECT 'Assets - Currency', 'EUR', count(*) FROM customer WHERE c_custkey % 7 = 0""",
)
register(
    "key_violations",
    lambda spark, sf: clean.key_violations(raw_customers(spark, sf)),
    """WITH k AS (SELECT CASE WHEN c_custkey % 50 <> 0 THEN c_custkey - c_custkey % 20 END AS isin FROM customer)
    SELECT 'row_count' AS rule, count(*) AS found FROM k HAVING count(*) < 735 OR count(*) > 750
    UNION ALL SELECT 'null_key', count(*) FROM k WHERE isin IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT isin FROM k WHERE isin IS NOT NULL GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""",
)
register(
    "keep_first",
    lambda spark, sf: matching.keep_first(
        Fr.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", F.struct("o_orderdate", "o_orderkey")
    ).select("o_custkey", "o_orderkey", "o_totalprice"),
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
)

# ------------------------------------------------------------------ views
PAIR = ["Customer#000000007", "customer#000000003", "Customer#000000011", "nobody"]
CMP = ["market_cap", "pe_ratio", "roe", "roce", "dividend_yield", "high_3m", "perf_1y_pct", "beta_1y"]


def compared(spark, sf):
    df = ent(spark, sf)
    return views.compare(df, catalog(spark, sf, df.select(*NAMES)), PAIR, metrics=CMP, **MASK)


_CMP = f"""{COVERAGE}, w AS (SELECT * FROM (VALUES ('CUSTOMER#000000007', 0), ('CUSTOMER#000000003', 1), ('CUSTOMER#000000011', 2)) t(s, i)),
x AS (SELECT w.i, e.* REPLACE (CASE WHEN sector <> 'MACHINERY' THEN roce END AS roce) FROM e JOIN w ON upper(symbol) = s),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, i, {c} AS v FROM x" for c in CMP)}),
g AS (SELECT name, max(v) AS hi, min(v) AS lo, count(v) AS n, greatest(abs(max(v)), abs(min(v))) AS base FROM l GROUP BY 1 HAVING count(v) > 0),
c AS (SELECT g.name, segment, unit, polarity, max(v) FILTER (WHERE i = 0) AS v0, max(v) FILTER (WHERE i = 1) AS v1, max(v) FILTER (WHERE i = 2) AS v2,
  min(i) FILTER (WHERE polarity <> 'neutral' AND v = CASE polarity WHEN 'higher_better' THEN hi ELSE lo END) AS best_index,
  any_value(CASE WHEN n >= 2 THEN (hi - lo) / nullif(base, 0) END) AS spread
  FROM g JOIN l USING (name) JOIN cat USING (name) GROUP BY ALL) """
register(
    "compare",
    lambda spark, sf: compared(spark, sf).select("name", "segment", "unit", "polarity", *[F.get("values", i).alias(f"v{i}") for i in range(3)], F.col("best_index").cast("bigint").alias("best_index"), "spread"),
    f"{_CMP} SELECT name, segment, unit, polarity, v0, v1, v2, CAST(best_index AS BIGINT) AS best_index, spread FROM c",
)
register(
    "compare_spread",
    lambda spark, sf: views.spread_ranking(compared(spark, sf), 5).select("name", "spread"),
    f"{_CMP} SELECT name, spread FROM c WHERE spread IS NOT NULL ORDER BY spread DESC, name LIMIT 5",
)
register(
    "compare_missing",
    lambda spark, sf: views.missing_symbols(ent(spark, sf), PAIR),
    f"{E} SELECT s AS symbol FROM (VALUES {', '.join(f'({s!r})' for s in PAIR)}) t(s) WHERE upper(s) NOT IN (SELECT upper(symbol) FROM e)",
)
register(
    "entity_card",
    lambda spark, sf: views.card(ent(spark, sf).select(*NAMES), catalog(spark, sf), "Customer#000000001", **MASK).select(
        "name", F.col("value").try_cast("double").alias("number"), F.when(F.col("unit") == "text", F.col("value")).alias("text"), "segment", "unit"
    ),
    f"""{COVERAGE}, x AS (SELECT * FROM e WHERE symbol = 'Customer#000000001'), l AS ({' UNION ALL '.join(
        f"SELECT '{n}' AS name, " + ("NULL" if u in ("text", "bool") else (f"CASE WHEN sector <> 'MACHINERY' THEN {n} END" if n in Fr.MASKED else n)) + " AS number, " + (n if u == "text" else "NULL") + " AS text FROM x"
        for n, _, u, _, _ in META if not n.startswith("idx_"))})
    SELECT name, number, text, segment, unit FROM l JOIN cat USING (name)""",
)
register(
    "entity_ranks",
    lambda spark, sf: rounded(views.card_ranks(order_stats.add_percentile_ranks(
        ent(spark, sf).select("isin", "symbol", "sector", "cap_tier", *RANKED), "isin", RANKED, {"sector": "sector", "tier": "cap_tier"}
    ), "CUSTOMER#000000001"), ["universe", "sector", "tier"]),
    f"""{E}, k AS ({RANK_SQL}) """ + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, pct_rank_{m} AS universe, pct_rank_{m}_in_sector AS sector, pct_rank_{m}_in_tier AS tier FROM k WHERE isin = 'K000000001'" for m in RANKED
    ),
)
register("entity_memberships", lambda spark, sf: views.card_memberships(ent(spark, sf), "customer#000000001"),
         f"{E} SELECT unnest(tags) AS tag FROM e WHERE symbol = 'Customer#000000001'")
register(
    "entity_masked_fields",
    lambda spark, sf: views.card_masked(ent(spark, sf), "Customer#000000001", **MASK),
    f"{E} SELECT unnest(['roce', 'debt_to_equity', 'roic']) AS field FROM e WHERE symbol = 'Customer#000000001' AND sector = 'MACHINERY'",
)
