"""Queries on period series of suppliers: summaries, records, cohorts, drawdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions import exprs as X
from panelyard.operators import groups, matching, periods, screen
from panelyard.sources import ingest
from workload import frames as Fr
from workload import sql as S
from workload.registry import register, rounded

P = S.with_(S.profit())
SUP = S.with_(S.suppliers())
Q_PCT = ["pat_yoy_q_pct", "pat_qoq_pct", "pat_ttm_growth_pct", "profitable_qtr_pct", "pat_qtr_volatility", "pat_q_vs_peak_pct", "pat_ttm_vs_peak_rolling_pct"]
Q_SUM = ["pat_ttm", "pat_ttm_prev", "pat_ttm_peak_rolling"]
Q_RAW = ["qtrs_available", "pat_latest_q", "profitable_qtrs", "loss_qtrs", "profit_streak_qtrs", "pat_peak_q", "pat_q_at_ath", "pat_ttm_at_ath_rolling"]
Y_RAW = ["fy_available", "pat_ttm_reported", "pat_fy1", "profitable_fy", "loss_fy", "pat_peak_fy", "pat_fy_at_ath", "profit_streak_fy", "pat_growth_streak_fy"]
Y_PCT = [*[f"pat_cagr_{n}y_pct" for n in (3, 5, 7, 10, 15)], "profitable_fy_pct", "pat_vs_peak_pct"]
Q_SQL = f"SELECT isin, {', '.join(Q_RAW)}, {', '.join(f'round({c}, 4) AS {c}' for c in Q_SUM)}, {', '.join(f'round({c}, 6) AS {c}' for c in Q_PCT)} FROM qs"


def quarterly(df):
    return rounded(rounded(periods.summarise_quarterly(df), Q_PCT), Q_SUM, 4).select("isin", *Q_RAW, *Q_SUM, *Q_PCT)


def sup(spark, sf):
    return Fr.suppliers(spark, sf)


register("quarterly_summary", lambda spark, sf: quarterly(Fr.quarterly_series(spark, sf)), f"{P} {Q_SQL}")
register("quarterly_summary_wide", lambda spark, sf: quarterly(periods.with_series(Fr.quarterly_feed(spark, sf), "Q", Fr.QUARTERS)), f"{P} {Q_SQL}")
register(
    "yearly_summary",
    lambda spark, sf: rounded(periods.summarise_yearly(Fr.annual_series(spark, sf), ttm="TTM"), Y_PCT).select("isin", *Y_RAW, *Y_PCT),
    f"{P} SELECT isin, {', '.join(Y_RAW)}, {', '.join(f'round({c}, 6) AS {c}' for c in Y_PCT)} FROM ys",
)
register(
    "record_verdicts",
    lambda spark, sf: rounded(periods.record_verdict(Fr.quarterly_series(spark, sf), Fr.annual_series(spark, sf)), ["pat_ttm_vs_fy_peak_pct"]),
    f"{P} SELECT isin, round(pat_ttm_vs_fy_peak_pct, 6) AS pat_ttm_vs_fy_peak_pct, pat_ttm_at_ath, pat_both_at_ath FROM v",
)
register(
    "stored_verdicts",
    lambda spark, sf: rounded(Fr.verdicts(spark, sf), ["pat_ttm"], 4).select(*K.VERDICT_COLUMNS),
    f"""{P} SELECT isin, pat_ttm_at_ath, pat_q_at_ath, pat_both_at_ath, qtrs_available, round(pat_ttm, 4) AS pat_ttm, pat_peak_fy AS pat_fy_peak,
    pat_latest_q, pat_peak_q FROM v LEFT JOIN qs USING (isin) LEFT JOIN ys USING (isin)""",
)
register(
    "verdict_status",
    lambda spark, sf: matching.verdict_status(Fr.verdicts(spark, sf)).select("companies", F.col("fetched_at").cast("string").alias("fetched_at")),
    f"{P} SELECT count(*) AS companies, '2001-06-10 06:00:00' AS fetched_at FROM v",
)
register(
    "profit_long",
    lambda spark, sf: periods.to_long(Fr.quarterly_feed(spark, sf), "Q", periods=Fr.QUARTERS).withColumn("periods_ago", F.col("periods_ago").cast("bigint")),
    f"{P} SELECT isin, 'QL' || (periods_ago + 1) AS period, pat, CAST(periods_ago AS BIGINT) AS periods_ago, 'Q' AS freq FROM q",
)
register(
    "profit_long_annual",
    lambda spark, sf: periods.to_long(Fr.annual_feed(spark, sf), "FY", periods=Fr.YEARS).withColumn("periods_ago", F.col("periods_ago").cast("bigint")),
    f"{P} SELECT isin, 'FYL' || (CAST(years_ago AS BIGINT) + 1) AS period, pat, CAST(years_ago AS BIGINT) AS periods_ago, 'FY' AS freq FROM y WHERE pat <> 0",
)
register(
    "profit_series",
    lambda spark, sf: periods.entity_series(
        Fr.table(spark, sf, "supplier").select(Fr.supplier_key("s_suppkey").alias("isin"), F.col("s_name").alias("symbol")),
        periods.to_long(Fr.quarterly_feed(spark, sf), "Q", periods=Fr.QUARTERS), "supplier#000000003", "Q",
    ).withColumn("periods_ago", F.col("periods_ago").cast("bigint")),
    f"{P} SELECT 'QL' || (periods_ago + 1) AS period, CAST(periods_ago AS BIGINT) AS periods_ago, pat FROM q WHERE isin = 'S000000003'",
)
register(
    "padded_feed",
    lambda spark, sf: periods.pad_periods(Fr.quarterly_feed(spark, sf, 28), "Q").select("isin", F.col("QL1").alias("first"), F.col("QL28").alias("last"), F.col("QL48").alias("padded")),
    f"{P} SELECT isin, {S._at(0)} AS first, {S._at(27)} AS last, CAST(NULL AS DOUBLE) AS padded FROM ql GROUP BY 1",
)


def payload(spark, sf):
    """The feed as it arrives: upper-case headers, text cells, a repeated key, blanks."""
    feed = Fr.quarterly_feed(spark, sf)
    k = F.substring("isin", 2, 9).cast("int")
    once = feed.select(
        F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit(" "), "isin", F.lit(" "))).alias("ISIN"),
        F.when(k % 3 == 0, "n/a").otherwise(F.col("QL1").cast("string")).alias("QL1"), F.col("QL2"), k.alias(ingest.ORDINAL),
    )
    again = once.withColumns({"QL2": F.lit(1.0), ingest.ORDINAL: F.col(ingest.ORDINAL) + 1000000})
    return once.unionByName(again)


register(
    "prepared_payload",
    lambda spark, sf: ingest.prepare_payload(payload(spark, sf)).select("isin", "QL1", "QL2", "QL3"),
    f"""{P} SELECT isin, CASE WHEN CAST(substr(isin, 2) AS INTEGER) % 3 <> 0 THEN {S._at(0)} END AS "QL1", {S._at(1)} AS "QL2", CAST(NULL AS DOUBLE) AS "QL3"
    FROM ql WHERE CAST(substr(isin, 2) AS INTEGER) % 17 <> 0 GROUP BY isin""",
)
register(
    "sentinels_as_null",
    lambda spark, sf: Fr.quarterly_long(spark, sf).select("isin", F.col("qi").cast("bigint").alias("qi"), X.zero_as_null("pat").alias("pat")),
    f"{P} SELECT isin, CAST(qi AS BIGINT) AS qi, nullif(pat, 0) AS pat FROM ql",
)
register(
    "history_depth",
    lambda spark, sf: periods.history_depth(sup(spark, sf)),
    f"""{P} SELECT 'quarterly PAT' AS series, CAST(48 AS BIGINT) AS max_periods, median(qtrs_available) AS median_available, {S.cnt('qtrs_available = 48')} AS full_history_n, {S.cnt('qtrs_available < 24')} AS under_half_n FROM qs
    UNION ALL SELECT 'annual PAT', 15, median(fy_available), {S.cnt('fy_available = 15')}, {S.cnt('fy_available < 8')} FROM ys""",
)

# ------------------------------------------------------------------ wide frame
WIDE = ["isin", "symbol", "sector", "cap_tier", "market_cap", "price", "qtrs_available", "fy_available", "pat_both_at_ath", "pat_fy_at_ath", "is_alpha", "is_mnc", "above_ema_200"]
register("wide_assembly", lambda spark, sf: sup(spark, sf).select(*WIDE), f"{SUP} SELECT {', '.join(WIDE)} FROM s")
register(
    "record_profit_counts",
    lambda spark, sf: groups.record_profit_counts(sup(spark, sf)),
    f"""{SUP} SELECT count(*) AS universe, {S.cnt('pat_ttm_at_ath')} AS ttm_at_ath, {S.cnt('pat_q_at_ath')} AS q_at_ath, {S.cnt('pat_both_at_ath')} AS both_at_ath,
    {S.cnt('pat_fy_at_ath')} AS fy_at_ath, {S.cnt('pat_ttm_at_ath AND NOT pat_q_at_ath')} AS ttm_only, {S.cnt('pat_q_at_ath AND NOT pat_ttm_at_ath')} AS q_only,
    {S.cnt('NOT pat_ttm_at_ath AND pat_ttm_vs_fy_peak_pct > -10')} AS ttm_within_10,
    {S.cnt('NOT pat_ttm_at_ath AND pat_ttm_vs_fy_peak_pct <= -10 AND pat_ttm_vs_fy_peak_pct > -25')} AS ttm_10_25,
    {S.cnt('NOT pat_ttm_at_ath AND pat_ttm_vs_fy_peak_pct <= -25 AND pat_ttm_vs_fy_peak_pct > -50')} AS ttm_25_50,
    {S.cnt('pat_ttm_vs_fy_peak_pct <= -50')} AS ttm_below_50 FROM s""",
)
register(
    "record_profit_by_tier",
    lambda spark, sf: groups.record_profit_by_tier(sup(spark, sf)),
    f"""{SUP} SELECT cap_tier AS tier, count(*) AS n, {S.cnt('pat_ttm_at_ath')} AS ttm_at_ath, {S.cnt('pat_q_at_ath')} AS q_at_ath,
    {S.cnt('pat_both_at_ath')} AS both_at_ath, {S.share('pat_both_at_ath')} AS both_pct FROM s GROUP BY 1""",
)
_BIG = "ORDER BY market_cap DESC NULLS LAST, symbol LIMIT 10"
register(
    "record_profit_falling_price",
    lambda spark, sf: rounded(groups.divergent(sup(spark, sf)), ["pat_yoy_q_pct"]),
    f"{SUP} SELECT symbol, name, cap_tier, market_cap, perf_1y_pct, dist_ath_pct, round(pat_yoy_q_pct, 6) AS pat_yoy_q_pct FROM s WHERE pat_both_at_ath AND perf_1y_pct < 0 {_BIG}",
)
register("record_profit_falling_price_n", lambda spark, sf: groups.divergent_count(sup(spark, sf)), f"{SUP} SELECT count(*) AS n FROM s WHERE pat_both_at_ath AND perf_1y_pct < 0")
register(
    "rolling_over",
    lambda spark, sf: rounded(groups.rolling_over(sup(spark, sf)), ["pat_q_vs_peak_pct", "pat_yoy_q_pct"]),
    f"""{SUP} SELECT symbol, name, cap_tier, market_cap, round(pat_q_vs_peak_pct, 6) AS pat_q_vs_peak_pct, round(pat_yoy_q_pct, 6) AS pat_yoy_q_pct, perf_1y_pct
    FROM s WHERE pat_ttm_at_ath AND NOT pat_q_at_ath {_BIG}""",
)
register("preset_record_earnings", lambda spark, sf: screen.named_screen(sup(spark, sf), "record-earnings").select("isin", "symbol"), f"{SUP} SELECT isin, symbol FROM s WHERE pat_both_at_ath")
register("preset_divergent", lambda spark, sf: screen.named_screen(sup(spark, sf), "divergent").select("isin", "symbol"), f"{SUP} SELECT isin, symbol FROM s WHERE pat_both_at_ath AND perf_1y_pct < 0")
register(
    "drawdown_points",
    lambda spark, sf: rounded(groups.drawdown_points(sup(spark, sf)), ["earnings"]),
    f"{SUP} SELECT symbol, cap_tier, sector, round(pat_ttm_vs_fy_peak_pct, 6) AS earnings, dist_ath_pct AS price, market_cap FROM s WHERE dist_ath_pct IS NOT NULL AND pat_ttm_vs_fy_peak_pct > -150",
)
_E, _P = "pat_ttm_vs_fy_peak_pct", "dist_ath_pct"
register(
    "drawdown_quadrants",
    lambda spark, sf: groups.drawdown_quadrants(sup(spark, sf)),
    f"""{SUP} SELECT {S.cnt(f'{_E} > -10 AND {_P} > -20')} AS both_near_high, {S.cnt(f'{_E} > -10 AND {_P} <= -20')} AS earnings_high_price_low,
    {S.cnt(f'{_E} <= -10 AND {_P} > -20')} AS price_high_earnings_low, {S.cnt(f'{_E} <= -10 AND {_P} <= -20')} AS both_low FROM s WHERE {_E} IS NOT NULL AND {_P} IS NOT NULL""",
)

# ------------------------------------------------------------------ coverage, parity
def base(spark, sf):
    return Fr.table(spark, sf, "supplier").select(Fr.supplier_key("s_suppkey").alias("isin"), F.col("s_name").alias("symbol"))


def thin_feed(spark, sf):
    """Suppliers with a loss in a returned line of more than 104,000."""
    return Fr.table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_extendedprice > 104000").select(Fr.supplier_key("l_suppkey").alias("isin")).distinct()


THIN = f"WITH b AS (SELECT {S.supp('s_suppkey')} AS isin, s_name AS symbol FROM supplier), t AS (SELECT DISTINCT {S.supp('l_suppkey')} AS isin FROM lineitem WHERE l_returnflag = 'R' AND l_extendedprice > 104000) "
register(
    "source_coverage",
    lambda spark, sf: matching.source_coverage(base(spark, sf), {"thin": thin_feed(spark, sf), "profit_q": Fr.quarterly_feed(spark, sf)}),
    f"""{THIN} SELECT 'thin' AS source, {S.cnt('isin IN (SELECT isin FROM t)')} AS matched, count(*) AS "of", {S.cnt('isin IN (SELECT isin FROM t)')} * 100e0 / count(*) AS pct FROM b
    UNION ALL SELECT 'profit_q', count(*), count(*), 100e0 FROM b""",
)
register("unmatched_keys", lambda spark, sf: matching.unmatched(base(spark, sf), thin_feed(spark, sf), ["isin", "symbol"]), f"{THIN} SELECT * FROM b WHERE isin NOT IN (SELECT isin FROM t)")
register(
    "feed_coverage",
    lambda spark, sf: matching.feed_coverage(Fr.scan_list(spark, sf), thin_feed(spark, sf)),
    f"""{THIN}, l AS (SELECT CASE WHEN s_suppkey % 8 <> 0 THEN {S.supp('s_suppkey')} END AS isin FROM supplier), m AS (SELECT count(*) AS size, count(t.isin) AS matched FROM l LEFT JOIN t USING (isin))
    SELECT size, matched, (SELECT count(*) FROM t) AS feed_companies, size - matched AS unmatched FROM m""",
)
register(
    "verdict_states",
    lambda spark, sf: matching.verdict_state(Fr.scan_list(spark, sf), Fr.verdicts(spark, sf)).select("symbol", "profit_state"),
    f"""{P} SELECT {S.supp('s_suppkey')} AS symbol, CASE WHEN v.isin IS NULL THEN 'no_data' WHEN coalesce(pat_both_at_ath, false) THEN 'at_ath' ELSE 'not_at_ath' END AS profit_state
    FROM supplier LEFT JOIN v ON v.isin = CASE WHEN s_suppkey % 8 <> 0 THEN {S.supp('s_suppkey')} END""",
)


def other_verdicts(spark, sf):
    """Verdict by the quarter alone, for a table that disagrees."""
    return periods.summarise_quarterly(Fr.quarterly_series(spark, sf)).select("isin", F.col("pat_q_at_ath").alias("pat_both_at_ath"))


register(
    "verdict_parity",
    lambda spark, sf: matching.parity(Fr.verdicts(spark, sf), other_verdicts(spark, sf)),
    f"{P} SELECT isin, pat_both_at_ath AS a, pat_q_at_ath AS b FROM v JOIN qs USING (isin) WHERE coalesce(pat_both_at_ath, false) <> coalesce(pat_q_at_ath, false)",
)
register(
    "verdict_parity_counts",
    lambda spark, sf: matching.parity_counts(Fr.verdicts(spark, sf), other_verdicts(spark, sf)),
    f"""{P} SELECT count(v.isin) AS rows_a, count(qs.isin) AS rows_b, {S.cnt('v.isin IS NOT NULL AND qs.isin IS NOT NULL')} AS shared,
    {S.cnt('coalesce(pat_both_at_ath, false) <> coalesce(pat_q_at_ath, false)')} AS mismatched FROM v FULL JOIN qs ON v.isin = qs.isin""",
)
