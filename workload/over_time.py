"""Queries on dated snapshots: as-of reads, changes, series, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import groups, matching, screen
from panelyard.operators import history as H
from panelyard.sources import snapshots as SN
from workload import frames as Fr
from workload import sql as S
from workload.registry import r, register, rounded

HIST = S.with_(S.history())
A, B = Fr.BEFORE, Fr.AFTER
FILTERS = [("roe", "gte", 20), ("dist_ath_pct", "gt", -60)]
WHERE = "roe >= 20 AND dist_ath_pct > -60"


def hist(spark, sf):
    return Fr.history(spark, sf)


register("snapshot_dates", lambda spark, sf: SN.snapshot_dates(hist(spark, sf)), f"{HIST} SELECT DISTINCT snapshot_date FROM h")
register("snapshot_counts", lambda spark, sf: H.snapshot_counts(hist(spark, sf)), f"{HIST} SELECT snapshot_date, count(*) AS companies FROM h GROUP BY 1")
register(
    "snapshot_pair",
    lambda spark, sf: H.latest_pair(hist(spark, sf)),
    f"{HIST} SELECT CAST(min(d) AS VARCHAR) AS before, CAST(max(d) AS VARCHAR) AS after FROM (SELECT DISTINCT snapshot_date AS d FROM h ORDER BY d DESC LIMIT 2)",
)
register(
    "latest_snapshot",
    lambda spark, sf: SN.latest(hist(spark, sf)).select("snapshot_date", "isin", "price", "market_cap", "cap_tier"),
    f"{HIST} SELECT snapshot_date, isin, price, market_cap, cap_tier FROM h WHERE snapshot_date = (SELECT max(snapshot_date) FROM h)",
)
register(
    "as_of_group_medians",
    lambda spark, sf: rounded(
        groups.group_medians(SN.as_of(hist(spark, sf), A), "sector", ["perf_1y_pct", "market_cap"]).select(
            "group", "n", "perf_1y_pct_median", "market_cap_median", "pct_above_ema200"),
        ["perf_1y_pct_median", "market_cap_median"],
    ),
    f"""{HIST} SELECT sector AS "group", count(*) AS n, {r('median(perf_1y_pct)')} AS perf_1y_pct_median, {r('median(market_cap)')} AS market_cap_median,
    {S.share('above_ema_200')} AS pct_above_ema200 FROM h WHERE snapshot_date = DATE '{A}' GROUP BY 1""",
)
register(
    "snapshot_union",
    lambda spark, sf: SN.union_by_name([
        H.at(hist(spark, sf), A).select("snapshot_date", "isin", "price", "pe_ratio"),
        H.at(hist(spark, sf), B).select("isin", "snapshot_date", "roe", "price"),
    ]),
    f"""{HIST} SELECT snapshot_date, isin, price, CASE WHEN snapshot_date = DATE '{A}' THEN pe_ratio END AS pe_ratio,
    CASE WHEN snapshot_date = DATE '{B}' THEN roe END AS roe FROM h""",
)
_CH = f"""{HIST}, c AS (SELECT b.isin, b.symbol, b.name, b.cap_tier, b.sector, b.market_cap, a.price AS before, b.price AS after, b.price - a.price AS delta,
{S.signed('b.price', 'a.price')} AS pct_change FROM h a JOIN h b USING (isin) WHERE a.snapshot_date = DATE '{A}' AND b.snapshot_date = DATE '{B}'
AND a.price IS NOT NULL AND b.price IS NOT NULL) """
register("snapshot_changes", lambda spark, sf: H.changes(hist(spark, sf), "price", A, B, 100), f"{_CH} SELECT * FROM c ORDER BY abs(delta) DESC, isin LIMIT 100")
register("snapshot_changes_all", lambda spark, sf: H.changes(hist(spark, sf), "price", A, B, None), f"{_CH} SELECT * FROM c")
register(
    "change_summary",
    lambda spark, sf: rounded(H.change_summary(hist(spark, sf), "price", A, B), ["median_delta"]),
    f"{_CH} SELECT count(*) AS compared, {S.cnt('delta > 0')} AS up, {S.cnt('delta < 0')} AS down, {S.cnt('delta = 0')} AS flat, {r('median(delta)')} AS median_delta FROM c",
)
register(
    "split_movers",
    lambda spark, sf: H.split_movers(H.changes(hist(spark, sf), "price", A, B, None)).select("symbol", "delta", "side"),
    f"""{_CH} SELECT * FROM (SELECT symbol, delta, 'up' AS side FROM c WHERE delta > 0 ORDER BY abs(delta) DESC, symbol LIMIT 6)
    UNION ALL SELECT * FROM (SELECT symbol, delta, 'down' AS side FROM c WHERE delta < 0 ORDER BY abs(delta) DESC, symbol LIMIT 6)""",
)
_EL = f"""{HIST}, a AS (SELECT * FROM h WHERE snapshot_date = DATE '{A}'), b AS (SELECT * FROM h WHERE snapshot_date = DATE '{B}'),
u AS (SELECT isin, symbol, name, sector, cap_tier, market_cap, 'entered' AS change FROM b WHERE isin NOT IN (SELECT isin FROM a)
UNION ALL SELECT isin, symbol, name, sector, cap_tier, market_cap, 'left' FROM a WHERE isin NOT IN (SELECT isin FROM b)) """
register("universe_changes", lambda spark, sf: H.universe_changes(hist(spark, sf), A, B), f"{_EL} SELECT * FROM u")
register(
    "universe_stability",
    lambda spark, sf: H.universe_stability(hist(spark, sf), A, B),
    f"""{_EL} SELECT {S.cnt("change = 'entered'")} AS entered, {S.cnt("change = 'left'")} AS "left", count(*) = 0 AS stable FROM u""",
)
register(
    "tier_moves",
    lambda spark, sf: H.tier_moves(hist(spark, sf), A, B),
    f"{_EL} SELECT isin, b.symbol, b.name, a.cap_tier AS from_tier, b.cap_tier AS to_tier, b.market_cap FROM a JOIN b USING (isin) WHERE a.cap_tier <> b.cap_tier",
)
_SC = f"""{HIST}, a AS (SELECT * FROM h WHERE {WHERE} AND snapshot_date = DATE '{A}'), b AS (SELECT * FROM h WHERE {WHERE} AND snapshot_date = DATE '{B}') """
_SHOWN = "isin, symbol, name, sector, cap_tier, market_cap, perf_1y_pct"
register(
    "screen_changes",
    lambda spark, sf: H.screen_changes(hist(spark, sf), FILTERS, A, B),
    f"""{_SC} SELECT {_SHOWN}, 'entered' AS change FROM b WHERE isin NOT IN (SELECT isin FROM a)
    UNION ALL SELECT {_SHOWN}, 'exited' FROM a WHERE isin NOT IN (SELECT isin FROM b)""",
)
register(
    "screen_change_counts",
    lambda spark, sf: H.screen_change_counts(hist(spark, sf), FILTERS, A, B),
    f"""{_SC} SELECT (SELECT count(*) FROM a) AS count_before, (SELECT count(*) FROM b) AS count_after,
    (SELECT count(*) FROM b WHERE isin NOT IN (SELECT isin FROM a)) AS entered_n, (SELECT count(*) FROM a WHERE isin NOT IN (SELECT isin FROM b)) AS exited_n,
    (SELECT count(*) FROM a JOIN b USING (isin)) AS held_n""",
)
register(
    "universe_series",
    lambda spark, sf: rounded(rounded(H.universe_series(hist(spark, sf), "perf_1y_pct"), ["median", "p25", "p75"]), ["mcap_lakh_cr"], 9),
    f"""{HIST} SELECT snapshot_date, count(*) AS companies, {r('median(perf_1y_pct)')} AS median, {r('quantile_cont(perf_1y_pct, 0.25)')} AS p25,
    {r('quantile_cont(perf_1y_pct, 0.75)')} AS p75, {S.share('above_ema_200')} AS pct_above_ema200, {S.share('ema_stack_bullish')} AS pct_ema_stacked,
    {r('sum(market_cap) / 1e12', 9)} AS mcap_lakh_cr FROM h GROUP BY 1""",
)
register(
    "entity_series",
    lambda spark, sf: H.entity_series(hist(spark, sf), "customer#000000005", ["price", "market_cap", "perf_1y_pct"]),
    f"{HIST} SELECT snapshot_date, price, market_cap, perf_1y_pct FROM h WHERE symbol = 'Customer#000000005'",
)
register(
    "first_to_last",
    lambda spark, sf: H.first_to_last(hist(spark, sf), "market_cap"),
    f"""{HIST} SELECT isin, min_by(market_cap, snapshot_date) AS first, max_by(market_cap, snapshot_date) AS last, count(*) AS points,
    {S.signed('max_by(market_cap, snapshot_date)', 'min_by(market_cap, snapshot_date)')} AS change_pct FROM h GROUP BY 1""",
)

# ------------------------------------------------------------------ provenance
def provenance(spark, sf):
    """A provenance log drawn from orders: priorities as sources, months as snapshots. A
    source was supplied in the months with an open order of more than 480,000."""
    m = F.trunc("o_orderdate", "month")
    rows = Fr.table(spark, sf, "orders").groupBy(m.alias("snapshot_date"), F.col("o_orderpriority").alias("source")).agg(
        F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("top")
    )
    return rows.select(
        "snapshot_date", "source", F.concat("source", F.lit("_"), F.col("snapshot_date").cast("string")).alias("filename"),
        (~F.coalesce(F.col("top") > 480000, F.lit(False))).alias("carried_forward"),
    )


PROV = """WITH p AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date, o_orderpriority AS source,
NOT coalesce(max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') > 480000, false) AS carried_forward FROM orders GROUP BY 1, 2) """
register(
    "carry_forward",
    lambda spark, sf: matching.latest_supplied(provenance(spark, sf), "2000-06-30"),
    f"""{PROV} SELECT source, max(snapshot_date) AS from_snapshot, source || '_' || CAST(max(snapshot_date) AS VARCHAR) AS filename FROM p
    WHERE snapshot_date <= DATE '2000-06-30' AND NOT carried_forward GROUP BY 1""",
)
register(
    "snapshot_provenance",
    lambda spark, sf: SN.describe(provenance(spark, sf).withColumns({
        "built_at": F.col("snapshot_date").cast("timestamp"), "universe": F.lit(1).cast("bigint"), "columns": F.lit(1)
    })).select("snapshot_date", "sources", F.array_join("carried_forward", ",").alias("carried_forward")),
    f"{PROV} SELECT snapshot_date, count(*) AS sources, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE carried_forward), '') AS carried_forward FROM p GROUP BY 1",
)
register(
    "screen_at_snapshot",
    lambda spark, sf: screen.where_all(SN.as_of(hist(spark, sf), B), FILTERS).select("isin", "symbol", "roe", "dist_ath_pct"),
    f"{HIST} SELECT isin, symbol, roe, dist_ath_pct FROM h WHERE snapshot_date = DATE '{B}' AND {WHERE}",
)
