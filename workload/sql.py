"""The frames of ``frames.py`` written as SQL common table expressions."""

from __future__ import annotations

from datetime import date, timedelta

from workload import frames as Fr


def _day(text: str, days: int) -> str:
    return f"TIMESTAMP '{date.fromisoformat(text) - timedelta(days=days)} 00:00:00'"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def pct(x: str, ref: str) -> str:
    return f"((({x}) / nullif({ref}, 0) - 1) * 100)"


def share(cond: str) -> str:
    return f"(avg(CASE WHEN {cond} THEN 1e0 ELSE 0e0 END) * 100)"


def cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def _mean(cond: str = "true") -> str:
    return (
        f"(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (WHERE {cond}) AS DOUBLE) "
        f"/ nullif(count(*) FILTER (WHERE {cond}), 0))"
    )


def _rating(code: str) -> str:
    return f"CASE {code} WHEN 0 THEN 'Strong buy' WHEN 1 THEN 'Buy' WHEN 2 THEN 'Neutral' WHEN 3 THEN 'Sell' END"


TIER_CASE = "CASE " + " ".join(
    f"WHEN list_contains(tags, '{t}') THEN '{name}'" for t, name in Fr.TIERS
) + " ELSE 'Unclassified' END"


def _any(members: list[str], tags: str = "tags") -> str:
    return "(" + " OR ".join(f"list_contains({tags}, '{m}')" for m in members) + ")"


def entities(name: str = "e", before: str | None = None) -> str:
    hi = before or Fr.TODAY
    y, h, q, two = (f"o_orderdate >= {_day(hi, n)}" for n in (365, 182, 91, 730))
    last = "last(o_totalprice ORDER BY o_orderdate, o_orderkey)"
    first = "first(o_totalprice ORDER BY o_orderdate, o_orderkey)"
    refs = {
        "1w": "o_orderstatus = 'F'", "1m": "o_orderstatus = 'P'", "3m": "o_orderpriority = '3-MEDIUM'",
        "6m": "o_orderpriority = '4-NOT SPECIFIED'", "1y": "o_orderpriority = '5-LOW'",
    }
    rollups = {**Fr.FACTORS, **Fr.OWNERSHIP}
    every_factor = sorted({t for m in Fr.FACTORS.values() for t in m})
    dist = {
        "ema_20": "ema_20", "ema_50": "ema_50", "ema_200": "ema_200", "sma_50": "sma_50", "sma_200": "sma_200",
        "high_52w": "52w_high", "high_all_time": "ath", "high_6m": "6m_high", "high_3m": "3m_high",
        "donchian_20_upper": "20d_high",
    }
    f = lambda c: f"coalesce({c}, false)"
    up = " + ".join(f"CAST({f(f'perf_{w}_pct > 0')} AS BIGINT)" for w in refs)
    return f"""
{name}_o AS (
  SELECT o_custkey, count(*) AS n_orders,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS market_cap,
    {last} AS price, {first} AS first_price,
    max(o_totalprice) AS high_all_time, min(o_totalprice) AS low_all_time,
    max(o_totalprice) FILTER (WHERE {y}) AS high_52w, min(o_totalprice) FILTER (WHERE {y}) AS low_52w,
    max(o_totalprice) FILTER (WHERE {h}) AS high_6m, max(o_totalprice) FILTER (WHERE {q}) AS high_3m,
    {_mean()} AS ema_200, {_mean(two)} AS ema_50, {_mean(y)} AS ema_20,
    {_mean("o_orderpriority <= '2-HIGH'")} AS sma_50, {_mean("o_orderstatus = 'O'")} AS sma_200,
    {", ".join(f"{_mean(c)} AS r{w}" for w, c in refs.items())},
    list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE {two})) AS tag_list
  FROM orders {f"WHERE o_orderdate < {_day(before, 0)}" if before else ""} GROUP BY o_custkey
  {f"HAVING max(o_orderdate) >= {_day(before, Fr.ACTIVE_DAYS)}" if before else ""}),
{name}_r AS (
  SELECT 'K' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS isin, c_name AS symbol,
    n_name || ' ' || c_name AS name, c_mktsegment AS sector, n_name AS industry,
    coalesce(tag_list, []) AS tags, array_to_string(tag_list, ',') AS index_tags,
    market_cap, price, high_all_time, low_all_time, high_52w, low_52w, high_6m, high_3m,
    high_3m AS donchian_20_upper, ema_20, ema_50, ema_200, sma_50, sma_200,
    {pct("price", "first_price")} AS chg_1d_pct,
    {", ".join(f"{pct('price', f'r{w}')} AS perf_{w}_pct" for w in refs)},
    price / nullif(c_acctbal, 0) AS pe_ratio, price / (nullif(c_acctbal, 0) * n_orders) AS peg_ratio,
    c_acctbal / 100 AS roe, c_acctbal / 50 - 20 AS roce, c_acctbal / 75 AS roic,
    n_orders / 8e0 AS debt_to_equity,
    CASE WHEN n_orders % 3 <> 0 THEN n_orders * 0.5e0 END AS dividend_yield,
    CAST(c_custkey % 100 AS DOUBLE) AS rsi_14, CAST(c_custkey % 75 AS DOUBLE) AS promoter_holding,
    CAST(c_custkey % 40 AS DOUBLE) AS fii_holding, CAST(c_custkey % 30 AS DOUBLE) AS dii_holding,
    CAST((c_custkey * 7) % 41 - 20 AS DOUBLE) AS chg_fii_holding_3y,
    CAST((c_custkey * 5) % 31 - 15 AS DOUBLE) AS chg_dii_holding_3y,
    CASE WHEN c_custkey % 6 <> 0 THEN CAST((c_custkey * 3) % 21 - 10 AS DOUBLE) END AS chg_promoter_holding_3y,
    CASE WHEN n_orders % 4 <> 0 THEN n_orders * 10 END AS employees,
    c_acctbal / 50 AS revenue_growth_ttm_yoy, c_acctbal / 100 - 30 AS net_income_growth_ttm_yoy,
    CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS revenue_per_share,
    c_acctbal + 5000 AS book_value_per_share,
    CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 10 END AS eps_estimate_annual,
    ema_200 / 4000e0 AS historical_pe_5y,
    CASE WHEN c_custkey % 5 <> 0 THEN ema_50 / 5000e0 END AS historical_pbv_5y,
    60e0 AS industry_pe, sma_200 AS target_price_1y,
    CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 20) / 10e0 END AS beta_1y,
    {_rating("c_custkey % 5")} AS analyst_rating, {_rating("(c_custkey // 5) % 5")} AS technical_rating
  FROM customer {"" if before else "LEFT"} JOIN {name}_o ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey),
{name}_b AS (
  SELECT *, {TIER_CASE} AS cap_tier, len(tags) AS index_count,
    {", ".join(f"list_contains(tags, '{t}') AS {c}" for t, c in zip(Fr.TAGS, Fr.SNAKE_TAGS))},
    {", ".join(f"{_any(m)} AS is_{g}" for g, m in rollups.items())},
    {_any(every_factor)} AS is_any_factor,
    {div("market_cap", "price")} AS shares_implied,
    revenue_per_share * {div("market_cap", "price")} AS revenue_ttm,
    {div("price", "book_value_per_share")} AS price_to_book,
    {div("price", "eps_estimate_annual")} AS pe_forward_derived,
    {", ".join(f"{pct('price', c)} AS dist_{p}_pct" for c, p in dist.items())},
    {pct("price", "low_52w")} AS above_52w_low_pct, {pct("price", "low_all_time")} AS above_atl_pct,
    {f("price > ema_20 AND ema_20 > ema_50 AND ema_50 > ema_200")} AS ema_stack_bullish,
    {f("price < ema_20 AND ema_20 < ema_50 AND ema_50 < ema_200")} AS ema_stack_bearish,
    {f("price > ema_200")} AS above_ema_200, {f("price > sma_200")} AS above_sma_200,
    {div("price - low_52w", "high_52w - low_52w")} * 100 AS pct_of_52w_range,
    ((1 + perf_1y_pct / 100) / nullif(1 + perf_1m_pct / 100, 0) - 1) * 100 AS momentum_12_1_pct,
    {div("perf_1y_pct", "beta_1y")} AS momentum_per_beta,
    perf_3m_pct - perf_1y_pct / 4 AS momentum_accel, {up} AS positive_windows,
    {pct("pe_ratio", "historical_pe_5y")} AS pe_vs_own_5y_pct, {pct("pe_ratio", "industry_pe")} AS pe_vs_industry_pct,
    {pct("target_price_1y", "price")} AS upside_to_target_pct, {div("100e0", "pe_ratio")} AS earnings_yield_pct,
    {f("analyst_rating IN ('Buy','Strong buy') AND technical_rating IN ('Sell','Strong sell')")} AS analyst_bull_tech_bear,
    {f("analyst_rating IN ('Sell','Strong sell') AND technical_rating IN ('Buy','Strong buy')")} AS analyst_bear_tech_bull,
    {f("perf_1y_pct > 0 AND net_income_growth_ttm_yoy < 0")} AS price_up_earnings_down,
    {f("perf_1y_pct < 0 AND net_income_growth_ttm_yoy > 0")} AS price_down_earnings_up
  FROM {name}_r),
{name} AS (
  SELECT *, {pct("price_to_book", "historical_pbv_5y")} AS pbv_vs_own_5y_pct,
    (analyst_bull_tech_bear OR analyst_bear_tech_bull) AS rating_conflict FROM {name}_b)"""


def history() -> str:
    parts = [entities(f"h{i}", day) for i, day in enumerate(Fr.SNAPSHOTS)]
    union = " UNION ALL BY NAME ".join(
        f"SELECT *, DATE '{d}' AS snapshot_date FROM h{i}" for i, d in enumerate(Fr.SNAPSHOTS)
    )
    return ",".join(parts) + f",\nh AS ({union})"


SUPP = "'S' || lpad(CAST({} AS VARCHAR), 9, '0')"


def supp(c: str) -> str:
    return SUPP.format(c)


def quarterly() -> str:
    """ql (isin, periods_ago, pat, raw, qi) and q: the same with sentinels as null."""
    return f"""
ql_s AS (
  SELECT l_suppkey, (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS qi,
    CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END)
      * CASE WHEN l_suppkey % 3 > 0 THEN 4e0 ** (year(l_shipdate) - 1995) * quarter(l_shipdate) ELSE 1 END AS DECIMAL(18,4))) AS DOUBLE) AS raw
  FROM lineitem GROUP BY l_suppkey, 2),
ql AS (
  SELECT {supp("l_suppkey")} AS isin, (SELECT max(qi) FROM ql_s) - qi AS periods_ago, qi, raw,
    CASE WHEN (l_suppkey + qi) % 11 = 0 THEN 0e0 ELSE raw END AS pat FROM ql_s),
q AS (SELECT isin, periods_ago, qi, pat, CAST(pat AS DECIMAL(18,4)) AS d FROM ql WHERE pat <> 0)"""


def annual() -> str:
    """y (isin, years_ago, pat) and yt (isin, ttm): reported figures, no sentinels."""
    return f"""
y AS (
  SELECT isin, (periods_ago + qi) // 4 - qi // 4 AS years_ago, CAST(sum(CAST(raw AS DECIMAL(18,4))) AS DOUBLE) AS pat
  FROM ql GROUP BY ALL),
yt AS (SELECT isin, CAST(sum(CAST(raw AS DECIMAL(18,4))) FILTER (WHERE periods_ago < 4) AS DOUBLE) AS ttm FROM ql GROUP BY isin)"""


def _four(lo: int) -> str:
    inside = f"periods_ago BETWEEN {lo} AND {lo + 3}"
    return (
        f"CASE WHEN count(*) FILTER (WHERE {inside}) = 4 THEN "
        f"CAST(sum(d) FILTER (WHERE {inside}) AS DOUBLE) END"
    )


def _at(k: int, col: str = "pat", ago: str = "periods_ago") -> str:
    return f"max({col}) FILTER (WHERE {ago} = {k})"


def signed(a: str, b: str) -> str:
    return f"((({a}) / nullif(abs({b}), 0) - 1) * 100)"


def quarterly_summary() -> str:
    """qs: one row per isin."""
    return f"""
q_run AS (
  SELECT isin, count(*) AS run FROM (
    SELECT isin, periods_ago, row_number() OVER (PARTITION BY isin ORDER BY periods_ago) - 1 AS rn FROM q WHERE pat > 0)
  WHERE rn = periods_ago GROUP BY isin),
q_roll AS (
  SELECT isin, max(CAST(s AS DOUBLE)) AS top FROM (
    SELECT isin, sum(d) OVER w AS s, count(*) OVER w AS n FROM q
    WINDOW w AS (PARTITION BY isin ORDER BY periods_ago RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING))
  WHERE n = 4 GROUP BY isin),
q_agg AS (
  SELECT isin, count(*) AS qtrs_available, {_at(0)} AS pat_latest_q, {_at(1)} AS q2, {_at(4)} AS q5,
    {_four(0)} AS pat_ttm, {_four(4)} AS pat_ttm_prev,
    {cnt("pat > 0")} AS profitable_qtrs, {cnt("pat < 0")} AS loss_qtrs,
    stddev_samp(pat) / nullif(abs(avg(pat)), 0) * 100 AS pat_qtr_volatility, max(pat) AS pat_peak_q
  FROM q GROUP BY isin),
qs AS (
  SELECT a.isin, qtrs_available, pat_latest_q, {signed("pat_latest_q", "q5")} AS pat_yoy_q_pct,
    {signed("pat_latest_q", "q2")} AS pat_qoq_pct, pat_ttm, pat_ttm_prev,
    {signed("pat_ttm", "pat_ttm_prev")} AS pat_ttm_growth_pct, profitable_qtrs, loss_qtrs,
    profitable_qtrs / qtrs_available * 100 AS profitable_qtr_pct, pat_qtr_volatility,
    coalesce(run, 0) AS profit_streak_qtrs, pat_peak_q, {signed("pat_latest_q", "pat_peak_q")} AS pat_q_vs_peak_pct,
    coalesce(pat_latest_q >= pat_peak_q AND pat_peak_q > 0, false) AS pat_q_at_ath,
    top AS pat_ttm_peak_rolling, {signed("pat_ttm", "top")} AS pat_ttm_vs_peak_rolling_pct,
    coalesce(pat_ttm >= top AND top > 0, false) AS pat_ttm_at_ath_rolling
  FROM q_agg a LEFT JOIN q_run USING (isin) LEFT JOIN q_roll USING (isin))"""


def _cagr(n: int) -> str:
    return (
        f"CASE WHEN fy1 > 0 AND f{n} > 0 THEN (pow(fy1 / f{n}, 1e0 / {n - 1}) - 1) * 100 END"
    )


def yearly_summary() -> str:
    """ys: one row per isin."""
    return f"""
y_run AS (
  SELECT isin, count(*) AS run FROM (
    SELECT isin, years_ago, row_number() OVER (PARTITION BY isin ORDER BY years_ago) - 1 AS rn FROM y WHERE pat > 0)
  WHERE rn = years_ago GROUP BY isin),
y_grow AS (
  SELECT isin, count(*) AS run FROM (
    SELECT isin, years_ago, row_number() OVER (PARTITION BY isin ORDER BY years_ago) - 1 AS rn FROM (
      SELECT a.isin, a.years_ago FROM y a JOIN y b ON a.isin = b.isin AND b.years_ago = a.years_ago + 1 WHERE a.pat > b.pat))
  WHERE rn = years_ago GROUP BY isin),
y_agg AS (
  SELECT isin, count(*) AS fy_available, {_at(0, ago="years_ago")} AS fy1, {_at(2, ago="years_ago")} AS f3,
    {", ".join(f"{_at(n - 1, ago='years_ago')} AS f{n}" for n in (5, 7, 10, 15))}, {cnt("pat > 0")} AS profitable_fy, {cnt("pat < 0")} AS loss_fy, max(pat) AS pat_peak_fy
  FROM y GROUP BY isin),
ys AS (
  SELECT a.isin, fy_available, ttm AS pat_ttm_reported, fy1 AS pat_fy1, {", ".join(f"{_cagr(n)} AS pat_cagr_{n}y_pct" for n in (3, 5, 7, 10, 15))},
    profitable_fy, loss_fy, profitable_fy / fy_available * 100 AS profitable_fy_pct, pat_peak_fy,
    {signed("fy1", "pat_peak_fy")} AS pat_vs_peak_pct, coalesce(fy1 >= pat_peak_fy AND pat_peak_fy > 0, false) AS pat_fy_at_ath,
    coalesce(r.run, 0) AS profit_streak_fy, coalesce(g.run, 0) AS pat_growth_streak_fy
  FROM y_agg a LEFT JOIN yt USING (isin) LEFT JOIN y_run r USING (isin) LEFT JOIN y_grow g USING (isin))"""


def verdict() -> str:
    """v: record verdict per isin."""
    return f"""
v AS (
  SELECT isin, {signed("pat_ttm", "pat_peak_fy")} AS pat_ttm_vs_fy_peak_pct,
    coalesce(pat_ttm >= pat_peak_fy AND pat_peak_fy > 0, false) AS pat_ttm_at_ath,
    coalesce(pat_ttm >= pat_peak_fy AND pat_peak_fy > 0, false) AND coalesce(pat_q_at_ath, false) AS pat_both_at_ath
  FROM qs FULL JOIN ys USING (isin))"""


def profit() -> str:
    return ",".join([quarterly(), annual(), quarterly_summary(), yearly_summary(), verdict()])


def bars() -> str:
    return f"""
bars AS (
  SELECT {supp("l_suppkey")} AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS close, CASE WHEN sum(l_orderkey) % 97 = 0 THEN 2e0 ELSE 0e0 END AS split_ratio
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""


def benchmark() -> str:
    return """
bench AS (
  SELECT date, CAST(sum(CAST(close AS DECIMAL(28,10))) AS DOUBLE) / count(*) AS close FROM bars GROUP BY date)"""


def adjusted(source: str = "bars", name: str = "adj") -> str:
    return f"""
{name} AS (
  SELECT symbol, date, high, close, split_ratio, f AS split_factor, high / f AS adj_high FROM (
    SELECT *, coalesce(pow(2, sum(CASE WHEN split_ratio > 0 THEN 1 ELSE 0 END) OVER (
      PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1e0) AS f
    FROM (SELECT * FROM {source}))),
{name}_top AS (
  SELECT symbol, max(adj_high) AS ath_price, min_by(date, (-adj_high, date)) AS ath_date, max(date) AS last_bar
  FROM {name} GROUP BY symbol)"""


def suppliers() -> str:
    """s: supplier entities."""
    cut = "date >= DATE '2000-11-04'"
    tier = "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(Fr.SUPPLIER_TIER_TAGS)) + " END"
    names = ["Large", "Mid", "Small", "Micro"]
    tier_name = "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(names)) + " ELSE 'Unclassified' END"
    marks = ", ".join(f"CASE WHEN s_suppkey % {m} = 0 THEN '{t}' END" for t, m in Fr.SUPPLIER_FACTOR_TAGS)
    return ",".join([profit(), bars(), f"""
sb AS (
  SELECT symbol AS isin, max_by(close, date) AS price, min_by(close, date) FILTER (WHERE {cut}) AS year_ago,
    max(high) AS high_all_time, max(high) FILTER (WHERE {cut}) AS high_52w, min(close) FILTER (WHERE {cut}) AS low_52w,
    CAST(sum(CAST(close AS DECIMAL(28,10))) AS DOUBLE) / count(*) AS ema_200
  FROM bars GROUP BY symbol),
s AS (
  SELECT {supp("s_suppkey")} AS isin, s_name AS symbol, r_name || ' ' || s_name AS name, r_name AS sector,
    n_name AS industry, s_acctbal * 1000 AS market_cap, concat_ws(' , ', {tier}, {marks}) AS index_tags,
    {tier_name} AS cap_tier, sb.* EXCLUDE (isin), qs.* EXCLUDE (isin), ys.* EXCLUDE (isin), v.* EXCLUDE (isin),
    {pct("price", "year_ago")} AS perf_1y_pct, {pct("price", "high_all_time")} AS dist_ath_pct,
    {pct("price", "high_52w")} AS dist_52w_high_pct, coalesce(price > ema_200, false) AS above_ema_200,
    s_suppkey % 2 = 0 AS is_momentum, s_suppkey % 3 = 0 AS is_alpha, s_suppkey % 5 = 0 AS is_quality,
    s_suppkey % 4 = 0 AS is_value, s_suppkey % 7 = 0 AS is_mnc
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN sb ON sb.isin = {supp("s_suppkey")} LEFT JOIN qs ON qs.isin = {supp("s_suppkey")}
  LEFT JOIN ys ON ys.isin = {supp("s_suppkey")} LEFT JOIN v ON v.isin = {supp("s_suppkey")})"""])


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


TIER_SORT = "CASE tier WHEN 'Large' THEN 1 WHEN 'Mid' THEN 2 WHEN 'Small' THEN 3 ELSE 4 END"


def scan() -> str:
    """Stored triggers (trig), scan list (lst), window bars (wb), history bars (hb)."""
    k = "CAST(substr(symbol, 2, 9) AS INTEGER)"
    s = supp("s_suppkey")
    return ",".join([bars(), f"""
hb AS (SELECT * FROM bars WHERE date < DATE '{Fr.SCAN_START}'),
wb AS (SELECT * FROM bars WHERE date >= DATE '{Fr.SCAN_START}' AND date < DATE '{Fr.SCAN_END}')""",
        adjusted("hb", "ha"), f"""
trig AS (
  SELECT symbol, ath_price, ath_date, CASE WHEN {k} % 4 = 0 THEN ath_price * 1.1e0 END AS today_ath,
    CASE WHEN {k} % 5 <> 0 THEN last_bar END AS last_split_check, TIMESTAMP '2001-05-01 00:00:00' AS last_updated
  FROM (SELECT * REPLACE (ath_price * ({k} % 7 + 1) / 50 AS ath_price) FROM ha_top WHERE ath_date >= DATE '1998-01-01')),
lst AS (
  SELECT {s} AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN 'BSE' ELSE 'NSE' END AS exchange,
    CASE WHEN s_suppkey % 8 <> 0 THEN {s} END AS isin, CAST(s_suppkey AS VARCHAR) AS accord_code,
    CASE WHEN s_suppkey % 8 <> 0 THEN 'auto' ELSE 'unresolved' END AS resolution,
    s_suppkey % 13 = 0 AS ignored, CASE WHEN s_suppkey % 13 = 0 THEN 'delisted' END AS ignore_reason,
    'list.csv' AS source_file FROM supplier),
act AS (SELECT symbol, exchange, isin FROM lst WHERE NOT ignored),
swb AS (SELECT wb.* FROM wb JOIN act USING (symbol)),
win AS (
  SELECT symbol, pow(2, count(*)) AS ratio, max(date) AS split_date FROM swb WHERE split_ratio > 0 GROUP BY symbol),
due AS (
  SELECT t.*, ratio, split_date,
    coalesce(ratio IS NOT NULL AND ath_price IS NOT NULL AND (last_split_check IS NULL OR split_date > last_split_check), false) AS due
  FROM trig t LEFT JOIN win USING (symbol)),
rep AS (
  SELECT symbol, CASE WHEN due THEN ath_price / ratio ELSE ath_price END AS ath_price, ath_date, today_ath,
    CASE WHEN due THEN coalesce(greatest(last_split_check, split_date), split_date) ELSE last_split_check END AS last_split_check
  FROM due),
lastp AS (
  SELECT symbol, max_by(high, date) AS today_high, max_by(close, date) AS today_close,
    max(close) FILTER (WHERE rn = 2) AS prev_close, count(close) AS closes
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM swb) GROUP BY symbol),
hits AS (
  SELECT act.*, today_high, today_close, prev_close, ath_price AS trigger
  FROM act JOIN lastp USING (symbol) JOIN rep USING (symbol)
  WHERE closes >= 2 AND ath_price IS NOT NULL AND round_even(today_high, 2) >= round_even(ath_price, 2)),
rd AS (
  SELECT CASE WHEN s_acctbal > 1000 THEN '' ELSE 'OLD-' END || {s} AS symbol, CASE WHEN s_suppkey % 4 <> 3 THEN CAST(DATE '2001-06-05' + CAST(s_suppkey % 20 AS INTEGER) AS DATE) END AS result_date,
    CASE WHEN s_suppkey % 4 <> 3 THEN 'announced' ELSE 'not_announced' END AS status,
    CASE WHEN s_suppkey % 6 <> 0 THEN TIMESTAMP '2001-06-14 00:00:00' + to_hours(CAST(s_suppkey % 36 AS INTEGER)) END AS checked_at
  FROM supplier)"""])
