"""Queries on daily bars, the record-high scan, the scan list, and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelyard.functions import exprs as X
from panelyard.operators import prices, scanner, screen, universe
from panelyard.plans import scan as plan
from panelyard.session import cut_lineage
from workload import frames as Fr
from workload import sql as S
from workload.registry import register, rounded

BARS = S.with_(S.bars(), S.adjusted())
SCAN = S.with_(S.scan())
FULL = S.with_(S.scan(), S.benchmark(), S.profit())
AS_OF = f"TIMESTAMP '{Fr.AS_OF}'"


# ------------------------------------------------------------------ bars
register(
    "split_factors",
    lambda spark, sf: prices.adjusted_highs(Fr.bars(spark, sf)).select("symbol", "date", "split_factor", "adj_high"),
    f"{BARS} SELECT symbol, date, split_factor, adj_high FROM adj",
)
register("lifetime_highs", lambda spark, sf: prices.lifetime_highs(Fr.bars(spark, sf)), f"{BARS} SELECT * FROM adj_top")
register(
    "last_prices",
    lambda spark, sf: prices.last_prices(Fr.bars(spark, sf)),
    f"""{BARS} SELECT symbol, max_by(high, date) AS today_high, max_by(close, date) AS today_close, max(close) FILTER (WHERE rn = 2) AS prev_close, count(close) AS closes
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) GROUP BY 1""",
)
register(
    "window_splits",
    lambda spark, sf: prices.window_splits(Fr.bars(spark, sf).where(F.col("date") >= F.lit("2001-01-01").cast("date"))),
    f"{BARS} SELECT symbol, pow(2, count(*)) AS ratio, max(date) AS split_date FROM bars WHERE split_ratio > 0 AND date >= DATE '2001-01-01' GROUP BY 1",
)
register("benchmark", lambda spark, sf: rounded(Fr.benchmark(spark, sf), ["close"]), f"{S.with_(S.bars(), S.benchmark())} SELECT date, round(close, 6) AS close FROM bench")


def _rs_sql(n, source="bars"):
    return f"""rs AS (SELECT symbol, count(*) AS n, max(ratio) FILTER (WHERE rn = {n}) AS anchor, max(ratio) FILTER (WHERE rn = 1) AS last, max(ratio) AS top FROM (
      SELECT symbol, b.close / x.close AS ratio, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM {source} b JOIN bench x USING (date)) WHERE rn <= {n} GROUP BY 1),
    rsv AS (SELECT symbol, CASE WHEN n < {n} OR coalesce(anchor, 0) = 0 THEN 'N/A' WHEN last / anchor * 100 >= top / anchor * 100 * 0.9999 THEN 'Y' ELSE 'N' END AS ath_outperformance,
      CASE WHEN n = {n} THEN round_even(last / nullif(anchor, 0) * 100, 2) END AS current_rs, CASE WHEN n = {n} THEN round_even(top / nullif(anchor, 0) * 100, 2) END AS ath_rs FROM rs)"""


for _n in (211, 21, 600):
    register(
        f"relative_strength_{_n}",
        lambda spark, sf, n=_n: prices.relative_strength(Fr.bars(spark, sf), Fr.benchmark(spark, sf), n),
        f"{S.with_(S.bars(), S.benchmark(), _rs_sql(_n))} SELECT * FROM rsv",
    )


def wide_bars(spark, sf):
    """Regions as tickers: one wide row per day, with both column layouts and one ticker
    without closes."""
    days = Fr.bars(spark, sf).select("date", F.col("high"), F.col("close"), F.substring("symbol", 10, 1).alias("t"))
    cols = []
    for t in "01234":
        on = F.col("t").isin(t, str(int(t) + 5))
        layout = "{f}|T{t}" if int(t) % 2 else "T{t}|{f}"
        cols.append(F.max(F.when(on, F.col("high"))).alias(layout.format(f="High", t=t)))
        if t != "4":
            cols.append(F.min(F.when(on, F.col("close"))).alias(layout.format(f="Close", t=t)))
        cols.append(F.count(F.when(on, 1)).alias(f"Volume|T{t}"))
    return days.groupBy("date").agg(*cols)


register(
    "bars_from_wide",
    lambda spark, sf: prices.bars_from_wide(wide_bars(spark, sf)).select("symbol", "date", "high", "close"),
    f"""{S.with_(S.bars())} SELECT 'T' || CAST(substr(symbol, 10, 1) AS INTEGER) % 5 AS symbol, date, max(high) AS high,
    CASE WHEN CAST(substr(symbol, 10, 1) AS INTEGER) % 5 <> 4 THEN min(close) END AS close FROM bars GROUP BY date, CAST(substr(symbol, 10, 1) AS INTEGER) % 5""",
)


# ------------------------------------------------------------------ scan
def active(spark, sf):
    return universe.active(Fr.scan_list(spark, sf))


def scanned(spark, sf):
    return Fr.window_bars(spark, sf).join(active(spark, sf).select("symbol"), "symbol", "left_semi")


def repaired(spark, sf):
    return scanner.repair_splits(Fr.triggers(spark, sf), scanned(spark, sf), Fr.as_of())


def hits(spark, sf):
    return scanner.find_hits(active(spark, sf), repaired(spark, sf)[0], scanned(spark, sf))


STATE = ["symbol", "ath_price", "ath_date", "today_ath", "last_split_check"]
EVENT = ["symbol", "event_date", "old_price", "new_price", "old_date", "new_date", "source", "note"]
EVENT_SQL = "symbol, {d} AS event_date, {old} AS old_price, {new} AS new_price, {od} AS old_date, {d} AS new_date, '{s}' AS source, {note} AS note"
SEED_DUETS = """SELECT symbol, ath_date AS event_date, CAST(NULL AS DOUBLE) AS old_price, ath_price AS new_price, CAST(NULL AS DATE) AS old_date,
ath_date AS new_date, 'seed' AS source, CAST(NULL AS VARCHAR) AS note FROM ha_top JOIN act USING (symbol) WHERE symbol NOT IN (SELECT symbol FROM trig)"""
SPLIT_DUETS = "SELECT " + EVENT_SQL.format(d="split_date", old="ath_price", new="ath_price / ratio", od="ath_date", s="split", note="'split ratio ' || CAST(ratio AS VARCHAR)") + " FROM due WHERE due"
register("cleared_today", lambda spark, sf: scanner.clear_today(Fr.triggers(spark, sf)).select(*STATE), f"{SCAN} SELECT symbol, ath_price, ath_date, CAST(NULL AS DOUBLE) AS today_ath, last_split_check FROM trig")
register(
    "seeded_state",
    lambda spark, sf: scanner.seed_missing(Fr.triggers(spark, sf), active(spark, sf), Fr.history_bars(spark, sf), Fr.as_of())[0].select(*STATE),
    f"""{SCAN} SELECT {', '.join(STATE)} FROM trig UNION ALL
    SELECT symbol, ath_price, ath_date, NULL, last_bar FROM ha_top JOIN act USING (symbol) WHERE symbol NOT IN (SELECT symbol FROM trig)""",
)
register("seed_events", lambda spark, sf: scanner.seed_missing(Fr.triggers(spark, sf), active(spark, sf), Fr.history_bars(spark, sf), Fr.as_of())[1].select(*EVENT), f"{SCAN} {SEED_DUETS}")
register("repaired_state", lambda spark, sf: repaired(spark, sf)[0].select(*STATE), f"{SCAN} SELECT {', '.join(STATE)} FROM rep")
register("split_events", lambda spark, sf: repaired(spark, sf)[1].select(*EVENT), f"{SCAN} {SPLIT_DUETS}")
register(
    "repair_twice",
    lambda spark, sf: scanner.repair_splits(repaired(spark, sf)[0], scanned(spark, sf), Fr.as_of())[0].select(*STATE),
    f"{SCAN} SELECT {', '.join(STATE)} FROM rep",
)
register("scan_hits", lambda spark, sf: hits(spark, sf), f"{SCAN} SELECT * FROM hits")
register(
    "scan_failed",
    lambda spark, sf: scanner.failed_symbols(active(spark, sf), scanned(spark, sf)),
    f"{SCAN} SELECT symbol FROM act LEFT JOIN lastp USING (symbol) WHERE NOT coalesce(today_high IS NOT NULL AND closes >= 2, false)",
)


def run(spark, sf):
    """Bars are a stored table in practice; here they are derived once and written."""
    bars = cut_lineage(Fr.bars(spark, sf))
    return plan.run(
        Fr.scan_list(spark, sf), Fr.triggers_from(Fr.before_scan(bars)), bars, Fr.in_scan(bars), prices.daily_mean(bars),
        Fr.verdicts(spark, sf), Fr.result_dates(spark, sf), Fr.as_of(), 21,
    )


# The whole plan seeds its missing triggers from all bars up to the time of the scan.
_RUN = f"""{FULL}, known AS (SELECT * FROM bars WHERE date <= CAST({AS_OF} AS DATE)), {S.adjusted('known', 'fa')}, {_rs_sql(21, 'known')},
t0 AS (SELECT symbol, ath_price, last_split_check FROM trig UNION ALL
  SELECT symbol, ath_price, last_bar FROM fa_top JOIN act USING (symbol) WHERE symbol NOT IN (SELECT symbol FROM trig)),
t1 AS (SELECT symbol, CASE WHEN coalesce(ratio IS NOT NULL AND (last_split_check IS NULL OR split_date > last_split_check), false) THEN ath_price / ratio ELSE ath_price END AS trigger_price
  FROM t0 LEFT JOIN win USING (symbol)),
res AS (SELECT a.symbol, today_high AS new_ath_price, trigger_price, CASE WHEN today_close >= prev_close THEN 'Y' ELSE 'N' END AS green_candle,
  CASE WHEN today_close > trigger_price THEN 'Y' ELSE 'N' END AS close_gt_ath, coalesce(ath_outperformance, 'N/A') AS ath_outperformance, current_rs, ath_rs,
  CASE WHEN v.isin IS NULL THEN 'no_data' WHEN pat_both_at_ath THEN 'at_ath' ELSE 'not_at_ath' END AS profit_state,
  coalesce(result_date <= CAST({AS_OF} AS DATE) AND result_date >= DATE '2001-06-10', false) AS profit_stale, result_date
  FROM act a JOIN lastp USING (symbol) JOIN t1 USING (symbol) LEFT JOIN rsv USING (symbol) LEFT JOIN v ON v.isin = a.isin LEFT JOIN rd USING (symbol)
  WHERE closes >= 2 AND round_even(today_high, 2) >= round_even(trigger_price, 2)) """
register("scan_results", lambda spark, sf: run(spark, sf).results.drop("stop_loss"), f"{_RUN} SELECT * FROM res")
register(
    "scan_summary",
    lambda spark, sf: plan.summary(run(spark, sf)),
    f"""{_RUN} SELECT (SELECT count(*) FROM res) AS hits, (SELECT count(*) FROM act LEFT JOIN lastp USING (symbol) WHERE NOT coalesce(today_high IS NOT NULL AND closes >= 2, false)) AS failed,
    (SELECT count(*) FROM fa_top JOIN act USING (symbol) WHERE symbol NOT IN (SELECT symbol FROM trig)) AS seeded""",
)


def selected(spark, sf):
    """Symbols ticked for promotion: suppliers of about half the nations."""
    return Fr.table(spark, sf, "supplier").where("s_nationkey < 12").select(Fr.supplier_key("s_suppkey").alias("symbol"))


def promoted(spark, sf):
    return scanner.promote(Fr.triggers(spark, sf), selected(spark, sf), F.lit("2001-06-15").cast("date"), Fr.as_of())


_DUE = f"symbol IN (SELECT {S.supp('s_suppkey')} FROM supplier WHERE s_nationkey < 12) AND today_ath > coalesce(ath_price, 0)"
register(
    "promoted_state",
    lambda spark, sf: promoted(spark, sf)[0].select(*STATE),
    f"""{SCAN} SELECT symbol, CASE WHEN {_DUE} THEN today_ath ELSE ath_price END AS ath_price, CASE WHEN {_DUE} THEN DATE '2001-06-15' ELSE ath_date END AS ath_date,
    CAST(NULL AS DOUBLE) AS today_ath, last_split_check FROM trig""",
)
SYNC_DUETS = "SELECT " + EVENT_SQL.format(d="DATE '2001-06-15'", old="ath_price", new="today_ath", od="ath_date", s="sync", note="CAST(NULL AS VARCHAR)") + f" FROM trig WHERE {_DUE}"
register("sync_events", lambda spark, sf: promoted(spark, sf)[1].select(*EVENT), f"{SCAN} {SYNC_DUETS}")


def edits(spark, sf):
    k = F.col("s_suppkey")
    return Fr.table(spark, sf, "supplier").where("s_acctbal > 7000").select(
        Fr.supplier_key("s_suppkey").alias("symbol"), (F.col("s_acctbal") + 1000).alias("price"), F.date_add(F.lit("2001-01-01").cast("date"), (k % 100).cast("int")).alias("date")
    )


register(
    "manual_edits",
    lambda spark, sf: scanner.manual_edit(Fr.triggers(spark, sf), edits(spark, sf), Fr.as_of())[0].select(*STATE),
    f"""{SCAN}, m AS (SELECT {S.supp('s_suppkey')} AS symbol, s_acctbal + 1000 AS p, CAST(DATE '2001-01-01' + CAST(s_suppkey % 100 AS INTEGER) AS DATE) AS d FROM supplier WHERE s_acctbal > 7000)
    SELECT symbol, coalesce(p, ath_price) AS ath_price, coalesce(d, ath_date) AS ath_date, today_ath, CASE WHEN p IS NOT NULL THEN DATE '2001-06-15' ELSE last_split_check END AS last_split_check
    FROM trig FULL JOIN m USING (symbol)""",
)


def event_log(spark, sf):
    """Every split ever seen in the bars as one logged repair."""
    b = Fr.bars(spark, sf).where("split_ratio > 0")
    return b.select(
        "symbol", F.col("date").alias("event_date"), F.lit(None).cast("double").alias("old_price"), F.col("high").alias("new_price"),
        F.lit(None).cast("date").alias("old_date"), F.col("date").alias("new_date"), F.lit("split").alias("source"), F.lit("split ratio 2.0").alias("note"),
        F.col("date").cast("timestamp").alias("created_at"),
    ).unionByName(promoted(spark, sf)[1])


register(
    "repeated_splits",
    lambda spark, sf: scanner.repeated_splits(event_log(spark, sf)),
    f"{BARS} SELECT symbol, count(*) AS split_events FROM bars WHERE split_ratio > 0 GROUP BY 1 HAVING count(*) >= 2",
)
register(
    "symbol_events",
    lambda spark, sf: scanner.symbol_events(event_log(spark, sf), "S000000004", 4).drop("created_at"),
    f"""{SCAN}, l AS (SELECT symbol, date AS event_date, CAST(NULL AS DOUBLE) AS old_price, high AS new_price, 'split' AS source, 'split ratio 2.0' AS note, CAST(date AS TIMESTAMP) AS created_at FROM bars WHERE split_ratio > 0
    UNION ALL SELECT symbol, event_date, old_price, new_price, source, note, {AS_OF} FROM ({SYNC_DUETS}))
    SELECT event_date AS date, old_price, new_price, source, note FROM l WHERE symbol = 'S000000004' ORDER BY created_at DESC, event_date DESC, source LIMIT 4""",
)
register(
    "sync_status",
    lambda spark, sf: scanner.sync_status(hits(spark, sf), event_log(spark, sf), Fr.as_of()),
    f"""{SCAN}, y AS (SELECT DISTINCT symbol FROM ({SYNC_DUETS})) SELECT count(*) AS rows, count(y.symbol) AS synced_today, count(*) > 0 AND count(*) = count(y.symbol) AS post_sync FROM hits LEFT JOIN y USING (symbol)""",
)


def reset_state(spark, sf):
    """Rows that are left after a reset that keeps the log, and after one that wipes it."""
    state, log = Fr.triggers(spark, sf), event_log(spark, sf)
    kept, wiped = scanner.reset(state, log), scanner.reset(state, log, wipe_events=True)
    left = {"triggers": state, "log": log, "triggers after": kept[0], "log kept": kept[1], "log wiped": wiped[1]}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in left.items()]
    return reduce(lambda x, y: x.union(y), rows)


register(
    "reset_state", reset_state,
    f"""{SCAN}, n AS (SELECT (SELECT count(*) FROM trig) AS t, (SELECT count(*) FROM bars WHERE split_ratio > 0) + (SELECT count(*) FROM ({SYNC_DUETS})) AS l)
    SELECT 'triggers' AS what, t AS n FROM n UNION ALL SELECT 'log', l FROM n UNION ALL SELECT 'triggers after', 0 UNION ALL SELECT 'log kept', l FROM n UNION ALL SELECT 'log wiped', 0""",
)
register("prefix_search", lambda spark, sf: screen.prefix_search(Fr.triggers(spark, sf), "s00000002", 200).select("symbol", "ath_price", "ath_date"),
         f"{SCAN} SELECT symbol, ath_price, ath_date FROM trig WHERE symbol ILIKE 's00000002%' ORDER BY symbol LIMIT 200")


# ------------------------------------------------------------------ scan list
def parsed(spark, sf):
    return universe.parse_upload(Fr.upload(spark, sf), "up.csv", "ord")


def resolved(spark, sf):
    return universe.resolve(parsed(spark, sf), Fr.identifier_feed(spark, sf), "ORD")


def stored(spark, sf):
    """A list that is held already; suppliers with a balance of 6,000 or more are in it under
    another symbol; some are set by hand."""
    k = F.col("s_suppkey")
    return Fr.table(spark, sf, "supplier").select(
        F.concat(F.when(F.col("s_acctbal") < 6000, "S-").otherwise("T-"), k.cast("string")).alias("symbol"), F.lit("NSE").alias("exchange"), F.when(k % 2 == 1, F.concat(F.lit("H"), k.cast("string"))).alias("isin"),
        F.lit("old").alias("accord_code"), F.when(k % 9 == 0, "manual").otherwise("unresolved").alias("resolution"), (k % 5 == 0).alias("ignored"),
        F.when(k % 5 == 0, "suspended").alias("ignore_reason"), F.lit("first.csv").alias("source_file"),
    )


_UP = f"""WITH up AS (SELECT CASE WHEN s_acctbal > 3000 THEN 'S-' ELSE 'R-' END || s_suppkey AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN 'BSE' ELSE 'NSE' END AS exchange, 'up.csv' AS source_file FROM supplier),
fd AS (SELECT CASE WHEN s_nationkey <> 7 THEN 'S-' ELSE 'X-' END || s_suppkey AS symbol, {S.supp('s_suppkey')} AS isin, CAST(s_suppkey AS VARCHAR) AS accord_code, s_suppkey % 7 = 0 AS dead FROM supplier),
rs AS (SELECT symbol, exchange, isin, accord_code, CASE WHEN dead IS NULL THEN 'unresolved' ELSE 'auto' END AS resolution, coalesce(dead, false) AS ignored, CASE WHEN dead THEN 'delisted' END AS ignore_reason, source_file FROM up LEFT JOIN fd USING (symbol)),
st AS (SELECT CASE WHEN s_acctbal < 6000 THEN 'S-' ELSE 'T-' END || s_suppkey AS symbol, 'NSE' AS exchange, CASE WHEN s_suppkey % 2 = 1 THEN 'H' || s_suppkey END AS isin, 'old' AS accord_code, CASE WHEN s_suppkey % 9 = 0 THEN 'manual' ELSE 'unresolved' END AS resolution,
  s_suppkey % 5 = 0 AS ignored, CASE WHEN s_suppkey % 5 = 0 THEN 'suspended' END AS ignore_reason, 'first.csv' AS source_file FROM supplier),
mg AS (SELECT coalesce(r.symbol, s.symbol) AS symbol, coalesce(r.exchange, s.exchange) AS exchange,
  CASE WHEN r.symbol IS NULL OR s.resolution = 'manual' THEN s.isin ELSE coalesce(r.isin, s.isin) END AS isin, CASE WHEN r.symbol IS NULL THEN s.accord_code ELSE r.accord_code END AS accord_code,
  CASE WHEN r.symbol IS NULL OR s.resolution = 'manual' THEN s.resolution ELSE r.resolution END AS resolution, coalesce(s.ignored, false) OR coalesce(r.ignored, false) AS ignored,
  coalesce(r.ignore_reason, s.ignore_reason) AS ignore_reason, coalesce(r.source_file, s.source_file) AS source_file,
  CASE WHEN r.symbol IS NULL THEN 'kept' WHEN s.symbol IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM rs r FULL JOIN st s ON r.symbol = s.symbol) """
register("parsed_upload", lambda spark, sf: parsed(spark, sf), f"{_UP} SELECT * FROM up")
register("resolved_upload", lambda spark, sf: resolved(spark, sf), f"{_UP} SELECT * FROM rs")
register("merged_list", lambda spark, sf: universe.merge(stored(spark, sf), resolved(spark, sf)), f"{_UP} SELECT * FROM mg")
register(
    "upload_report",
    lambda spark, sf: universe.upload_report(universe.merge(stored(spark, sf), resolved(spark, sf)), resolved(spark, sf)),
    f"""{_UP} SELECT {S.cnt("change = 'inserted'")} AS inserted, {S.cnt("change = 'updated'")} AS updated, {S.cnt("change = 'kept'")} AS missing,
    (SELECT count(*) FROM rs WHERE resolution = 'auto') AS resolved, (SELECT count(*) FROM rs) AS total FROM mg""",
)
register(
    "cleared_list",
    lambda spark, sf: universe.upload_report(universe.merge(universe.clear(stored(spark, sf)), resolved(spark, sf)), resolved(spark, sf)),
    f"""{_UP} SELECT count(*) AS inserted, 0 AS updated, 0 AS missing, count(*) FILTER (WHERE resolution = 'auto') AS resolved, count(*) AS total FROM rs""",
)
register("absent_from_upload", lambda spark, sf: universe.absent_from_upload(stored(spark, sf), parsed(spark, sf)), f"{_UP} SELECT symbol FROM st WHERE symbol NOT IN (SELECT symbol FROM up)")


_MAPPED = "(symbol IN (SELECT 'S-' || s_suppkey FROM supplier WHERE s_nationkey < 5))"


def mapping(spark, sf):
    return Fr.table(spark, sf, "supplier").where("s_nationkey < 5").select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("symbol"), F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("isin"))


register(
    "mapped_keys",
    lambda spark, sf: universe.map_keys(stored(spark, sf), mapping(spark, sf)).select("symbol", "isin", "resolution"),
    f"""{_UP} SELECT symbol, CASE WHEN {_MAPPED} THEN 'M' || substr(symbol, 3) ELSE isin END AS isin,
    CASE WHEN {_MAPPED} THEN 'manual' ELSE resolution END AS resolution FROM st""",
)
register("removed_symbols", lambda spark, sf: universe.remove(stored(spark, sf), mapping(spark, sf)).select("symbol"), f"{_UP} SELECT symbol FROM st WHERE NOT {_MAPPED}")
register("active_list", lambda spark, sf: active(spark, sf), f"{SCAN} SELECT * FROM act")
register("unresolved_list", lambda spark, sf: universe.unresolved(Fr.scan_list(spark, sf)), f"{SCAN} SELECT symbol, exchange FROM lst WHERE resolution = 'unresolved' AND NOT ignored")
register(
    "identifiers",
    lambda spark, sf: universe.identifiers(Fr.identifier_feed(spark, sf).drop("COMPANY NAME")),
    f"""SELECT CASE WHEN s_nationkey <> 7 THEN 'S-' ELSE 'X-' END || s_suppkey AS nse_code, {S.supp('s_suppkey')} AS isin, CAST(s_suppkey AS VARCHAR) AS accord_code, CAST(NULL AS VARCHAR) AS company_name,
    CASE WHEN s_suppkey % 7 = 0 THEN 'Delisted' ELSE 'Active' END AS trading_status FROM supplier""",
)


def found_dates(spark, sf):
    k = F.col("s_suppkey")
    return Fr.table(spark, sf, "supplier").where("s_nationkey >= 20").select(Fr.supplier_key("s_suppkey").alias("symbol"), F.when(k % 10 == 0, F.lit("2001-07-01").cast("date")).alias("result_date"))


register(
    "stored_dates",
    lambda spark, sf: universe.store_dates(Fr.result_dates(spark, sf), found_dates(spark, sf), Fr.as_of()).select("symbol", "result_date", "status", F.col("checked_at").cast("string").alias("checked_at")),
    f"""{SCAN}, f AS (SELECT {S.supp('s_suppkey')} AS symbol, CASE WHEN s_suppkey % 10 = 0 THEN DATE '2001-07-01' END AS d FROM supplier WHERE s_nationkey >= 20)
    SELECT coalesce(f.symbol, rd.symbol) AS symbol, CASE WHEN f.symbol IS NULL THEN result_date ELSE d END AS result_date,
    CASE WHEN f.symbol IS NULL THEN status WHEN d IS NULL THEN 'not_announced' ELSE 'announced' END AS status,
    CAST(CASE WHEN f.symbol IS NULL THEN checked_at ELSE {AS_OF} END AS VARCHAR) AS checked_at FROM rd FULL JOIN f ON rd.symbol = f.symbol""",
)
register(
    "due_for_check",
    lambda spark, sf: universe.due_for_check(active(spark, sf), Fr.result_dates(spark, sf), Fr.as_of()),
    f"""{SCAN} SELECT a.symbol, CASE WHEN rd.symbol IS NULL THEN true WHEN result_date IS NOT NULL THEN result_date < CAST({AS_OF} AS DATE)
    ELSE checked_at IS NULL OR checked_at < {AS_OF} - INTERVAL 24 HOUR END AS needs_check FROM act a LEFT JOIN rd USING (symbol)""",
)
register("date_list", lambda spark, sf: universe.date_list(active(spark, sf), Fr.result_dates(spark, sf)), f"{SCAN} SELECT a.symbol, result_date, status FROM act a LEFT JOIN rd USING (symbol)")
register(
    "stale_verdicts",
    lambda spark, sf: Fr.result_dates(spark, sf).select("symbol", X.profit_is_stale("result_date", F.lit("2001-06-10 06:00:00").cast("timestamp"), Fr.as_of()).alias("stale")),
    f"{SCAN} SELECT symbol, coalesce(result_date <= CAST({AS_OF} AS DATE) AND result_date >= DATE '2001-06-10', false) AS stale FROM rd",
)
register(
    "feed_freshness",
    lambda spark, sf: Fr.result_dates(spark, sf).select("symbol", F.round(X.feed_age_hours("checked_at", Fr.as_of()), 6).alias("age_hours"), X.feed_is_stale("checked_at", Fr.as_of()).alias("stale")),
    f"{SCAN} SELECT symbol, round(epoch({AS_OF} - checked_at) / 3600e0, 6) AS age_hours, coalesce(CAST(checked_at AS DATE) <> CAST({AS_OF} AS DATE), true) AS stale FROM rd",
)

# ------------------------------------------------------------------ scalar functions
register(
    "scalar_arithmetic",
    lambda spark, sf: Fr.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        X.safe_div("l_extendedprice", "l_discount").alias("div"), X.pct_from("l_extendedprice", F.col("l_quantity") * 1000).alias("pct"),
        F.round(X.signed_change("l_quantity", F.col("l_tax") * 100 - 4), 6).alias("signed"), F.round(X.cagr(F.col("l_quantity") - 3, F.col("l_tax") * 100 - 1, 2), 6).alias("cagr"),
        F.round(X.range_position("l_quantity", F.lit(10.0), F.round(F.col("l_tax") * 1000)), 6).alias("pos"), X.zero_as_null("l_discount").alias("disc"),
    ),
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_extendedprice / nullif(l_discount, 0) AS div, (l_extendedprice / nullif(l_quantity * 1000, 0) - 1) * 100 AS pct,
    round((l_quantity / nullif(abs(l_tax * 100 - 4), 0) - 1) * 100, 6) + 0e0 AS signed,
    round(CASE WHEN l_quantity - 3 > 0 AND l_tax * 100 - 1 > 0 THEN (pow((l_quantity - 3) / (l_tax * 100 - 1), 0.5e0) - 1) * 100 END, 6) AS cagr,
    round(CASE WHEN round(l_tax * 1000) > 10 THEN greatest(0e0, least(100e0, (l_quantity - 10) * 100 / (round(l_tax * 1000) - 10))) END, 6) AS pos, nullif(l_discount, 0) AS disc FROM lineitem""",
)
register(
    "symbol_normalisation",
    lambda spark, sf: Fr.table(spark, sf, "part").select(
        "p_partkey", X.normal_symbol(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" "))).alias("symbol"),
        X.normal_symbol(F.when(F.col("p_size") % 2 == 0, "  ")).alias("blank"), X.exchange(F.concat("p_type", F.when(F.col("p_size") % 3 == 0, " bse").otherwise(" nse"))).alias("exchange"),
        X.ticker(F.col("p_partkey").cast("string"), X.exchange(F.when(F.col("p_size") % 3 == 0, "BSE"))).alias("ticker"),
    ),
    """SELECT p_partkey, upper(replace(p_name, ' ', '-')) AS symbol, CAST(NULL AS VARCHAR) AS blank, CASE WHEN p_size % 3 = 0 THEN 'BSE' ELSE 'NSE' END AS exchange,
    p_partkey || CASE WHEN p_size % 3 = 0 THEN '.BO' ELSE '.NS' END AS ticker FROM part""",
)
register(
    "lenient_numbers",
    lambda spark, sf: Fr.table(spark, sf, "events").select(
        "event_id", X.lenient_number(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).otherwise("1,234.5")).alias("v")
    ),
    "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN value END AS v FROM events",
)
register(
    "date_in_file_name",
    lambda spark, sf: Fr.table(spark, sf, "orders").select(
        "o_orderkey", X.date_in_name(F.concat(
            F.lit("/in/2099-01-01/Export_"), F.date_format("o_orderdate", "yyyy-MM-dd").substr(1, 0),
            F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy_MM_dd"))
            .when(F.col("o_orderkey") % 4 == 2, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-45"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("_x.csv"),
        )).alias("d"),
    ),
    "SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 AND o_orderkey % 4 <> 2 THEN CAST(o_orderdate AS DATE) END AS d FROM orders",
)


def announcement():
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    said = (
        F.when(k % 6 == 0, F.date_format(d, "d MMMM yyyy")).when(k % 6 == 1, F.date_format(d, "dd MMM yyyy")).when(k % 6 == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 6 == 3, F.date_format(d, "d-M-yyyy")).when(k % 6 == 4, "Tomorrow").otherwise("to be announced")
    )
    return F.concat(
        F.lit("<html><div><p>Past result date: 1 Jan 1990</p><div>Upcoming <b>result</b> date: <span><i>"), said,
        F.lit("</i></span></div><p>Upcoming result date of others is listed elsewhere: see the long list below</p></div></html>"),
    ).alias("html")


register(
    "announced_dates",
    lambda spark, sf: Fr.table(spark, sf, "orders").select("o_orderkey", announcement()).select("o_orderkey", X.result_date("html", F.lit("2001-08-15 10:00:00").cast("timestamp")).alias("d")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 6 = 4 THEN DATE '2001-08-16' END AS d FROM orders",
)
register(
    "announced_dates_in_pages",
    lambda spark, sf: Fr.table(spark, sf, "pages").select("page_id", X.result_date("html", F.lit("2001-08-15 10:00:00").cast("timestamp")).alias("d"), F.lower("html").contains("upcoming result date").alias("announced")),
    "SELECT page_id, CAST(NULL AS DATE) AS d, contains(lower(html), 'upcoming result date') AS announced FROM pages",
)
register(
    "candles",
    lambda spark, sf: Fr.bars(spark, sf).select("symbol", "date", X.green_candle("close", F.nullif(F.col("split_ratio") * 500, F.lit(0.0))).alias("green"), X.closed_above("close", F.col("high") * 0.999).alias("above")),
    f"""{BARS} SELECT symbol, date, CASE WHEN split_ratio = 0 THEN 'N/A' WHEN close >= split_ratio * 500 THEN 'Y' ELSE 'N' END AS green,
    CASE WHEN close > high * 0.999e0 THEN 'Y' ELSE 'N' END AS above FROM bars""",
)
