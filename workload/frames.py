"""Entity, period, bar, snapshot and scan frames derived from the benchmark tables.

Customers and their orders stand for entities in a cross section; suppliers and their
line items stand for entities with profit series and daily bars. All frames cover the
whole tables. Money is summed as decimals, so a sum does not depend on its order.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import tags as T
from panelyard.functions.exprs import safe_div, to_snake
from panelyard.operators import derive, matching, periods, prices

# The day that lookback windows count from; orders are not cut by it.
TODAY = "2001-08-02"
# A snapshot is the state up to its date: all orders before it, of customers that were active then.
ACTIVE_DAYS = 180
SNAPSHOTS = ("2000-01-01", TODAY)
BEFORE, AFTER = SNAPSHOTS

SECTOR_MASKED = "MACHINERY"
MASKED = ["roce", "debt_to_equity", "roic"]
TIERS = [("1-URGENT", "Large"), ("2-HIGH", "Mid"), ("3-MEDIUM", "Small"), ("4-NOT SPECIFIED", "Micro")]
FACTORS = {
    "momentum": ["1-URGENT"],
    "quality": ["2-HIGH", "3-MEDIUM"],
    "value": ["4-NOT SPECIFIED"],
    "low_volatility": ["5-LOW", "1-URGENT"],
}
OWNERSHIP = {"mnc": ["5-LOW"]}
TAGS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

QUARTERS = 48
YEARS = 15
SCAN_START, SCAN_END = "2001-05-01", "2001-05-15"
AS_OF = "2001-06-15 18:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _day(text: str, days: int) -> Column:
    return F.lit(date.fromisoformat(text) - timedelta(days=days)).cast("timestamp_ntz")


def _mean(condition: str = "true") -> str:
    money = "CAST(o_totalprice AS DECIMAL(18,4))"
    return (
        f"try_divide(CAST(sum({money}) FILTER (WHERE {condition}) AS DOUBLE), "
        f"count(*) FILTER (WHERE {condition}))"
    )


def _rating(code: str) -> str:
    return f"CASE {code} WHEN 0 THEN 'Strong buy' WHEN 1 THEN 'Buy' WHEN 2 THEN 'Neutral' WHEN 3 THEN 'Sell' END"


def entities_raw(spark: SparkSession, sf: str, before: str | None = None) -> DataFrame:
    """One row per customer, over all its orders (none: nulls); or, as of a day, over its orders
    before it, one row per customer whose last one is at most ACTIVE_DAYS old."""
    hi = before or TODAY
    since = {
        n: f"o_orderdate >= TIMESTAMP_NTZ '{date.fromisoformat(hi) - timedelta(days=n)}'" for n in (91, 182, 365, 730)
    }
    at = "struct(o_orderdate, o_orderkey)"
    aggregates = {
        "n_orders": "count(*)",
        "market_cap": "CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE)",
        "price": f"max_by(o_totalprice, {at})",
        "first_price": f"min_by(o_totalprice, {at})",
        "high_all_time": "max(o_totalprice)",
        "low_all_time": "min(o_totalprice)",
        "high_52w": f"max(o_totalprice) FILTER (WHERE {since[365]})",
        "low_52w": f"min(o_totalprice) FILTER (WHERE {since[365]})",
        "high_6m": f"max(o_totalprice) FILTER (WHERE {since[182]})",
        "high_3m": f"max(o_totalprice) FILTER (WHERE {since[91]})",
        "ema_200": _mean(),
        "ema_50": _mean(since[730]),
        "ema_20": _mean(since[365]),
        "sma_50": _mean("o_orderpriority <= '2-HIGH'"),
        "sma_200": _mean("o_orderstatus = 'O'"),
        "r1w": _mean("o_orderstatus = 'F'"),
        "r1m": _mean("o_orderstatus = 'P'"),
        "r3m": _mean("o_orderpriority = '3-MEDIUM'"),
        "r6m": _mean("o_orderpriority = '4-NOT SPECIFIED'"),
        "r1y": _mean("o_orderpriority = '5-LOW'"),
        # At most one entry per priority, whatever the number of orders.
        "tag_set": f"collect_set(o_orderpriority) FILTER (WHERE {since[730]})",
        "last_order": "max(o_orderdate)",
    }
    d = F.col("o_orderdate")
    orders = table(spark, sf, "orders")
    orders = orders.where(d < _day(before, 0)) if before else orders
    o = orders.groupBy("o_custkey").agg(*[F.expr(f"{sql} AS {name}") for name, sql in aggregates.items()])
    o = o.where(F.col("last_order") >= _day(before, ACTIVE_DAYS)) if before else o
    joined = (
        table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "inner" if before else "left")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    k = "c_custkey"
    columns = {
        "isin": f"concat('K', lpad(CAST({k} AS STRING), 9, '0'))",
        "symbol": "c_name",
        "name": "concat_ws(' ', n_name, c_name)",
        "sector": "c_mktsegment",
        "industry": "n_name",
        "index_tags": "nullif(array_join(array_sort(tag_set), ','), '')",
        **{c: c for c in (
            "market_cap", "price", "high_all_time", "low_all_time", "high_52w", "low_52w", "high_6m", "high_3m",
            "ema_20", "ema_50", "ema_200", "sma_50", "sma_200",
        )},
        "donchian_20_upper": "high_3m",
        "chg_1d_pct": "(try_divide(price, first_price) - 1) * 100",
        **{f"perf_{w}_pct": f"(try_divide(price, r{w}) - 1) * 100" for w in ("1w", "1m", "3m", "6m", "1y")},
        "pe_ratio": "try_divide(price, c_acctbal)",
        "peg_ratio": "try_divide(price, c_acctbal * n_orders)",
        "roe": "c_acctbal / 100",
        "roce": "c_acctbal / 50 - 20",
        "roic": "c_acctbal / 75",
        "debt_to_equity": "n_orders / 8D",
        "dividend_yield": "CASE WHEN n_orders % 3 <> 0 THEN n_orders * 0.5D END",
        "rsi_14": f"CAST({k} % 100 AS DOUBLE)",
        "promoter_holding": f"CAST({k} % 75 AS DOUBLE)",
        "fii_holding": f"CAST({k} % 40 AS DOUBLE)",
        "dii_holding": f"CAST({k} % 30 AS DOUBLE)",
        "chg_fii_holding_3y": f"CAST(({k} * 7) % 41 - 20 AS DOUBLE)",
        "chg_dii_holding_3y": f"CAST(({k} * 5) % 31 - 15 AS DOUBLE)",
        "chg_promoter_holding_3y": f"CASE WHEN {k} % 6 <> 0 THEN CAST(({k} * 3) % 21 - 10 AS DOUBLE) END",
        "employees": "CASE WHEN n_orders % 4 <> 0 THEN n_orders * 10 END",
        "revenue_growth_ttm_yoy": "c_acctbal / 50",
        "net_income_growth_ttm_yoy": "c_acctbal / 100 - 30",
        "revenue_per_share": f"CASE WHEN {k} % 9 <> 0 THEN c_acctbal END",
        "book_value_per_share": "c_acctbal + 5000",
        "eps_estimate_annual": f"CASE WHEN {k} % 4 <> 0 THEN c_acctbal / 10 END",
        "historical_pe_5y": "ema_200 / 4000D",
        "historical_pbv_5y": f"CASE WHEN {k} % 5 <> 0 THEN ema_50 / 5000D END",
        "industry_pe": "60D",
        "target_price_1y": "sma_200",
        "beta_1y": f"CASE WHEN {k} % 7 <> 0 THEN ({k} % 20) / 10D END",
        "analyst_rating": _rating(f"{k} % 5"),
        "technical_rating": _rating(f"({k} DIV 5) % 5"),
    }
    return joined.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def entities(spark: SparkSession, sf: str, before: str | None = None) -> DataFrame:
    raw = entities_raw(spark, sf, before)
    tagged = T.add_tag_columns(raw, tag_names=TAGS, tier_rules=TIERS, factors=FACTORS, ownership=OWNERSHIP)
    return derive.add_all(tagged)


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Both snapshots; a filter on the date drops the other one before it is read."""
    parts = [
        entities(spark, sf, day).withColumn("snapshot_date", F.lit(day).cast("date"))
        for day in SNAPSHOTS
    ]
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------------ suppliers
def supplier_key(c: str) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 9, "0"))


def newest_quarter(spark: SparkSession, sf: str) -> Column:
    """The number of the latest quarter that has line items, from 0 for early 1995."""
    d = F.col("last")
    return table(spark, sf, "lineitem").agg(F.max("l_shipdate").alias("last")).select((F.year(d) - 1995) * 4 + F.quarter(d) - 1).scalar()


def quarterly_long(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("l_shipdate")
    qi = (F.year(d) - 1995) * 4 + F.quarter(d) - 1
    # Two suppliers of three grow fourfold a year and by quarters within it, so that many are at a record.
    growth = F.when(F.col("l_suppkey") % 3 > 0, F.pow(F.lit(4), F.year(d) - 1995) * F.quarter(d)).otherwise(1)
    signed = F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * growth
    sums = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", qi.alias("qi"))
        .agg(F.sum(signed.cast("decimal(18,4)")).cast("double").alias("pat"))
    )
    zero = (F.col("l_suppkey") + F.col("qi")) % 11 == 0
    return sums.select(
        supplier_key("l_suppkey").alias("isin"),
        (newest_quarter(spark, sf) - F.col("qi")).alias("periods_ago"),
        F.when(zero, 0.0).otherwise(F.col("pat")).alias("pat"),
        F.col("pat").alias("raw"),
        "qi",
    )


def quarterly_feed(spark: SparkSession, sf: str, slots: int = QUARTERS) -> DataFrame:
    """Wide feed: QL1 = latest quarter."""
    long = quarterly_long(spark, sf)
    return long.groupBy("isin").agg(*[
        F.max(F.when(F.col("periods_ago") == i, F.col("pat"))).alias(f"QL{i + 1}") for i in range(slots)
    ])


def annual_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Wide feed: FYL1 = latest year with line items, and the trailing year as reported."""
    long = quarterly_long(spark, sf)
    long = long.withColumn("years_ago", F.floor((F.col("periods_ago") + F.col("qi")) / 4) - F.floor(F.col("qi") / 4))
    raw = F.col("raw").cast("decimal(18,4)")
    years = [F.sum(F.when(F.col("years_ago") == i, raw)).cast("double").alias(f"FYL{i + 1}") for i in range(YEARS)]
    ttm = F.sum(F.when(F.col("periods_ago") < 4, raw)).cast("double").alias("TTM")
    return long.groupBy("isin").agg(*years, ttm)


def quarterly_series(spark: SparkSession, sf: str) -> DataFrame:
    return periods.series_from_long(quarterly_long(spark, sf), QUARTERS)


def annual_series(spark: SparkSession, sf: str) -> DataFrame:
    return periods.with_series(annual_feed(spark, sf), "FY", YEARS)


def bars(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.max(unit).alias("high"), F.min(unit).alias("close"),
            F.when(F.sum("l_orderkey") % 97 == 0, 2.0).otherwise(0.0).alias("split_ratio"),
        )
        .select(supplier_key("l_suppkey").alias("symbol"), "date", "high", "close", "split_ratio")
    )


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return prices.daily_mean(bars(spark, sf))


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier entities: prices from bars, profit columns from both feeds."""
    cut = F.lit("2000-11-04").cast("date")
    recent = F.col("date") >= cut
    b = bars(spark, sf).groupBy("symbol").agg(
        F.max_by("close", "date").alias("price"),
        F.min_by(F.when(recent, F.col("close")), F.when(recent, F.col("date"))).alias("year_ago"),
        F.max("high").alias("high_all_time"),
        F.max(F.when(recent, F.col("high"))).alias("high_52w"),
        F.min(F.when(recent, F.col("close"))).alias("low_52w"),
        F.try_divide(F.sum(F.col("close").cast("decimal(28,10)")).cast("double"), F.count("close")).alias("ema_200"),
    )
    k = F.col("s_suppkey")
    base = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            supplier_key("s_suppkey").alias("isin"), F.col("s_name").alias("symbol"),
            F.concat_ws(" ", "r_name", "s_name").alias("name"), F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"), (F.col("s_acctbal") * 1000).alias("market_cap"),
            supplier_tags(k).alias("index_tags"),
        )
    )
    profit = periods.summarise(quarterly_series(spark, sf), annual_series(spark, sf), ttm="TTM")
    wide = matching.assemble(base, [b.withColumnRenamed("symbol", "isin"), profit])
    wide = wide.withColumns({
        "pat_both_at_ath": F.coalesce("pat_both_at_ath", F.lit(False)),
        "perf_1y_pct": (safe_div("price", "year_ago") - 1) * 100,
    })
    return derive.add_all(T.add_tag_columns(wide))


SUPPLIER_TIER_TAGS = ["Nifty 100", "Nifty MidCap 150", "Nifty SmallCap 250", "Nifty MicroCap 250"]
SUPPLIER_FACTOR_TAGS = [("Nifty 500 Momentum 50", 2), ("Nifty Alpha 50", 3), ("Nifty 50 Value 20", 4), ("Nifty 200 Quality 30", 5), ("Nifty MNC", 7)]


def supplier_tags(k: Column) -> Column:
    tier = F.try_element_at(F.array(*[F.lit(t) for t in SUPPLIER_TIER_TAGS]), (k % 5 + 1).cast("int"))
    return F.concat_ws(" , ", tier, *[F.when(k % m == 0, F.lit(t)) for t, m in SUPPLIER_FACTOR_TAGS])


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return periods.stored_verdicts(
        quarterly_series(spark, sf), annual_series(spark, sf), F.lit("2001-06-10 06:00:00").cast("timestamp")
    )


# ------------------------------------------------------------------ scan
def upload(spark: SparkSession, sf: str) -> DataFrame:
    """Uploaded scan list: all suppliers, codes in mixed spelling; those with a balance of 3,000 or
    less come under a code that no feed knows."""
    return table(spark, sf, "supplier").select(
        F.concat(F.when(F.col("s_acctbal") > 3000, " s_").otherwise(" r_"), F.col("s_suppkey").cast("string")).alias("Ticker"),
        F.when(F.col("s_suppkey") % 3 == 0, "BSE Ltd").otherwise("NSE (India)").alias("Exch"),
        F.col("s_suppkey").alias("ord"),
    )


def identifier_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers of all suppliers; those of one nation go by a code of their own."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.when(F.col("s_nationkey") != 7, "S-").otherwise("X-"), k.cast("string")).alias("NSE CODE"), supplier_key("s_suppkey").alias("ISIN"),
        k.cast("string").alias("ACCORD CODE"), F.col("s_name").alias("COMPANY NAME"),
        F.when(k % 7 == 0, "Delisted").otherwise("Active").alias("TRADING STATUS"), k.alias("ORD"),
    )


def scan_list(spark: SparkSession, sf: str) -> DataFrame:
    """Stored list of all suppliers for the scan; every thirteenth is ignored."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        supplier_key("s_suppkey").alias("symbol"),
        F.when(k % 3 == 0, "BSE").otherwise("NSE").alias("exchange"),
        F.when(k % 8 != 0, supplier_key("s_suppkey")).alias("isin"),
        k.cast("string").alias("accord_code"),
        F.when(k % 8 != 0, "auto").otherwise("unresolved").alias("resolution"),
        (k % 13 == 0).alias("ignored"),
        F.when(k % 13 == 0, "delisted").alias("ignore_reason"),
        F.lit("list.csv").alias("source_file"),
    )


def before_scan(all_bars: DataFrame) -> DataFrame:
    return all_bars.where(F.col("date") < F.lit(SCAN_START).cast("date"))


def in_scan(all_bars: DataFrame) -> DataFrame:
    d = F.col("date")
    return all_bars.where((d >= F.lit(SCAN_START).cast("date")) & (d < F.lit(SCAN_END).cast("date")))


def history_bars(spark: SparkSession, sf: str) -> DataFrame:
    return before_scan(bars(spark, sf))


def window_bars(spark: SparkSession, sf: str) -> DataFrame:
    return in_scan(bars(spark, sf))


def triggers(spark: SparkSession, sf: str) -> DataFrame:
    return triggers_from(history_bars(spark, sf))


def triggers_from(past: DataFrame) -> DataFrame:
    """Stored state seeded from the bars before the scan window, at a fraction of the
    lifetime high so that some are reached. A symbol whose high is older than 1998 has no
    trigger yet, every fifth was never checked for splits."""
    k = F.substring("symbol", 2, 9).cast("int")
    highs = prices.lifetime_highs(past).where(F.col("ath_date") >= F.lit("1998-01-01").cast("date")).withColumn("ath_price", F.col("ath_price") * (k % 7 + 1) / 50)
    return highs.select(
        "symbol", "ath_price", "ath_date", (F.col("ath_price") * F.when(k % 4 == 0, 1.1)).alias("today_ath"),
        F.when(k % 5 != 0, F.col("last_bar")).alias("last_split_check"),
        F.lit("2001-05-01 00:00:00").cast("timestamp").alias("last_updated"),
    )


def result_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of all suppliers; those with a balance of 1,000 or less are filed under an old symbol."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.when(F.col("s_acctbal") > 1000, "").otherwise("OLD-"), supplier_key("s_suppkey")).alias("symbol"),
        F.when(k % 4 != 3, F.date_add(F.lit("2001-06-05").cast("date"), (k % 20).cast("int"))).alias("result_date"),
        F.when(k % 4 != 3, "announced").otherwise("not_announced").alias("status"),
        F.when(k % 6 != 0, F.lit("2001-06-14 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(k % 36).cast("int"))).alias("checked_at"),
    )


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def parts_two_sources(spark: SparkSession, sf: str) -> DataFrame:
    """List price of a part against its mean unit price over all line items."""
    unit = (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(28,10)")
    sold = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.try_divide(F.sum(unit).cast("double"), F.count("*")).alias("price_screener")
    )
    return table(spark, sf, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").cast("string").alias("isin"), F.col("p_retailprice").alias("price"), "price_screener",
        F.col("p_brand").alias("brand"), F.col("p_size").alias("size"),
    )


SNAKE_TAGS = [f"idx_{to_snake(t)}" for t in TAGS]
