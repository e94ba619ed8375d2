"""Queries that write the given tables as raw files, logs and snapshots, and read them back
through the loaders, the sinks and the snapshot store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelyard.operators import clean, high_months, periods
from panelyard.plans import build as B
from panelyard.session import cut_lineage, shared_folder
from panelyard.sources import ingest, tables
from panelyard.sources import manifest as M
from panelyard.sources import snapshots as SN
from workload import frames as Fr
from workload import sql as S
from workload.registry import register

P = S.with_(S.profit())
FIRST, SECOND = "2001-08-01", "2001-08-02"
QUARTERS = periods.period_names("Q")
KEY = "'S' || lpad(CAST({} AS VARCHAR), 9, '0')"
LONG = f"{P} SELECT isin, 'QL' || (periods_ago + 1) AS period, pat, CAST(periods_ago AS BIGINT) AS periods_ago, 'Q' AS freq FROM q"


def scratch(spark, name):
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/stored/{name}-{uuid.uuid4().hex}"


def long_quarters(df):
    return periods.to_long(df, "Q").withColumn("periods_ago", F.col("periods_ago").cast("bigint"))


# ------------------------------------------------------------------ raw files
def customers_csv(spark, sf):
    path = scratch(spark, "customers-csv")
    tables.write_csv(Fr.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), path)
    return ingest.read_csv(spark, path).withColumns({"c_custkey": F.col("c_custkey").cast("bigint"), "c_acctbal": F.col("c_acctbal").cast("double")})


def period_csv(spark, sf):
    path = scratch(spark, "quarters-csv")
    tables.write_csv(Fr.quarterly_feed(spark, sf).select(F.col("isin").alias("ISIN"), *QUARTERS), path)
    schema = ", ".join(["ISIN string", *[f"{q} double" for q in QUARTERS]])
    return ingest.load_periods(ingest.read_csv(spark, path, schema, ordinal=True), "Q")


def secondary_csv(spark, sf):
    """Orders as the second export: several rows a customer, the first by order key stays."""
    path = scratch(spark, "orders-csv")
    rows = Fr.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("ISIN Code"), "o_orderkey", "o_totalprice")
    tables.write_csv(rows, path)
    read = ingest.read_csv(spark, path, "`ISIN Code` string, o_orderkey bigint, o_totalprice double")
    return ingest.load_secondary(read.withColumn("at", F.col("o_orderkey")), "at")


def payload_json(spark, sf):
    """The quarterly feed as JSON lines with lower-case headers, validated and prepared."""
    path = scratch(spark, "quarters-json")
    feed = Fr.quarterly_feed(spark, sf)
    feed.select(*[F.col(c).alias(c.lower()) for c in feed.columns]).write.json(path)
    read = ingest.read_json_payload(spark, path, ordinal=True, lines=True)
    ingest.validate_payload(read, "quarterly", "Q")
    return ingest.prepare_payload(read)


register("csv_scan", customers_csv, "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_mktsegment, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
register("period_csv_scan", lambda spark, sf: long_quarters(period_csv(spark, sf)), LONG)
register(
    "secondary_csv_scan", secondary_csv,
    """SELECT CAST(o_custkey AS VARCHAR) AS isin, CAST(min(o_orderkey) AS BIGINT) AS o_orderkey, CAST(min_by(o_totalprice, o_orderkey) AS DOUBLE) AS o_totalprice
    FROM orders GROUP BY o_custkey""",
)


def mixed_csv(spark, sf):
    """Customers in files with headers of their own: odd keys in one order, even ones in another;
    a third set of files has all keys once more, without the other values."""
    path = scratch(spark, "customers-mixed")
    k = F.col("c_custkey")
    rows = Fr.table(spark, sf, "customer").select(
        k.cast("string").alias("key"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("name"),
        F.when(k % 50 == 7, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
    )
    for df in (rows.where("key % 2 = 1"), rows.where("key % 2 = 0").select("balance", "key", "name")):
        df.write.mode("append").option("header", True).option("escape", '"').csv(path)
    short = Fr.table(spark, sf, "customer").coalesce(1).select(k.cast("string").alias("value"))
    head = spark.createDataFrame([("key,balance",)], "value string")
    head.union(short).coalesce(1).write.mode("append").text(path)
    return ingest.read_csv_files(spark, path, {"key": "bigint", "balance": "double"})


def rejected_lines(spark, sf):
    return mixed_csv(spark, sf)[1].groupBy("reason", "record").agg(F.count("*").alias("n")).select("reason", F.regexp_extract("record", r"(\d+)(?:$|,\"?Customer)", 1).alias("key"), "n")


def listed_dropped(spark, sf):
    """The second export without its listed columns."""
    rows = Fr.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("bigint").alias("isin"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Industry"), F.col("c_acctbal").cast("double").alias("Sales"),
        F.col("c_nationkey").alias("Credit rating"),
    )
    return clean.drop_listed(rows)


register(
    "csv_mixed_headers", lambda spark, sf: mixed_csv(spark, sf)[0],
    """SELECT CAST(c_custkey AS BIGINT) AS key, c_name || ', "' || c_mktsegment || '"' AS name, CAST(c_acctbal AS DOUBLE) AS balance FROM customer WHERE c_custkey % 50 <> 7""",
)
register(
    "csv_rejects", rejected_lines,
    """SELECT 'not the 2 values of the header' AS reason, CAST(c_custkey AS VARCHAR) AS key, 1 AS n FROM customer
    UNION ALL SELECT 'balance: not a double', CAST(c_custkey AS VARCHAR), 1 FROM customer WHERE c_custkey % 50 = 7""",
)
register("dropped_listed", listed_dropped, "SELECT CAST(c_custkey AS BIGINT) AS isin, CAST(c_acctbal AS DOUBLE) AS \"Sales\" FROM customer")
register("json_payload_scan", lambda spark, sf: long_quarters(payload_json(spark, sf)), LONG)


# ------------------------------------------------------------------ sinks
def yearly_store(spark, sf):
    """Orders by year as snapshots of whole amounts until 1997; later years have cents and a
    priority, and one of them is published anew with other amounts."""
    store = scratch(spark, "orders-by-year")
    day = F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))
    rows = Fr.table(spark, sf, "orders").select(
        day.alias(SN.DATE), F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("amount"), "o_orderpriority"
    )
    years = [str(r[0]) for r in rows.select(SN.DATE).distinct().orderBy(SN.DATE).collect()]  # a few days
    old, new, again = [y for y in years if y < "1998"], [y for y in years if y >= "1998"], [y for y in years if y == "1999-12-31"]
    on = lambda days: F.col(SN.DATE).cast("string").isin(days)
    whole = rows.where(on(old)).drop("o_orderpriority").withColumn("amount", F.floor("amount").cast("int"))
    M.publish(spark, store, [*M.stage(whole, store, "orders", old), *M.stage(rows.where(on(new)), store, "orders", new)])
    M.publish(spark, store, M.stage(rows.where(on(again)).withColumn("amount", F.col("amount") * 2), store, "orders", again))
    return store


def yearly_orders(spark, sf):
    return M.read(spark, yearly_store(spark, sf), "orders")


def one_year(spark, sf):
    """A day on its own, with its own types."""
    return M.read(spark, yearly_store(spark, sf), "orders", ["1997-12-31"])


def appended_log(spark, sf):
    path = scratch(spark, "log")
    rows = Fr.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for status in (F.col("o_orderstatus") == "O", F.col("o_orderstatus") != "O"):
        tables.append(rows.where(status), path)
    return spark.read.schema(rows.schema).parquet(path)


def replaced_table(spark, sf):
    """Customers, replaced by a version that is computed from the one before."""
    path = scratch(spark, "replaced")
    schema = "c_custkey bigint, balance double"
    rows = Fr.table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("balance"))
    tables.replace(rows, path)
    held = tables.read_current(spark, path, schema)
    tables.replace(held.where("balance > 0").withColumn("balance", F.col("balance") + 1), path)
    return tables.read_current(spark, path, schema)


register(
    "snapshot_store_scan", yearly_orders,
    f"""SELECT make_date(year(o_orderdate), 12, 31) AS {SN.DATE}, CAST(o_orderkey AS BIGINT) AS o_orderkey,
    CASE WHEN year(o_orderdate) < 1998 THEN floor(o_totalprice) WHEN year(o_orderdate) = 1999 THEN o_totalprice * 2 ELSE o_totalprice END AS amount,
    CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
register(
    "snapshot_one_day", one_year,
    f"""SELECT DATE '1997-12-31' AS {SN.DATE}, CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(floor(o_totalprice) AS INTEGER) AS amount FROM orders WHERE year(o_orderdate) = 1997""",
)
register("appended_log", appended_log, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL")
register("replaced_table", replaced_table, "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(c_acctbal AS DOUBLE) + 1 AS balance FROM customer WHERE c_acctbal > 0")


# ------------------------------------------------------------------ snapshot store
def base(spark, sf):
    """A key, a figure, a currency and a column that is filled for one supplier in a hundred."""
    k = F.col("s_suppkey")
    return Fr.table(spark, sf, "supplier").select(
        Fr.supplier_key("s_suppkey").alias("isin"), F.col("s_acctbal").cast("double").alias("price"), F.lit("INR").alias("price - Currency"),
        F.when(k % 100 == 1, k).alias("rare"),
    )


def raised(df, by):
    return df.withColumn("price", F.col("price") + by)


def curated(first, second, profit_q, profit_y):
    return B.Curated(first.join(second, "isin", "left"), periods.to_long(profit_q, "Q"), periods.to_long(profit_y, "FY"), clean.dropped_columns(first))


def curated_anew(first, second, profit_q, profit_y, present):
    """All days at once, ten higher."""
    key = [SN.DATE, "isin"]
    return B.Curated(
        raised(first, 10).join(second, key, "left"), periods.to_long(profit_q, "Q", key), periods.to_long(profit_y, "FY", key), clean.dropped_columns(first, by=[SN.DATE])
    )


def sources(spark, sf):
    lines = Fr.table(spark, sf, "lineitem").groupBy(Fr.supplier_key("l_suppkey").alias("isin")).agg(F.count(F.lit(1)).alias("lines"))
    return {
        "tradingview": ("base-1.csv", base(spark, sf)), "screener": ("second-1.csv", lines),
        "profit_q": ("quarters-1.csv", Fr.quarterly_feed(spark, sf)), "profit_y": ("years-1.csv", Fr.annual_feed(spark, sf)),
    }


OPEN = {"low": None, "high": None, "build_fn": curated}


def committed(spark, sf):
    """Two days: all four sources on the first, the base alone on the second."""
    store = scratch(spark, "store")
    B.commit(spark, store, sources(spark, sf), F.lit(f"{FIRST} 06:00:00"), FIRST, date=FIRST, **OPEN)
    given = {"tradingview": ("base-2.csv", raised(base(spark, sf), 1))}
    B.commit(spark, store, given, F.lit(f"{SECOND} 06:00:00"), SECOND, date=SECOND, **OPEN)
    return store


def companies(spark, store):
    return SN.read_table(spark, f"{store}/companies").select(SN.DATE, "isin", "price", "lines")


TEN = [f"2001-08-{d:02d}" for d in range(1, 11)]


def archived_days(spark, sf):
    """Ten days whose companies are missing their figures. The base of each day is archived, one
    higher a day; the other sources are carried from the first."""
    store = scratch(spark, "ten-days")
    given = sources(spark, sf)
    each = base(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(TEN) - 1))))
    each = each.withColumns({SN.DATE: F.date_add(F.lit(TEN[0]).cast("date"), F.col("i")), "price": F.col("price") + F.col("i")}).drop("i")
    first = lambda s: given[s][1].withColumn(SN.DATE, F.lit(TEN[0]).cast("date"))
    told = spark.createDataFrame(
        [(s, given[s][0], d if s == "tradingview" else TEN[0], s != "tradingview" and d != TEN[0], d) for d in TEN for s in given],
        f"source string, filename string, from_snapshot string, carried_forward boolean, {SN.DATE} string",
    ).selectExpr(
        "source", "filename", "'0' AS content_hash", "0L AS content_rows", "CAST(from_snapshot AS DATE) AS from_snapshot", "carried_forward",
        f"TIMESTAMP '{TEN[0]} 06:00:00' AS built_at", "0L AS universe", "0 AS columns", f"CAST({SN.DATE} AS DATE) AS {SN.DATE}",
    )
    M.publish(spark, store, [
        *M.stage(each.select(SN.DATE, "isin"), store, "companies", TEN), *M.stage(told, store, "provenance", TEN), *M.stage(each, store, "archive/tradingview", TEN),
        *[e for s in given if s != "tradingview" for e in M.stage(first(s), store, f"archive/{s}", TEN[:1])],
    ])
    return store


def rebuilt(spark, sf):
    store = archived_days(spark, sf)
    B.rebuild_all(spark, store, F.lit(f"{SECOND} 07:00:00"), low=None, high=None, build_fn=curated_anew)
    return companies(spark, store)


def published(spark, sf):
    """The newest manifest beside the rows that are found in each table."""
    store = committed(spark, sf)
    told = M.entries(spark, store).select("kind", SN.DATE, "rows")
    kinds = [r[0] for r in told.select("kind").distinct().collect()]  # kinds of a store
    found = SN.union_by_name([M.read(spark, store, k).groupBy(SN.DATE).agg(F.count("*").alias("found")).withColumn("kind", F.lit(k)) for k in kinds])
    return told.join(found, ["kind", SN.DATE], "left").select("kind", SN.DATE, "rows", F.coalesce("found", F.lit(0)).alias("found"))


def shortened(spark, sf):
    """The store after the first day went with all of its archives that the second does not use."""
    store = committed(spark, sf)
    SN.delete(spark, store, FIRST, keep_archive=False)
    return store


def left_over(spark, sf):
    return M.removable(spark, shortened(spark, sf), SN.KINDS, keep=1, min_age_hours=0).select("kind", SN.DATE)


def refused(spark, sf):
    """A replacement of the second day that is a row short of what is asked for: its violations are
    kept, the day is as before."""
    store = committed(spark, sf)
    n = base(spark, sf).count()
    given = {"tradingview": ("base-3.csv", raised(base(spark, sf), 2))}
    try:
        B.commit(spark, store, given, F.lit(f"{SECOND} 08:00:00"), SECOND, date=SECOND, replace=True, **{**OPEN, "low": n + 1})
    except SN.SnapshotError:
        pass
    kept = companies(spark, store).groupBy(SN.DATE).agg(F.sum(F.col("price").cast("decimal(28,4)")).cast("double").alias("price"))
    return M.read(spark, store, "rejected").join(kept, SN.DATE).select(SN.DATE, "rule", "found", "low", "violated", "price")


def seen_before(spark, sf):
    """What an upload of today's base as a new file would do."""
    store = committed(spark, sf)
    name = "x_tradingview_2001-08-03.csv"
    seen = B.preview(spark, store, [name], {"tradingview": base(spark, sf)}, SECOND)
    carried = sorted(f"{s}:{d}" for s, d in seen["carried_forward"].items())
    row = (seen["ok"], seen["snapshot_date"], seen["already_exists"], seen["duplicate_of"], carried, seen["snapshots_held"])
    return spark.createDataFrame([row], "ok boolean, day string, already_exists boolean, duplicate_of string, carried array<string>, held int").withColumn("carried", F.array_join("carried", ","))


def duplicates(spark, sf):
    """The days whose base equals today's suppliers, whatever the order of rows."""
    store = committed(spark, sf)
    hashes = SN.source_hashes({"tradingview": base(spark, sf).orderBy(F.desc("isin"))})
    return SN.duplicate_of(SN.read_provenance(spark, store), hashes)


def _companies_sql(more, days=(FIRST, SECOND)):
    both = " UNION ALL ".join(
        f"SELECT DATE '{day}' AS {SN.DATE}, {KEY.format('s_suppkey')} AS isin, CAST(s_acctbal AS DOUBLE) + {by}{more} AS price, n AS lines FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey"
        for by, day in enumerate(days)
    )
    return f"WITH l AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) {both}"


def _provenance_sql():
    n, m = "(SELECT count(*) FROM supplier)", "(SELECT count(DISTINCT l_suppkey) FROM lineitem)"
    rows = []
    for day in (FIRST, SECOND):
        for source, file, held in (("tradingview", "base", n), ("screener", "second", m), ("profit_q", "quarters", m), ("profit_y", "years", m)):
            own = day == FIRST or source == "tradingview"
            origin, number = (day, 1 if day == FIRST else 2) if own else (FIRST, 1)
            rows.append(
                f"SELECT DATE '{day}' AS {SN.DATE}, '{source}' AS source, '{file}-{number}.csv' AS filename, {held} AS content_rows, "
                f"DATE '{origin}' AS from_snapshot, {str(not own).lower()} AS carried_forward, {n} AS universe"
            )
    return " UNION ALL ".join(rows)


register("committed_companies", lambda spark, sf: companies(spark, committed(spark, sf)), _companies_sql(""))
register(
    "committed_provenance",
    lambda spark, sf: SN.read_provenance(spark, committed(spark, sf)).select(SN.DATE, "source", "filename", "content_rows", "from_snapshot", "carried_forward", "universe"),
    _provenance_sql(),
)
register("rebuilt_companies", rebuilt, _companies_sql(" + 10", TEN))


def _entries_sql(keep):
    """kind, day and rows of every published entry for which ``keep(kind, day)`` holds."""
    n, m = "(SELECT count(*) FROM supplier)", "(SELECT count(DISTINCT l_suppkey) FROM lineitem)"
    sizes = {"companies": n, "profit_quarterly": "(SELECT count(*) FROM q)", "profit_annual": "(SELECT count(*) FROM y WHERE pat <> 0)", "provenance": "4", "checks": "3", "ledger": "2"}
    inputs = {"tradingview": n, "screener": m, "profit_q": m, "profit_y": m}
    rows = [(k, d, c) for d in (FIRST, SECOND) for k, c in sizes.items()]
    rows += [(f"archive/{s}", d, c) for s, c in inputs.items() for d in (FIRST, SECOND) if d == FIRST or s == "tradingview"]
    return f"{P} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, DATE '{d}' AS {SN.DATE}, CAST({c} AS BIGINT) AS rows" for k, d, c in rows if keep(k, d))


USED = {"archive/screener", "archive/profit_q", "archive/profit_y"}
register("published_tables", published, f"SELECT *, rows AS found FROM ({_entries_sql(lambda k, d: True)})")
register(
    "deleted_snapshot", lambda spark, sf: M.entries(spark, shortened(spark, sf)).select("kind", SN.DATE, "rows"),
    _entries_sql(lambda k, d: d == SECOND or k in USED),
)
register("removable_folders", left_over, f"SELECT kind, {SN.DATE} FROM ({_entries_sql(lambda k, d: d == FIRST and k not in USED)}) WHERE rows > 0")
register(
    "rejected_snapshot", refused,
    f"""SELECT DATE '{SECOND}' AS {SN.DATE}, rule, found, low, violated, (SELECT CAST(sum(CAST(s_acctbal + 1 AS DECIMAL(28,4))) AS DOUBLE) FROM supplier) AS price FROM (
    SELECT 'row_count' AS rule, CAST(count(*) AS DOUBLE) AS found, CAST(count(*) + 1 AS DOUBLE) AS low, true AS violated FROM supplier
    UNION ALL SELECT r, 0, NULL, false FROM (VALUES ('null_key'), ('duplicate_key')) v(r))""",
)
register(
    "snapshot_ledger",
    lambda spark, sf: M.read(spark, committed(spark, sf), "ledger"),
    f"""SELECT d AS {SN.DATE}, 'price - Currency' AS "column", 'currency' AS reason, 'all values INR' AS detail FROM (VALUES (DATE '{FIRST}'), (DATE '{SECOND}')) v(d)
    UNION ALL SELECT d, 'rare', 'low_coverage', printf('%.1f%% populated', round_even((SELECT 100e0 * count(*) FILTER (WHERE s_suppkey % 100 = 1) / count(*) FROM supplier), 1))
    FROM (VALUES (DATE '{FIRST}'), (DATE '{SECOND}')) v(d)""",
)
register(
    "snapshot_checks",
    lambda spark, sf: M.read(spark, committed(spark, sf), "checks").select(SN.DATE, "rule", "found", "violated"),
    f"""SELECT d AS {SN.DATE}, rule, found, false AS violated FROM (VALUES (DATE '{FIRST}'), (DATE '{SECOND}')) v(d), (
    SELECT 'row_count' AS rule, CAST(count(*) AS DOUBLE) AS found FROM supplier UNION ALL SELECT r, 0 FROM (VALUES ('null_key'), ('duplicate_key')) w(r))""",
)
register(
    "upload_preview", seen_before,
    f"""SELECT true AS ok, '2001-08-03' AS day, false AS already_exists, '{FIRST}' AS duplicate_of,
    'profit_q:{FIRST},profit_y:{FIRST},screener:{FIRST}' AS carried, 2 AS held FROM supplier HAVING count(*) > 0""",
)
register("duplicate_inputs", duplicates, f"SELECT DATE '{FIRST}' AS {SN.DATE} FROM supplier HAVING count(*) > 0")


# ------------------------------------------------------------------ highs by month
def kept_highs(spark, sf):
    """Highs of the bars up to the middle of a month, and the later bars appended to them."""
    store = scratch(spark, "high-months")
    bars = cut_lineage(Fr.bars(spark, sf))
    early = F.col("date") < F.lit("2001-06-15").cast("date")
    high_months.replace(spark, store, bars.where(early))
    high_months.append(spark, store, bars.where(~early))
    return high_months.lifetime_highs(high_months.read(spark, store))


register("incremental_highs", kept_highs, f"{S.with_(S.bars(), S.adjusted())} SELECT * FROM adj_top")
