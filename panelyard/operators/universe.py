"""Scan list: upload parsing, key resolution, merge into the stored list, date cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions import exprs as X
from panelyard.functions.exprs import count_where
from panelyard.operators.matching import keep_first

COLUMNS = ["symbol", "exchange", "isin", "accord_code", "resolution", "ignored", "ignore_reason", "source_file"]


def _find(columns: list[str], candidates: list[str]) -> str | None:
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[c] for c in candidates if c in by_name), None)


def parse_upload(df: DataFrame, source_file: str, order: Column | str | None = None) -> DataFrame:
    """Uploaded list to (symbol, exchange, source_file), first row per symbol."""
    symbol = _find(df.columns, K.SYMBOL_HEADERS)
    if symbol is None:
        raise ValueError(f"no symbol column found; expected one of {K.SYMBOL_HEADERS}")
    venue = _find(df.columns, K.EXCHANGE_HEADERS)
    at = F.monotonically_increasing_id() if order is None else order
    rows = df.select(
        X.normal_symbol(symbol).alias("symbol"),
        (X.exchange(venue) if venue else F.lit("NSE")).alias("exchange"),
        F.lit(source_file).alias("source_file"),
        (F.col(at) if isinstance(at, str) else at).alias("__at"),
    ).where("symbol IS NOT NULL")
    return keep_first(rows, "symbol", "__at").drop("__at")


def resolve(rows: DataFrame, feed: DataFrame, order: Column | str | None = None) -> DataFrame:
    """Attach key and code by the feed's exchange code; a dead trading status ignores
    the row. Feed headers are matched in upper case; the first row per code wins."""
    feed = feed.toDF(*[c.strip().upper() for c in feed.columns]) if order is None else feed
    at = F.monotonically_increasing_id() if order is None else (F.col(order) if isinstance(order, str) else order)
    absent = F.lit(None).cast("string")
    get = lambda c: F.col(f"`{c}`").cast("string") if c in feed.columns else absent
    status = F.coalesce(get("TRADING STATUS"), F.lit("Active"))
    codes = feed.select(
        F.upper(F.trim(get("NSE CODE"))).alias("symbol"), get("ISIN").alias("isin"),
        get("ACCORD CODE").alias("accord_code"), status.alias("__status"), at.alias("__at"),
    ).where("symbol IS NOT NULL AND symbol NOT IN ('', 'NAN')")
    known = keep_first(codes, "symbol", "__at").drop("__at")
    dead = X.flag(F.col("__status").isin(K.DEAD_STATUSES))
    return rows.join(known, "symbol", "left").select(
        "symbol", "exchange", "isin", "accord_code",
        F.when(F.col("__status").isNotNull(), "auto").otherwise("unresolved").alias("resolution"),
        dead.alias("ignored"),
        F.when(dead, F.lower("__status")).alias("ignore_reason"),
        "source_file",
    )


def merge(stored: DataFrame, upload: DataFrame) -> DataFrame:
    """Upload into the stored list, with ``change`` = inserted / updated / kept. Nothing
    is removed; a key set by hand stays; an ignored row stays ignored with its reason."""
    old = stored.select("symbol", *[F.col(c).alias(f"o_{c}") for c in COLUMNS[1:]], F.lit(True).alias("o"))
    new = upload.select("symbol", *[F.col(c).alias(f"n_{c}") for c in COLUMNS[1:]], F.lit(True).alias("u"))
    j = old.join(new, "symbol", "full_outer")
    had, given = X.flag(F.col("o")), X.flag(F.col("u"))
    manual = X.flag(F.col("o_resolution") == "manual")
    was, now = X.flag(F.col("o_ignored")), X.flag(F.col("n_ignored"))

    def pick(c: str, updated: Column) -> Column:
        return F.when(~given, F.col(f"o_{c}")).when(~had, F.col(f"n_{c}")).otherwise(updated).alias(c)

    fresh_key = F.coalesce(F.nullif("n_isin", F.lit("")), F.col("o_isin"))
    return j.select(
        "symbol",
        pick("exchange", F.col("n_exchange")),
        pick("isin", F.when(manual, F.col("o_isin")).otherwise(fresh_key)),
        pick("accord_code", F.col("n_accord_code")),
        F.when(~given, F.col("o_resolution"))
        .when(~had, F.coalesce("n_resolution", F.lit("unresolved")))
        .otherwise(F.when(manual, "manual").otherwise(F.coalesce("n_resolution", "o_resolution")))
        .alias("resolution"),
        (was | now).alias("ignored"),
        pick("ignore_reason", F.when(was | now, F.coalesce("n_ignore_reason", "o_ignore_reason"))),
        pick("source_file", F.col("n_source_file")),
        F.when(~given, "kept").when(had, "updated").otherwise("inserted").alias("change"),
    )


def upload_report(merged: DataFrame, upload: DataFrame) -> DataFrame:
    """One row: inserted, updated, stored but absent from the upload, resolved, total."""
    return merged.agg(
        count_where(F.col("change") == "inserted").alias("inserted"),
        count_where(F.col("change") == "updated").alias("updated"),
        count_where(F.col("change") == "kept").alias("missing"),
    ).withColumns(
        {
            "resolved": upload.agg(count_where(F.col("resolution") == "auto")).scalar(),
            "total": upload.agg(F.count("*")).scalar(),
        }
    )


def absent_from_upload(stored: DataFrame, upload: DataFrame) -> DataFrame:
    return stored.select("symbol").join(upload.select("symbol"), "symbol", "left_anti").orderBy("symbol")


def map_keys(stored: DataFrame, mapping: DataFrame) -> DataFrame:
    """Keys set by hand (``mapping``: symbol, isin)."""
    given = mapping.select("symbol", F.col("isin").alias("__k"))
    hit = F.col("__k").isNotNull()
    return stored.join(given, "symbol", "left").withColumns(
        {
            "isin": F.coalesce("__k", "isin"),
            "resolution": F.when(hit, "manual").otherwise(F.col("resolution")),
        }
    ).drop("__k")


def remove(stored: DataFrame, symbols: DataFrame) -> DataFrame:
    return stored.join(symbols.select("symbol"), "symbol", "left_anti")


def clear(stored: DataFrame) -> DataFrame:
    return stored.limit(0)


def active(stored: DataFrame) -> DataFrame:
    return stored.where(~F.col("ignored")).select("symbol", "exchange", "isin").orderBy("symbol")


def unresolved(stored: DataFrame) -> DataFrame:
    return stored.where((F.col("resolution") == "unresolved") & ~F.col("ignored")).select(
        "symbol", "exchange"
    ).orderBy("symbol")


IDENTIFIERS = {
    "NSE CODE": "nse_code", "ISIN": "isin", "ACCORD CODE": "accord_code",
    "COMPANY NAME": "company_name", "TRADING STATUS": "trading_status",
}


def identifiers(feed: DataFrame) -> DataFrame:
    """Identifier columns of a feed as text, missing ones as null."""
    by_name = {c.strip().upper(): c for c in feed.columns}
    return feed.select(*[
        (F.col(f"`{by_name[src]}`") if src in by_name else F.lit(None)).cast("string").alias(dst)
        for src, dst in IDENTIFIERS.items()
    ])


def store_dates(cache: DataFrame, found: DataFrame, checked_at: Column) -> DataFrame:
    """Upsert checked symbols into the result-date cache (``found``: symbol, result_date;
    a null date is stored as not announced)."""
    new = found.select("symbol", F.col("result_date").alias("__d"), F.lit(True).alias("__n"))
    j = cache.join(new, "symbol", "full_outer")
    hit = X.flag(F.col("__n"))
    status = F.when(F.col("__d").isNull(), "not_announced").otherwise("announced")
    return j.select(
        "symbol",
        F.when(hit, F.col("__d")).otherwise(F.col("result_date")).alias("result_date"),
        F.when(hit, status).otherwise(F.col("status")).alias("status"),
        F.when(hit, checked_at.cast("timestamp")).otherwise(F.col("checked_at")).alias("checked_at"),
    )


def due_for_check(symbols: DataFrame, cache: DataFrame, as_of: Column, ttl_hours: int = 24) -> DataFrame:
    j = symbols.select("symbol").join(cache.withColumn("__seen", F.lit(True)), "symbol", "left")
    due = X.needs_check(F.col("__seen"), "result_date", "checked_at", as_of, ttl_hours)
    return j.select("symbol", due.alias("needs_check"))


def date_list(symbols: DataFrame, cache: DataFrame) -> DataFrame:
    return symbols.select(F.upper(F.trim("symbol")).alias("symbol")).distinct().join(
        cache.select("symbol", "result_date", "status"), "symbol", "left"
    )
