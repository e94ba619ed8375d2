import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelyard.operators import universe as U

SCHEMA = "symbol string, exchange string, isin string, accord_code string, resolution string, ignored boolean, ignore_reason string, source_file string"


def feed(spark):
    rows = [("AAA", "I-A", "1", "Active"), ("BBB", "I-B", "2", "Delisted"), ("", "I-X", "3", "Active"), ("nan", "I-N", "4", "Active"), ("aaa", "I-LATE", "9", "Active")]
    return spark.createDataFrame(rows, "`nse code` string, ISIN string, `Accord Code` string, `Trading Status` string")


def upload(spark, *symbols):
    return spark.createDataFrame([(s,) for s in symbols], "Symbol string")


def test_parse(spark):
    df = spark.createDataFrame([(" aaa ", "NSE (India)"), ("AAA", "BSE"), ("m_m", "BSE Ltd"), ("  ", "NSE")], "` Ticker ` string, Exch string")
    rows = {r.symbol: r.exchange for r in U.parse_upload(df, "f.csv").collect()}
    assert rows == {"AAA": "NSE", "M-M": "BSE"}
    with pytest.raises(ValueError):
        U.parse_upload(spark.createDataFrame([(1,)], "foo int"), "f.csv")
    assert U.parse_upload(upload(spark, "x"), "f.csv").first().exchange == "NSE"


def test_resolve(spark):
    rows = {r.symbol: r for r in U.resolve(U.parse_upload(upload(spark, "aaa", "bbb", "ccc"), "f.csv"), feed(spark)).collect()}
    assert (rows["AAA"].isin, rows["AAA"].resolution, rows["AAA"].ignored) == ("I-A", "auto", False)
    assert (rows["BBB"].ignored, rows["BBB"].ignore_reason) == (True, "delisted")
    assert (rows["CCC"].isin, rows["CCC"].resolution) == (None, "unresolved")


def stored(spark):
    return spark.createDataFrame(
        [("AAA", "NSE", "HAND", None, "manual", False, None, "old"), ("BBB", "NSE", "I-OLD", None, "auto", True, "suspended", "old"), ("GONE", "NSE", "I-G", None, "auto", False, None, "old")], SCHEMA
    )


def test_merge_keeps_what_was_set_by_hand(spark):
    new = U.resolve(U.parse_upload(upload(spark, "aaa", "bbb", "ddd"), "new.csv"), feed(spark))
    merged = U.merge(stored(spark), new)
    rows = {r.symbol: r for r in merged.collect()}
    assert (rows["AAA"].isin, rows["AAA"].resolution, rows["AAA"].change, rows["AAA"].source_file) == ("HAND", "manual", "updated", "new.csv")
    assert (rows["BBB"].isin, rows["BBB"].ignored, rows["BBB"].ignore_reason) == ("I-B", True, "delisted")
    assert rows["GONE"].change == "kept" and rows["DDD"].change == "inserted" and rows["DDD"].resolution == "unresolved"
    r = U.upload_report(merged, new).first()
    assert (r.inserted, r.updated, r.missing, r.resolved, r.total) == (1, 2, 1, 2, 3)
    again = U.merge(merged.drop("change"), new)
    assert again.where("change = 'inserted'").count() == 0
    assert sorted(map(tuple, again.drop("change").collect()), key=str) == sorted(map(tuple, merged.drop("change").collect()), key=str)


def test_unresolved_reupload_keeps_the_old_key_and_reason(spark):
    new = spark.createDataFrame([("BBB", "NSE", None, None, "unresolved", False, None, "n")], SCHEMA)
    row = U.merge(stored(spark), new).where("symbol = 'BBB'").first()
    assert (row.isin, row.ignored, row.ignore_reason) == ("I-OLD", True, "suspended")


def test_map_remove_lists(spark):
    st = stored(spark)
    mapped = U.map_keys(st, spark.createDataFrame([("GONE", "NEWKEY")], "symbol string, isin string"))
    row = mapped.where("symbol = 'GONE'").first()
    assert (row.isin, row.resolution) == ("NEWKEY", "manual")
    assert [r.symbol for r in U.active(st).collect()] == ["AAA", "GONE"]
    assert U.remove(st, upload(spark, "AAA").toDF("symbol")).count() == 2 and U.clear(st).count() == 0
    assert [r.symbol for r in U.absent_from_upload(st, upload(spark, "AAA").toDF("symbol")).collect()] == ["BBB", "GONE"]
    assert U.unresolved(st).count() == 0


def test_identifiers_fill_missing_columns(spark):
    row = U.identifiers(feed(spark)).where("isin = 'I-A'").first()
    assert (row.nse_code, row.company_name, row.trading_status) == ("AAA", None, "Active")


def test_date_cache(spark):
    cache = spark.createDataFrame([("A", dt.date(2026, 8, 1), "announced", dt.datetime(2026, 7, 1)), ("B", None, "not_announced", None)], "symbol string, result_date date, status string, checked_at timestamp")
    found = spark.createDataFrame([("A", None), ("C", dt.date(2026, 9, 1))], "symbol string, result_date date")
    now = F.lit("2026-08-21 12:00:00").cast("timestamp")
    new = U.store_dates(cache, found, now)
    rows = {r.symbol: (r.result_date, r.status) for r in new.collect()}
    assert rows == {"A": (None, "not_announced"), "B": (None, "not_announced"), "C": (dt.date(2026, 9, 1), "announced")}
    due = {r.symbol: r.needs_check for r in U.due_for_check(upload(spark, "A", "B", "C", "D").toDF("symbol"), new, now).collect()}
    assert due == {"A": False, "B": True, "C": False, "D": True}
    listed = {r.symbol: r.status for r in U.date_list(upload(spark, " a ", "z").toDF("symbol"), new).collect()}
    assert listed == {"A": "not_announced", "Z": None}
