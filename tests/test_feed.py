import pytest
from pyspark.sql import functions as F

from panelyard.plans import feed
from panelyard.sources import ingest as I


def payloads(spark):
    q = spark.createDataFrame(
        [(" A ", "120", "110", "100", "95", 1), ("A", "1", "1", "1", "1", 2), ("B", "-", "1", "1", "1", 3), ("", "9", "9", "9", "9", 4)],
        f"ISIN string, QL1 string, QL2 string, QL3 string, QL4 string, {I.ORDINAL} int")
    y = spark.createDataFrame([("A", "423", "410", "NSEA", 1), ("C", "5", "4", "NSEC", 2)], f"ISIN string, FYL1 string, FYL2 string, `NSE CODE` string, {I.ORDINAL} int")
    return q, y


def test_refresh(spark, tmp_path):
    store = str(tmp_path / "feed")
    now = F.lit("2026-08-21 12:00:00").cast("timestamp")
    empty = feed.status(spark, store, now).first()
    assert (empty.companies, empty.fetched_at, empty.stale) == (0, None, True)
    q, y = payloads(spark)
    feed.refresh(q, y, store, F.lit("2026-08-21 06:00:00"))
    rows = {r.isin: r for r in feed.load_verdicts(spark, store).collect()}
    assert set(rows) == {"A", "B", "C"}
    assert (rows["A"].pat_ttm, rows["A"].pat_fy_peak, rows["A"].pat_both_at_ath) == (425.0, 423.0, True)
    assert (rows["B"].pat_q_at_ath, rows["B"].pat_both_at_ath, rows["C"].pat_q_at_ath, rows["C"].pat_both_at_ath) == (False, False, None, False)
    now_held = feed.status(spark, store, now).first()
    assert (now_held.companies, now_held.age_hours, now_held.stale) == (3, 6.0, False)
    ids = {r["NSE CODE"]: r["ISIN"] for r in feed.load_identifiers(spark, store).collect()}
    assert ids == {"NSEA": "A", "NSEC": "C"}
    # A bad payload changes nothing.
    for bad in ((q, y.limit(0)), (q.drop("ISIN"), y), (q, y.drop("FYL1", "FYL2"))):
        with pytest.raises(ValueError):
            feed.refresh(*bad, store, now)
    assert feed.load_verdicts(spark, store).count() == 3
