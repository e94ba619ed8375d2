"""Record verdicts, streaks and summaries on small feeds with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from panelyard.operators import periods as P

CASES = {
    # key: quarters, years, (ttm record, quarter record, both)
    "record": ([120, 110, 100, 95, 118, 90, 85, 80], [423, 380, 410, 300], (True, True, True)),
    "older_year": ([120, 110, 100, 95, 118, 90, 85, 80], [423, 380, 450, 300], (False, True, False)),
    "equal": ([110, 100, 95, 90], [395, 380, 300], (True, True, True)),
    "rolling": ([50, 60, 70, 80, 200, 200, 200, 10], [500, 610, 300], (False, False, False)),
    "thin": ([100, 90, 80, 70], [300], (True, True, True)),
    "losses": ([-10, -20, -30, -40], [-50, -90], (False, False, False)),
    "no_years": ([100, 90, 80, 70], [], (False, True, False)),
    "gap": ([100, 90, 80, 0], [200], (False, True, False)),
}


@pytest.fixture(scope="module")
def feeds(spark):
    q = [(k, *(list(map(float, v[0])) + [0.0] * (48 - len(v[0])))) for k, v in CASES.items()]
    y = [(k, *(list(map(float, v[1])) + [0.0] * (15 - len(v[1]))), 0.0) for k, v in CASES.items()]
    qs = "isin string, " + ", ".join(f"QL{i} double" for i in range(1, 49))
    ys = "isin string, " + ", ".join(f"FYL{i} double" for i in range(1, 16)) + ", TTM double"
    return spark.createDataFrame(q, qs), spark.createDataFrame(y, ys)


@pytest.fixture(scope="module")
def series(feeds):
    return P.with_series(feeds[0], "Q"), P.with_series(feeds[1], "FY")


def test_verdicts(series):
    rows = {r.isin: r for r in P.record_verdict(*series).collect()}
    quarter = {r.isin: r.pat_q_at_ath for r in P.summarise_quarterly(series[0]).collect()}
    for key, (_, _, (ttm, q, both)) in CASES.items():
        assert (rows[key].pat_ttm_at_ath, quarter[key], rows[key].pat_both_at_ath) == (ttm, q, both), key


def test_quarterly_figures(series):
    rows = {r.isin: r for r in P.summarise_quarterly(series[0]).collect()}
    r = rows["record"]
    assert (r.pat_ttm, r.pat_ttm_prev, r.qtrs_available, r.profit_streak_qtrs) == (425.0, 373.0, 8, 8)
    assert r.pat_yoy_q_pct == pytest.approx((120 / 118 - 1) * 100)
    values = CASES["record"][0]
    mean = sum(values) / 8
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / 7)
    assert r.pat_qtr_volatility == pytest.approx(sd / mean * 100)
    assert r.pat_ttm_peak_rolling == 425.0 and r.pat_ttm_at_ath_rolling
    assert rows["rolling"].pat_ttm_peak_rolling == 680.0 and not rows["rolling"].pat_ttm_at_ath_rolling
    assert rows["thin"].pat_ttm == 340.0 and rows["thin"].qtrs_available == 4
    assert rows["gap"].pat_ttm is None and rows["gap"].profit_streak_qtrs == 3
    assert rows["losses"].profit_streak_qtrs == 0 and rows["losses"].loss_qtrs == 4
    # A change against a negative base is measured on its absolute value.
    assert rows["losses"].pat_qoq_pct == pytest.approx((-10 / 20 - 1) * 100)


def test_yearly_figures(series):
    rows = {r.isin: r for r in P.summarise_yearly(series[1], ttm="TTM").collect()}
    r = rows["record"]
    assert r.fy_available == 4 and r.pat_fy1 == 423.0 and r.pat_fy_at_ath
    assert r.pat_cagr_3y_pct == pytest.approx(((423 / 410) ** 0.5 - 1) * 100)
    assert r.pat_growth_streak_fy == 1 and r.profit_streak_fy == 4
    assert rows["older_year"].pat_vs_peak_pct == pytest.approx((423 / 450 - 1) * 100)
    assert rows["losses"].pat_cagr_3y_pct is None and not rows["losses"].pat_fy_at_ath
    assert rows["losses"].pat_growth_streak_fy == 1
    assert rows["no_years"].fy_available == 0 and rows["no_years"].pat_peak_fy is None
    assert r.pat_ttm_reported is None


def test_long_and_wide_agree(feeds, series):
    long = P.to_long(feeds[0], "Q")
    assert long.where("pat = 0 OR pat IS NULL").count() == 0
    back = P.series_from_long(long, 48)
    a = {r.isin: r.asDict() for r in P.summarise_quarterly(back).collect()}
    b = {r.isin: r.asDict() for r in P.summarise_quarterly(series[0]).collect()}
    assert a == b


def test_key_in_one_feed_only(spark, series):
    q, y = series
    out = {r.isin: r for r in P.record_verdict(q.where("isin <> 'thin'"), y).collect()}
    assert out["thin"].pat_both_at_ath is False and out["thin"].pat_ttm_at_ath is False
    stored = P.stored_verdicts(q.where("isin <> 'thin'"), y, F.lit("2026-08-20").cast("timestamp"))
    row = stored.where("isin = 'thin'").first()
    assert row.pat_q_at_ath is None and row.pat_fy_peak == 300.0


def test_streak_across_a_missing_period(spark):
    df = spark.createDataFrame([("a", [5.0, None, 4.0])], "isin string, p array<double>")
    got = df.selectExpr(f"{P.profit_streak('p')} AS p", f"{P.growth_streak('p')} AS g").first()
    assert (got.p, got.g) == (1, 0)


def test_pad_and_numbers(spark):
    df = spark.createDataFrame([("a", "1,234.5", "7", "-")], "isin string, QL1 string, QL2 string, TTM string")
    row = P.as_numbers(P.pad_periods(df, "Q")).first()
    assert (row.QL1, row.QL2, row.TTM, row.QL48) == (None, 7.0, None, None)


def test_sums_of_money_are_exact(spark):
    """Four quarters that add up to a figure which their sum as doubles misses; amounts that no
    decimal holds are still added."""
    four = [273279.5177, 437693.2605, 123232.6301, 277353.333]
    assert sum(four) < 1111558.7413
    q = spark.createDataFrame([("a", four), ("b", [1e30, 1.0, 2.0, 3.0]), ("c", [1.0, None, 2.0, 3.0])], "isin string, p array<double>")
    y = spark.createDataFrame([("a", [1111558.7413, 5.0])], "isin string, p array<double>")
    out = {r.isin: r for r in P.summarise(q, y).collect()}
    assert out["a"].pat_ttm == 1111558.7413 and out["a"].pat_ttm_at_ath is True
    assert out["b"].pat_ttm == 1e30 and out["c"].pat_ttm is None
