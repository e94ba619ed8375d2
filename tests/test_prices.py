import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelyard.operators import prices as P

BARS = "symbol string, date date, high double, close double, split_ratio double"


def bars(spark, rows, start="2026-01-01", symbol="A"):
    d0 = dt.date.fromisoformat(start)
    return spark.createDataFrame(
        [(symbol, d0 + dt.timedelta(days=i), *(float(x) if x is not None else None for x in r)) for i, r in enumerate(rows)], BARS
    )


@pytest.mark.parametrize("ratios, want", [([0, 0, 2, 0, 0], [2, 2, 1, 1, 1]), ([0, 2, 0, 5, 0], [10, 5, 5, 1, 1]), ([None, 0, None], [1, 1, 1])])
def test_split_factor(spark, ratios, want):
    df = bars(spark, [(1, 1, r) for r in ratios])
    got = [r.split_factor for r in P.with_split_factor(df).orderBy("date").collect()]
    assert got == [float(w) for w in want]


def test_lifetime_high(spark):
    df = bars(spark, [(8235, 1, 0), (8100, 1, 0), (5500, 1, 1.5), (5600, 1, 0)], "2025-12-30")
    row = P.lifetime_highs(df).first()
    assert (row.ath_price, row.ath_date, row.last_bar) == (5600.0, dt.date(2026, 1, 2), dt.date(2026, 1, 2))


def test_lifetime_high_tie_is_earliest_and_empty_has_no_row(spark):
    df = bars(spark, [(10, 1, 0), (10, 1, 0)]).unionByName(bars(spark, [(None, 1, 0)], symbol="B"))
    rows = P.lifetime_highs(df).collect()
    assert [(r.symbol, r.ath_date) for r in rows] == [("A", dt.date(2026, 1, 1))]


def rs(spark, closes, bench=None, sessions=211):
    df = bars(spark, [(c, c, 0) for c in closes])
    b = bars(spark, [(1, x, 0) for x in (bench or [100.0] * len(closes))]).select("date", "close")
    return P.relative_strength(df, b, sessions).first()


def test_relative_strength(spark):
    assert rs(spark, [100 + i for i in range(220)]).ath_outperformance == "Y"
    assert rs(spark, [100 + i for i in range(210)] + [50] * 10).ath_outperformance == "N"
    short = rs(spark, [100] * 30)
    assert (short.ath_outperformance, short.current_rs) == ("N/A", None)
    near = rs(spark, [100.0] * 210 + [99.995])
    assert near.ath_outperformance == "Y" and near.ath_rs == 100.0
    assert rs(spark, [0.0] + [5.0] * 210).ath_outperformance == "N/A"


def test_relative_strength_uses_common_days(spark):
    got = rs(spark, [100.0] * 211, [None] + [100.0] * 210)
    assert got.ath_outperformance == "N/A"


def test_last_prices(spark):
    df = bars(spark, [(1, 90, 0), (2, 94, 0), (120, 118, 0), (None, None, 0)])
    row = P.last_prices(df).first()
    assert (row.today_high, row.today_close, row.prev_close, row.closes) == (120.0, 118.0, 94.0, 3)


def test_wide_columns_in_both_orders(spark):
    wide = spark.createDataFrame(
        [(dt.date(2026, 1, 1), 10.0, 9.0, 5.0, 4.0, 7.0)],
        "date date, `High|A.NS` double, `Close|A.NS` double, `B.NS|High` double, `B.NS|Close` double, `Volume|C.NS` double",
    )
    rows = {r.symbol: (r.high, r.close) for r in P.bars_from_wide(wide).collect()}
    assert rows == {"A.NS": (10.0, 9.0), "B.NS": (5.0, 4.0)}
    flat = spark.createDataFrame([(dt.date(2026, 1, 1), 3.0, float("nan"))], "date date, High double, Close double")
    row = P.bars_from_wide(flat, symbol="Z").first()
    assert (row.symbol, row.high, row.close) == ("Z", 3.0, None)


def test_window_splits(spark):
    df = bars(spark, [(1, 1, 2.0), (1, 1, 0), (1, 1, 1.5)])
    row = P.window_splits(df).first()
    assert (row.ratio, row.split_date) == (3.0, dt.date(2026, 1, 3))
    assert P.window_splits(bars(spark, [(1, 1, 0), (1, 1, None)])).count() == 0


def test_daily_mean(spark):
    df = bars(spark, [(1, 10, 0)]).unionByName(bars(spark, [(1, 20, 0)], symbol="B"))
    assert P.daily_mean(df).select(F.col("close")).first()[0] == 15.0
