import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelyard.functions import exprs as X
from panelyard.functions import tags as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def num(v):
    return F.lit(v).cast("double")


def test_division_and_changes(spark):
    r = one(
        spark, zero=X.safe_div(num(1), num(0)), inf=X.safe_div(num(1e308), num(1e-10)), neg=X.safe_div(num(1), num(-2)),
        nan=X.safe_div(num(float("nan")), num(1)), pct=X.pct_from(num(110), num(100)), up=X.signed_change(num(100), num(-50)),
        down=X.signed_change(num(-25), num(-50)), base0=X.signed_change(num(1), num(0)),
    )
    assert (r.zero, r.inf, r.nan, r.base0) == (None, None, None, None)
    assert r.neg == -0.5 and r.pct == pytest.approx(10) and r.up == 100.0 and r.down == -150.0


def test_cagr(spark):
    r = one(spark, ok=X.cagr(num(121), num(100), 2), loss=X.cagr(num(121), num(-100), 2), none=X.cagr(num(None), num(1), 2))
    assert r.ok == pytest.approx(10) and r.loss is None and r.none is None


def test_range_position(spark):
    r = one(spark, mid=X.range_position(num(15), num(10), num(20)), low=X.range_position(num(5), num(10), num(20)),
            high=X.range_position(num(25), num(10), num(20)), flat=X.range_position(num(1), num(1), num(1)), none=X.range_position(num(None), num(1), num(2)))
    assert (r.mid, r.low, r.high, r.flat, r.none) == (50.0, 0.0, 100.0, None, None)


@pytest.mark.parametrize("text, want", [("Price change %, 1 day", "price_change_pct_1_day"), (" R&D ratio, Annual ", "r_and_d_ratio_annual"), ("__A--b__", "a_b")])
def test_snake_case(spark, text, want):
    assert X.to_snake(text) == want
    assert one(spark, s=X.to_snake_col(F.lit(text))).s == want


def test_symbols(spark):
    r = one(spark, a=X.normal_symbol(F.lit(" reliance ")), b=X.normal_symbol(F.lit("m_m")), c=X.normal_symbol(F.lit("  ")), d=X.normal_symbol(F.lit(None)),
            e=X.exchange(F.lit("NSE (India)")), f=X.exchange(F.lit("bse ltd")), g=X.exchange(F.lit(None)), h=X.ticker(F.lit("X"), F.lit("BSE")), i=X.ticker(F.lit("X"), F.lit("?")))
    assert list(r) == ["RELIANCE", "M-M", None, None, "NSE", "BSE", "NSE", "X.BO", "X.NS"]


def test_lenient_number(spark):
    r = one(spark, a=X.lenient_number(F.lit("1,234.5")), b=X.lenient_number(F.lit("-")), c=X.lenient_number(F.lit("12.5")), d=X.lenient_number(F.lit("NaN")))
    assert list(r) == [None, None, 12.5, None]


@pytest.mark.parametrize("name, want", [
    ("Total_Market_20260820_x.csv", dt.date(2026, 8, 20)), ("Total_Market_2026-13-45.csv", None), ("/a/2020-01-01/file_2026_08_21.csv", dt.date(2026, 8, 21)),
    ("plain.csv", None), ("x_19991231.csv", None),
])
def test_date_in_name(spark, name, want):
    assert one(spark, d=X.date_in_name(F.lit(name))).d == want


NOW = "2026-07-20 10:00:00"


@pytest.mark.parametrize("html, want", [
    ("<p>Upcoming result date: 24 Jul 2026</p>", dt.date(2026, 7, 24)),
    ("<div>page <div><p>Upcoming result date: <b>24 July 2026</b></p></div> and 1 Jan 2001: more</div>", dt.date(2026, 7, 24)),
    ("<span>UPCOMING RESULT DATE: Tomorrow</span>", dt.date(2026, 7, 21)),
    ("<li>upcoming result date: today</li>", dt.date(2026, 7, 20)),
    ("<p>Upcoming result date: 2026-07-24</p>", dt.date(2026, 7, 24)),
    ("<p>Upcoming result date: 24-07-2026</p>", dt.date(2026, 7, 24)),
    ("<p>Upcoming result date: soon</p>", None), ("<p>Upcoming result date: 99 Foo 2026</p>", None),
    ("<p>nothing</p>", None), ("", None), (None, None),
    # A label in an element of its own holds no date; nested values belong to the element.
    ("<div><span>Upcoming result date</span>: 24 Jul 2026</div>", None),
    ("<p>Upcoming <b>result</b>\n date: <span>24 Jul 2026</span></p>", dt.date(2026, 7, 24)),
    ("<div><span>x</span> Upcoming result date: <div>24 Jul 2026</div></div><p>1 Jan 2001</p>", dt.date(2026, 7, 24)),
    ("<div>1 Jan 2001: " + "<p>filler text</p>" * 3000 + "<p class='a'>Upcoming result date: 24 Jul 2026</p></div>", dt.date(2026, 7, 24)),
    ("<pre>Upcoming result date: 24 Jul 2026</pre>", None),
    ("<p>Upcoming result date: 24-Jul-2026 or 2026-07-24</p>", None),
    ("<li>Upcoming result date: 24 Jul 2026", dt.date(2026, 7, 24)),
])
def test_result_date(spark, html, want):
    page = spark.createDataFrame([(html,)], "html string")
    got = page.select(X.result_date("html", F.lit(NOW).cast("timestamp")).alias("d")).first().d
    assert got == want


def test_candles(spark):
    r = one(spark, a=X.green_candle(num(100), num(100)), b=X.green_candle(num(99), num(100)), c=X.green_candle(num(100), num(None)),
            d=X.closed_above(num(101), num(100)), e=X.closed_above(num(100), num(100)), f=X.closed_above(num(None), num(1)))
    assert list(r) == ["Y", "N", "N/A", "Y", "N", "N/A"]


def test_needs_check_and_stale(spark):
    now = F.lit("2026-08-21 12:00:00").cast("timestamp")
    ts = lambda s: F.lit(s).cast("timestamp")
    d = lambda s: F.lit(s).cast("date")
    yes = F.lit(True)
    r = one(
        spark, never=X.needs_check(F.lit(None).cast("boolean"), d(None), ts(None), now), past=X.needs_check(yes, d("2026-08-20"), ts(None), now),
        future=X.needs_check(yes, d("2026-08-25"), ts(None), now), fresh=X.needs_check(yes, d(None), ts("2026-08-21 00:00:00"), now),
        old=X.needs_check(yes, d(None), ts("2026-08-20 00:00:00"), now), unknown=X.needs_check(yes, d(None), ts(None), now),
    )
    assert list(r) == [True, True, False, False, True, True]
    s = one(spark, a=X.profit_is_stale(d("2026-08-20"), ts("2026-08-19"), now), b=X.profit_is_stale(d("2026-08-20"), ts("2026-08-21"), now),
            c=X.profit_is_stale(d("2026-08-25"), ts("2026-08-19"), now), n=X.profit_is_stale(d(None), ts("2026-08-19"), now))
    assert list(s) == [True, False, False, False]
    f = one(spark, age=X.feed_age_hours(ts("2026-08-21 06:00:00"), now), same=X.feed_is_stale(ts("2026-08-21 06:00:00"), now), old=X.feed_is_stale(ts("2026-08-20 23:00:00"), now), no=X.feed_is_stale(ts(None), now))
    assert list(f) == [6.0, False, True, True]


def test_tags(spark):
    df = spark.createDataFrame(
        [("a", "Nifty MidCap 150, Nifty 100 ,, Nifty Alpha 50"), ("b", None), ("c", "Nifty Tata Group 25% Cap,Other's")], "k string, index_tags string"
    )
    rows = {r.k: r for r in T.add_tag_columns(df, tag_names=["Nifty 100", "Other's"]).collect()}
    assert (rows["a"].cap_tier, rows["a"].index_count, rows["a"].is_alpha, rows["a"].is_any_factor, rows["a"].idx_nifty_100) == ("Large", 3, True, True, True)
    assert (rows["b"].cap_tier, rows["b"].index_count, rows["b"].is_any_factor, rows["b"].tags) == ("Unclassified", 0, False, [])
    assert rows["c"].is_tata_group and not rows["c"].is_any_factor and rows["c"].idx_other_s
    assert {r.tag for r in T.distinct_tags(df).collect()} == {"Nifty MidCap 150", "Nifty 100", "Nifty Alpha 50", "Nifty Tata Group 25% Cap", "Other's"}
