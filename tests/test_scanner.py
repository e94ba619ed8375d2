import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelyard.operators import scanner as S
from panelyard.plans import scan as plan

BARS = "symbol string, date date, high double, close double, split_ratio double"
LIST = "symbol string, exchange string, isin string, accord_code string, resolution string, ignored boolean, ignore_reason string, source_file string"
def as_of():
    return F.lit("2026-08-27 18:00:00")


def day(n):
    return dt.date(2026, 8, n)


def state(spark, rows):
    """(symbol, price, today, last_split_check)"""
    return spark.createDataFrame([(s, p, dt.date(2026, 1, 1), t, c, None) for s, p, t, c in rows], S.STATE)


def bars(spark, symbol, highs, closes=None, split=None):
    closes = closes or highs
    return spark.createDataFrame(
        [(symbol, day(20 + i), h, c, (split or {}).get(i, 0.0)) for i, (h, c) in enumerate(zip(highs, closes))], BARS
    )


def listed(spark, *symbols):
    return spark.createDataFrame([(s, "NSE", f"I-{s}") for s in symbols], "symbol string, exchange string, isin string")


def price(df, symbol):
    row = df.where(F.col("symbol") == symbol).first()
    return row.ath_price if row else None


def test_promote_and_again(spark):
    st = state(spark, [("AAA", 100.0, 120.0, None), ("BBB", 50.0, 60.0, None), ("CCC", 100.0, 90.0, None)])
    chosen = spark.createDataFrame([("AAA",), ("CCC",)], "symbol string")
    new, events = S.promote(st, chosen, F.lit("2026-08-27"), as_of())
    got = {r.symbol: (r.ath_price, r.today_ath) for r in new.collect()}
    assert got == {"AAA": (120.0, None), "BBB": (50.0, None), "CCC": (100.0, None)}
    assert [(r.symbol, r.old_price, r.new_price, r.source) for r in events.collect()] == [("AAA", 100.0, 120.0, "sync")]
    again, more = S.promote(new, chosen, F.lit("2026-08-28"), as_of())
    assert more.count() == 0 and price(again, "AAA") == 120.0


def test_promote_without_a_trigger(spark):
    st = state(spark, [("AAA", None, 5.0, None)])
    new, events = S.promote(st, st.select("symbol"), F.lit("2026-08-27"), as_of())
    assert price(new, "AAA") == 5.0 and events.count() == 1


def test_split_repair(spark):
    st = state(spark, [("AAA", 8235.0, None, None)])
    new, events = S.repair_splits(st, bars(spark, "AAA", [1.0, 1.0], split={1: 1.5}), as_of())
    assert price(new, "AAA") == 5490.0
    e = events.first()
    assert e.source == "split" and "1.5" in e.note and e.event_date == day(21)


def test_repair_is_idempotent(spark):
    seen = bars(spark, "AAA", [1.0, 1.0, 1.0], split={1: 2.0})
    once, _ = S.repair_splits(state(spark, [("AAA", 793.5, None, None)]), seen, as_of())
    twice, events = S.repair_splits(once, seen, as_of())
    assert price(once, "AAA") == price(twice, "AAA") == 396.75 and events.count() == 0


@pytest.mark.parametrize("checked, want", [(day(21), 793.5), (day(20), 396.75), (day(25), 793.5)])
def test_split_already_accounted_for(spark, checked, want):
    new, _ = S.repair_splits(state(spark, [("AAA", 793.5, None, checked)]), bars(spark, "AAA", [1.0, 1.0], split={1: 2.0}), as_of())
    row = new.first()
    assert row.ath_price == want and row.last_split_check == max(checked, day(21))


def test_manual_edit_survives_a_split(spark):
    edits = spark.createDataFrame([("AAA", 798.85, "2026-08-01"), ("NEW", 5.0, "2026-08-02")], "symbol string, price double, date string")
    st, events = S.manual_edit(state(spark, [("AAA", 198.0, None, None)]), edits, as_of())
    assert sorted(r.source for r in events.collect()) == ["manual", "manual"] and price(st, "NEW") == 5.0
    new, _ = S.repair_splits(st, bars(spark, "AAA", [1.0, 1.0], split={1: 2.0}), as_of())
    assert price(new, "AAA") == 798.85


def test_high_on_the_split_day(spark):
    window = bars(spark, "AAA", [780.0, 395.0], [770.0, 390.0], split={1: 2.0})
    st, _ = S.repair_splits(state(spark, [("AAA", 780.0, None, None)]), window, as_of())
    hits = S.find_hits(listed(spark, "AAA"), st, window).collect()
    assert price(st, "AAA") == 390.0 and [h.symbol for h in hits] == ["AAA"]


def test_hits_failures_and_missing_triggers(spark):
    window = (
        bars(spark, "WIN", [100.0, 95.0, 120.0], [90.0, 94.0, 118.0])
        .unionByName(bars(spark, "LOSE", [100.0, 95.0, 120.0]))
        .unionByName(bars(spark, "EQUAL", [100.0, 120.0]))
        .unionByName(bars(spark, "SHORT", [500.0]))
        .unionByName(bars(spark, "NOTRIG", [1.0, 2.0]))
    )
    st = state(spark, [("WIN", 100.0, None, None), ("LOSE", 500.0, None, None), ("EQUAL", 120.0, None, None), ("SHORT", 1.0, None, None), ("GONE", 1.0, None, None)])
    names = listed(spark, "WIN", "LOSE", "EQUAL", "SHORT", "NOTRIG", "GONE")
    hits = {h.symbol: h for h in S.find_hits(names, st, window).collect()}
    assert set(hits) == {"WIN", "EQUAL"} and hits["WIN"].prev_close == 94.0 and hits["WIN"].trigger == 100.0
    assert {r.symbol for r in S.failed_symbols(names, window).collect()} == {"SHORT", "GONE"}


def test_hit_filter_works_to_the_cent(spark):
    window = bars(spark, "AAA", [1.0, 99.996])
    assert S.find_hits(listed(spark, "AAA"), state(spark, [("AAA", 100.0, None, None)]), window).count() == 1
    # 100.25 halved by a split is 50.125, which is 50.12 to the cent.
    half = bars(spark, "AAA", [1.0, 50.12])
    assert S.find_hits(listed(spark, "AAA"), state(spark, [("AAA", 50.125, None, None)]), half).count() == 1


def test_repeated_splits_and_log(spark):
    rows = [("AAA", day(20), 4.0, 2.0, None, None, "split", None, dt.datetime(2026, 8, 20)), ("AAA", day(21), 2.0, 1.0, None, None, "split", None, dt.datetime(2026, 8, 21)),
            ("BBB", day(20), 4.0, 2.0, None, None, "split", None, dt.datetime(2026, 8, 20)), ("BBB", day(22), 4.0, 2.0, None, None, "sync", None, dt.datetime(2026, 8, 27, 9))]
    log = spark.createDataFrame(rows, S.EVENTS)
    assert [tuple(r) for r in S.repeated_splits(log).collect()] == [("AAA", 2)]
    assert [r.new_price for r in S.symbol_events(log, "AAA", 1).collect()] == [1.0]
    done = S.sync_status(spark.createDataFrame([("BBB",)], "symbol string"), log, as_of()).first()
    part = S.sync_status(spark.createDataFrame([("BBB",), ("AAA",)], "symbol string"), log, as_of()).first()
    none = S.sync_status(spark.createDataFrame([], "symbol string"), log, as_of()).first()
    assert (done.post_sync, part.post_sync, none.post_sync) == (True, False, False)
    assert S.reset(state(spark, [("A", 1.0, None, None)]), log)[1].count() == 4
    assert S.reset(state(spark, [("A", 1.0, None, None)]), log, True)[1].count() == 0


@pytest.fixture()
def scan(spark):
    stored = spark.createDataFrame(
        [("OLD", "NSE", "I1", "1", "auto", False, None, "f"), ("NEW", "NSE", None, "2", "unresolved", False, None, "f"), ("DEAD", "NSE", "I3", "3", "auto", True, "delisted", "f")], LIST
    )
    rows = [(s, dt.date(2026, 1, 1) + dt.timedelta(days=i), 100.0 + i, 100.0 + i, 0.0) for s in ("OLD", "NEW", "DEAD") for i in range(30)]
    bars_ = spark.createDataFrame(rows, BARS)
    window = bars_.where("date >= DATE'2026-01-26'")
    bench = bars_.select("date").distinct().withColumn("close", F.lit(50.0))
    verdicts = spark.createDataFrame([("I1", True, dt.datetime(2026, 8, 19))], "isin string, pat_both_at_ath boolean, fetched_at timestamp")
    dates = spark.createDataFrame([("OLD", day(20))], "symbol string, result_date date")
    st = state(spark, [("OLD", 120.0, 999.0, None)])
    return plan.run(stored, st, bars_, window, bench, verdicts, dates, as_of(), sessions=20)


def test_whole_scan(spark, scan, tmp_path):
    rows = {r.symbol: r for r in scan.results.collect()}
    assert set(rows) == {"OLD", "NEW"}
    old, new = rows["OLD"], rows["NEW"]
    assert (old.new_ath_price, old.trigger_price, old.green_candle, old.close_gt_ath, old.ath_outperformance) == (129.0, 120.0, "Y", "Y", "Y")
    assert (old.profit_state, old.profit_stale, new.profit_state, new.profit_stale) == ("at_ath", True, "no_data", False)
    got = {r.symbol: r for r in scan.state.collect()}
    # The trigger never moves in a scan; today's high is kept beside it.
    assert (got["OLD"].ath_price, got["OLD"].today_ath) == (120.0, 129.0)
    assert got["NEW"].ath_price == 129.0 and got["NEW"].last_split_check == dt.date(2026, 1, 30)
    s = plan.summary(scan).first()
    assert (s.hits, s.failed, s.seeded) == (2, 0, 1)
    store = str(tmp_path / "store")
    plan.save(scan, store, as_of())
    plan.save(scan, store, as_of())
    kept = {r.symbol: r.today_ath for r in plan.load_state(spark, store).collect()}
    assert kept == {"OLD": 129.0, "NEW": 129.0} and plan.load_results(spark, store).count() == 2
    assert plan.load_state(spark, store).count() == 2 and plan.load_events(spark, store).count() == 1
    assert plan.load_state(spark, str(tmp_path / "none")).count() == 0
