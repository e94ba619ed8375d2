"""Lifetime highs kept by month against the whole series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelyard.operators import high_months as H
from panelyard.operators import prices
from panelyard.sources import manifest as M

SCHEMA = "symbol string, date date, high double, close double, split_ratio double"
START = dt.date(2026, 1, 20)


def series(days, seed=1):
    """Rising and falling symbols with splits, gaps, missing highs and ties."""
    rng, rows = random.Random(seed), []
    for s in range(6):
        price = 100.0
        for i in range(days):
            if rng.random() < 0.15 or (s == 5 and i < 12):
                continue
            price = max(1.0, price + rng.choice([-4.0, 0.0, 0.0, 3.0]))
            split = rng.choice([2.0, 4.0, 0.5]) if rng.random() < 0.12 else rng.choice([0.0, None])
            price = price / split if split else price
            rows.append((f"S{s}", START + dt.timedelta(days=i), None if rng.random() < 0.1 else price, price, split))
    return rows


def brute(rows):
    out = {}
    for symbol in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == symbol), key=lambda r: r[1])
        best, after = None, 1.0
        for _, day, high, _, split in reversed(mine):
            if high is not None and (best is None or high / after >= best[0]):
                best = (high / after, day)
            after *= split or 1.0
        if best:
            out[symbol] = (*best, mine[-1][1])
    return out


def as_dict(df):
    return {r.symbol: (r.ath_price, r.ath_date, r.last_bar) for r in df.collect()}


def test_thirty_daily_appends(spark, tmp_path):
    """After each day the highs equal those of the whole series, and only the day's month is read."""
    rows, store = series(45), str(tmp_path)
    first = START + dt.timedelta(days=15)
    H.replace(spark, store, spark.createDataFrame([r for r in rows if r[1] < first], SCHEMA))
    for i in range(30):
        day = first + dt.timedelta(days=i)
        before = {e.key: e.folder for e in M.load(spark, store)[1]}
        changed = H.append(spark, store, spark.createDataFrame([r for r in rows if r[1] == day], SCHEMA))
        assert changed == [str(day.replace(day=1))]
        now = {e.key: e.folder for e in M.load(spark, store)[1]}
        assert {k for k in now if now[k] != before.get(k)} == {(H.KIND, changed[0])}
        assert as_dict(H.lifetime_highs(H.read(spark, store))) == brute([r for r in rows if r[1] <= day])
    whole = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(prices.lifetime_highs(whole)) == as_dict(H.lifetime_highs(H.read(spark, store))) == as_dict(H.lifetime_highs(H.months(whole)))


def test_composition_is_associative(spark):
    rows = series(70, seed=3)
    cuts = [START + dt.timedelta(days=d) for d in (0, 9, 23, 41, 70)]
    parts = [H.months(spark.createDataFrame([r for r in rows if a <= r[1] < b], SCHEMA)) for a, b in zip(cuts, cuts[1:], strict=False)]
    left = H.composed(parts)
    right = H.compose(parts[0], H.compose(parts[1], H.compose(parts[2], parts[3])))
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect()))
    assert as_dict(H.lifetime_highs(left)) == brute(rows)


def test_late_bars_are_refused(spark, tmp_path):
    rows, store = series(30), str(tmp_path)
    H.replace(spark, store, spark.createDataFrame(rows, SCHEMA))
    held = M.load(spark, store)
    with pytest.raises(M.SnapshotError, match="not new"):
        H.append(spark, store, spark.createDataFrame([rows[-1]], SCHEMA))
    assert H.append(spark, store, spark.createDataFrame([], SCHEMA)) == [] and M.load(spark, store) == held
    # a month that is made anew takes the correction in
    month = rows[-1][1].replace(day=1)
    fixed = [(s, d, 9999.0 if (s, d) == rows[-1][:2] else h, c, r) for s, d, h, c, r in rows]
    H.replace(spark, store, spark.createDataFrame([r for r in fixed if r[1] >= month], SCHEMA))
    assert as_dict(H.lifetime_highs(H.read(spark, store))) == brute(fixed)


def test_seeding_from_kept_highs(spark):
    """Missing triggers come out the same from the full series and from the highs by month."""
    from panelyard.operators import scanner

    bars = spark.createDataFrame(series(40), SCHEMA)
    state = spark.createDataFrame([("S1", 5.0, START, None, None, None)], "symbol string, ath_price double, ath_date date, today_ath double, last_split_check date, last_updated timestamp")
    universe, now = bars.select("symbol").distinct(), F.lit("2026-03-01 00:00:00")
    full = scanner.seed_missing(state, universe, bars, now)
    kept = scanner.seed_missing(state, universe, None, now, stored=H.lifetime_highs(H.months(bars)))
    for a, b in zip(full, kept, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() >= 5


def test_symbols_without_highs(spark):
    bars = spark.createDataFrame([("A", START, None, 1.0, 2.0), ("B", START, 3.0, 1.0, None)], SCHEMA)
    assert as_dict(H.lifetime_highs(H.months(bars))) == {"B": (3.0, START, START)}
    assert H.lifetime_highs(H.months(bars.where(F.lit(False)))).count() == 0
