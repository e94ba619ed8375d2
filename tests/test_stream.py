import datetime as dt

from panelyard.operators import scanner as S
from panelyard.sources import tables
from panelyard.streaming import bars as stream


def day(n):
    return dt.date(2026, 8, n)


def test_arriving_bars(spark, tmp_path):
    store, arrivals = str(tmp_path / "store"), str(tmp_path / "in")
    tables.replace(spark.createDataFrame([("A", 100.0, day(1), None, None, None), ("B", 500.0, day(1), None, None, None)], S.STATE), f"{store}/ath", 0)

    def listed():
        return spark.createDataFrame([("A", "NSE", "I1"), ("B", "NSE", "I2")], "symbol string, exchange string, isin string")

    def arrive(rows):
        spark.createDataFrame(rows, stream.BARS).coalesce(1).write.mode("append").parquet(arrivals)

    arrive([("A", day(20), 90.0, 90.0, 0.0), ("A", day(21), 101.0, 99.0, 0.0), ("B", day(20), 10.0, 10.0, 0.0), ("B", day(21), 260.0, 250.0, 2.0)])
    stream.start(spark, arrivals, store, listed).awaitTermination()
    state = {r.symbol: r for r in tables.read_current(spark, f"{store}/ath", S.STATE).collect()}
    assert (state["A"].ath_price, state["A"].today_ath, state["B"].ath_price, state["B"].today_ath) == (100.0, 101.0, 250.0, 260.0)
    late = [("A", day(22), 50.0, 50.0, 0.0), ("B", day(22), 251.0, 200.0, 0.0)]
    arrive(late)
    stream.start(spark, arrivals, store, listed).awaitTermination()
    state = {r.symbol: r for r in tables.read_current(spark, f"{store}/ath", S.STATE).collect()}
    # The split is seen again in the lookback and is not applied again.
    assert (state["B"].ath_price, state["B"].today_ath, state["A"].today_ath) == (250.0, 251.0, None)
    assert spark.read.parquet(f"{store}/events").count() == 1
    # A batch that runs again leaves the same state and log.
    body = stream.scan_batch(spark, store, listed, 7)
    body(spark.createDataFrame(late, stream.BARS), 1)
    again = {r.symbol: r.ath_price for r in tables.read_current(spark, f"{store}/ath", S.STATE).collect()}
    assert again == {"A": 100.0, "B": 250.0} and spark.read.parquet(f"{store}/events").count() == 1
