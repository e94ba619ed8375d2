"""Scan of newly arrived daily bars: a file stream whose every batch repairs splits,
finds hits and keeps the new state. One batch is the repeated scan of the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelyard.operators import scanner
from panelyard.session import cut_lineage
from panelyard.sources import tables

BARS = "symbol string, date date, high double, close double, split_ratio double"


def scan_batch(spark: SparkSession, store: str, listed: Callable[[], DataFrame], lookback_days: int):
    """The ``foreachBatch`` body. Every output of a batch has the batch number in its
    path and is overwritten, so a batch that is run again leaves one copy."""

    def run(batch: DataFrame, number: int) -> None:
        # Partitioned by day, so that the lookback reads its days only.
        dated = batch.where("date IS NOT NULL")
        if dated.isEmpty():
            return
        dated.write.mode("overwrite").partitionBy("date").parquet(f"{store}/bars/batch={number}")
        bars = spark.read.schema(f"{BARS}, batch long").parquet(f"{store}/bars").where(F.col("batch") <= number)
        # The newest day of all arrivals: a late file does not move the clock back.
        newest = bars.agg(F.max("date")).first()[0]
        window = bars.where(F.col("date") > F.date_sub(F.lit(newest), lookback_days))
        # Of bars of a symbol and day that arrived twice the later arrival holds.
        row = F.struct("high", "close", "split_ratio")
        window = window.groupBy("symbol", "date").agg(F.max_by(row, F.struct("batch", row)).alias("bar")).select("symbol", "date", "bar.*")
        as_of = F.lit(newest).cast("timestamp")
        earlier = [v for v in tables.versions(spark, f"{store}/ath") if v < number + 1]
        state = (
            spark.read.schema(scanner.STATE).parquet(f"{store}/ath/v{earlier[-1]:09d}")
            if earlier else spark.createDataFrame([], scanner.STATE)
        )
        rows = listed()
        repaired, events = scanner.repair_splits(scanner.clear_today(state), window, as_of)
        repaired = cut_lineage(repaired)
        hits = scanner.find_hits(rows, repaired, window)
        hits.write.mode("overwrite").parquet(f"{store}/hits/batch={number}")
        events.write.mode("overwrite").parquet(f"{store}/events/batch={number}")
        seen = spark.read.parquet(f"{store}/hits/batch={number}").select(
            "symbol", F.col("today_high").alias("new_ath_price")
        )
        tables.replace(scanner.mark_today(repaired, seen), f"{store}/ath", number + 1)

    return run


def start(
    spark: SparkSession, arrivals: str, store: str, listed: Callable[[], DataFrame], lookback_days: int = 7,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process what has arrived and stop; run again for the next arrivals."""
    reader = spark.readStream.schema(BARS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(arrivals).writeStream
        .foreachBatch(scan_batch(spark, store, listed, lookback_days))
        .option("checkpointLocation", f"{store}/_stream")
        .trigger(availableNow=True)
        .start()
    )
