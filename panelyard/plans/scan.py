"""The record-high scan from stored state to results, and the state tables it keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.operators import scanner, universe
from panelyard.session import cut_lineage
from panelyard.sources import tables


RESULTS = (
    "symbol string, new_ath_price double, trigger_price double, green_candle string, close_gt_ath string, "
    "ath_outperformance string, current_rs double, ath_rs double, profit_state string, profit_stale boolean, "
    "result_date date, stop_loss double, scanned_at timestamp"
)


@dataclass
class Scan:
    triggers: DataFrame
    state: DataFrame
    events: DataFrame
    results: DataFrame
    failed: DataFrame


def run(
    stored: DataFrame, state: DataFrame, bars: DataFrame, window_bars: DataFrame, benchmark: DataFrame,
    verdicts: DataFrame, result_dates: DataFrame, as_of: Column, sessions: int = K.RS_SESSIONS,
) -> Scan:
    """Clear, seed, repair, filter, analyse. Splits are repaired before the comparison:
    a trigger in old shares could never be reached again. Bars after ``as_of`` are not seen."""
    known = F.col("date") <= as_of.cast("date")
    bars, window_bars, benchmark = bars.where(known), window_bars.where(known), benchmark.where(known)
    listed = universe.active(stored)
    cleared = scanner.clear_today(state)
    seeded, seed_events = scanner.seed_missing(cleared, listed, bars, as_of)
    scanned = window_bars.join(listed.select("symbol"), "symbol", "left_semi")
    repaired, split_events = scanner.repair_splits(seeded, scanned, as_of)
    # The repaired triggers feed the filter, the marks and the new state.
    repaired = cut_lineage(repaired)
    hits = scanner.find_hits(listed, repaired, scanned)
    results = scanner.analyse(hits, bars, benchmark, verdicts, result_dates, as_of, sessions)
    return Scan(
        triggers=repaired,
        state=scanner.mark_today(repaired, results),
        events=seed_events.unionByName(split_events),
        results=results,
        failed=scanner.failed_symbols(listed, scanned),
    )


def summary(scan: Scan) -> DataFrame:
    return scan.results.agg(F.count("*").alias("hits")).withColumns(
        {
            "failed": scan.failed.agg(F.count("*")).scalar(),
            "seeded": scan.events.agg(F.count_if(F.col("source") == "seed")).scalar(),
        }
    )


def save(scan: Scan, store: str, scanned_at: Column) -> None:
    """Publish a scan. State and results are replaced as a whole; events are kept under the
    time of their scan, so a scan that is saved again leaves one set. The results are computed
    once: the new state marks today's highs from the written table."""
    events = scan.events.withColumn("scan", scanned_at.cast("timestamp").cast("string"))
    tables.overwrite_parts(events, f"{store}/ath_events", "scan")
    results = scan.results.withColumn("scanned_at", scanned_at.cast("timestamp"))
    tables.replace(results, f"{store}/scan_results")
    written = tables.read_current(scan.results.sparkSession, f"{store}/scan_results", RESULTS)
    tables.replace(scanner.mark_today(scan.triggers, written), f"{store}/ath")


def load_results(spark: SparkSession, store: str) -> DataFrame:
    return tables.read_current(spark, f"{store}/scan_results", RESULTS)


def load_state(spark: SparkSession, store: str) -> DataFrame:
    return tables.read_current(spark, f"{store}/ath", scanner.STATE)


def load_events(spark: SparkSession, store: str) -> DataFrame:
    path = f"{store}/ath_events"
    if not tables.exists(spark, path):
        return spark.createDataFrame([], scanner.EVENTS)
    return spark.read.schema(scanner.EVENTS).parquet(path).drop("scan")
