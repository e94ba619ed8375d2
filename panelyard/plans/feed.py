"""Refresh of the stored record verdicts and identifiers from two arrived payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators import matching, periods, universe
from panelyard.sources import ingest, tables

VERDICTS = (
    "isin string, pat_ttm_at_ath boolean, pat_q_at_ath boolean, pat_both_at_ath boolean, qtrs_available bigint, "
    "pat_ttm double, pat_fy_peak double, pat_latest_q double, pat_peak_q double, fetched_at timestamp"
)
IDENTIFIERS = ", ".join(f"{c} string" for c in universe.IDENTIFIERS.values())


def verdicts(quarterly: DataFrame, yearly: DataFrame, fetched_at: Column) -> DataFrame:
    """Payloads (with an input-order column) to verdict rows."""
    q = periods.with_series(ingest.prepare_payload(quarterly), "Q")
    y = periods.with_series(periods.pad_periods(ingest.prepare_payload(yearly), "FY"), "FY")
    return periods.stored_verdicts(q, y, fetched_at)


def refresh(quarterly: DataFrame, yearly: DataFrame, store: str, fetched_at: Column) -> None:
    """Replace verdicts and identifiers, or change nothing: both payloads are checked
    before the first write, and a table moves to its new version only when complete."""
    ingest.validate_payload(quarterly, "quarterly", "Q")
    ingest.validate_payload(yearly, "yearly", "FY")
    found = verdicts(quarterly, yearly, fetched_at.cast("timestamp"))
    schema = [c.split()[0] for c in VERDICTS.split(", ")]
    tables.replace(found.select(*schema), f"{store}/profit")
    tables.replace(universe.identifiers(yearly), f"{store}/feed_identifiers")


def load_verdicts(spark: SparkSession, store: str) -> DataFrame:
    return tables.read_current(spark, f"{store}/profit", VERDICTS)


def load_identifiers(spark: SparkSession, store: str) -> DataFrame:
    """Identifiers under the headers the symbol resolution looks for."""
    df = tables.read_current(spark, f"{store}/feed_identifiers", IDENTIFIERS)
    return df.select(*[F.col(dst).alias(src) for src, dst in universe.IDENTIFIERS.items()])


def status(spark: SparkSession, store: str, as_of: Column) -> DataFrame:
    """Rows held, when they were fetched, their age and whether that was not today."""
    held = matching.verdict_status(load_verdicts(spark, store))
    return held.select("companies", *ingest.feed_status(F.col("fetched_at"), as_of))
