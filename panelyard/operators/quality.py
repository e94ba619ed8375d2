"""Quality report, one DataFrame per section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions.exprs import count_where, safe_div, share
from panelyard.operators import catalog as C
from panelyard.operators import order_stats
from panelyard.operators.matching import disagreeing_pairs
from panelyard.operators.periods import history_depth


def coverage_report(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Coverage of every column with its catalog entry, worst first."""
    meta = catalog.select("name", "segment", "source", "provenance", "screenable")
    rows = C.coverage(df).withColumn("coverage_pct", F.bround("coverage_pct", 1))
    return (
        rows.join(meta, F.col("column") == F.col("name"), "left")
        .select("column", "non_null", "coverage_pct", "segment", "source", "provenance", "screenable")
        .orderBy("coverage_pct", "column")
    )


def segment_coverage(report: DataFrame) -> DataFrame:
    return order_stats.aggregate(
        report.where("segment IS NOT NULL"), ["segment"],
        {"columns": F.count("*"), "min_coverage": F.min("coverage_pct")},
        {"median_coverage": order_stats.median("coverage_pct")},
        bounded=True,
    ).orderBy("median_coverage", "segment")


def masking_impact(df: DataFrame, catalog: DataFrame, sector_value: str = K.MASKED_SECTOR) -> DataFrame:
    """Rows of the masked sector, their share, and the masked metrics."""
    hidden = catalog.where(~F.col("finance_valid"))
    return df.agg(
        count_where(F.col("sector") == sector_value).alias("finance_companies"),
        share(F.col("sector") == sector_value).alias("finance_pct_of_universe"),
    ).withColumns(
        {
            "masked_metrics": hidden.agg(F.count("*")).scalar(),
            "masked_list": hidden.agg(F.array_sort(F.collect_list("name"))).scalar(),
        }
    )


def reconstruction_check(
    df: DataFrame, derived: str, reported: str, tolerance: float = K.RECONSTRUCTION_TOLERANCE_PCT,
) -> DataFrame:
    """A rebuilt column against the reported values that exist, on the same rows."""
    if reported not in df.columns:
        return df.sparkSession.createDataFrame([(reported, "no reported values", None, None, None)], CHECK)
    both = df.where(F.col(reported).isNotNull() & F.col(derived).isNotNull())
    error = F.abs((safe_div(derived, reported) - 1) * 100)
    facts = order_stats.aggregate(both, [], {"n_overlap": F.count("*")}, {"e": order_stats.median(error)})
    return facts.select(
        F.lit(reported).alias("field"),
        F.when(F.col("n_overlap") == 0, "no overlap").otherwise("checked").alias("status"),
        "n_overlap", F.col("e").alias("median_abs_err_pct"), (F.col("e") < tolerance).alias("within_tolerance"),
    )


def reconstruction_by(df: DataFrame, by: str, days: DataFrame, derived: str, reported: str, tolerance: float = K.RECONSTRUCTION_TOLERANCE_PCT) -> DataFrame:
    """``reconstruction_check`` for every day of ``days``, from one pass."""
    both = df.where(F.col(reported).isNotNull() & F.col(derived).isNotNull())
    error = F.abs((safe_div(derived, reported) - 1) * 100)
    facts = order_stats.aggregate(both, [by], {"n_overlap": F.count("*")}, {"e": order_stats.median(error)})
    n = F.coalesce("n_overlap", F.lit(0).cast("bigint"))
    return days.join(facts, by, "left").select(
        by, F.lit(reported).alias("field"), F.when(n == 0, "no overlap").otherwise("checked").alias("status"),
        n.alias("n_overlap"), F.col("e").alias("median_abs_err_pct"), (F.col("e") < tolerance).alias("within_tolerance"),
    )


def gates(
    df: DataFrame, by: str, key: str = "isin", low: int | None = K.UNIVERSE_MIN, high: int | None = K.UNIVERSE_MAX,
    tiers: dict[str, int] | None = None, nominal: int = K.UNIVERSE_EXPECTED, slack: int = K.TIER_SLACK, tier: str = "cap_tier",
) -> DataFrame:
    """Every rule that a snapshot must meet, per day: (by, rule, found, low, high, violated). Rows
    are counted per key first, with a map-side combine, so a repeated key is one row and the keys
    never meet in one task. ``tiers`` gives the expected size of each tier: one may run short by
    as many rows as the universe lacks plus ``slack``, or over by ``slack``."""
    sized = [*(tiers or {}), *([K.NO_TIER] if tiers else [])]
    per_key = df.groupBy(by, key).agg(F.count("*").alias("n"), *[count_where(F.col(tier) == t).alias(f"t{i}") for i, t in enumerate(sized)])
    facts = per_key.groupBy(by).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("twice"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(sized))],
    )
    none = F.lit(None).cast("bigint")
    bound = lambda v: none if v is None else F.lit(v).cast("bigint")
    missing = F.greatest(F.lit(0), F.lit(nominal) - F.col("total"))
    rules = [("row_count", F.col("total"), bound(low), bound(high)), ("null_key", F.col("nulls"), none, bound(0)), ("duplicate_key", F.col("twice"), none, bound(0))]
    for i, t in enumerate(sized):
        known = (tiers or {}).get(t)
        least = none if known is None else (F.lit(known) - missing - slack).cast("bigint")
        rules.append((f"tier {t}", F.col(f"t{i}"), least, bound(slack if known is None else known + slack)))
    cells = [F.struct(F.lit(r).alias("rule"), found.cast("bigint").alias("found"), lo.alias("low"), hi.alias("high")) for r, found, lo, hi in rules]
    outside = F.coalesce(F.col("found") < F.col("low"), F.lit(False)) | F.coalesce(F.col("found") > F.col("high"), F.lit(False))
    return facts.select(by, F.inline(F.array(*cells))).withColumn("violated", outside)


CHECK = "field string, status string, n_overlap bigint, median_abs_err_pct double, within_tolerance boolean"


def drop_reasons(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("reason").agg(F.count("*").alias("n"))


def totals(report: DataFrame) -> DataFrame:
    """Headline counts of a coverage report."""
    c = F.col("coverage_pct")
    return report.agg(
        F.count("*").alias("columns_retained"),
        count_where(c == 100).alias("fully_populated_columns"),
        count_where(c < 50).alias("columns_below_50pct"),
        count_where(~F.coalesce("screenable", F.lit(True))).alias("non_screenable_columns"),
    )


def build_report(
    df: DataFrame, catalog: DataFrame, ledger: DataFrame, checks: list[DataFrame] | None = None,
) -> dict[str, DataFrame]:
    coverage = coverage_report(df, catalog)
    out = {
        "coverage": coverage,
        "totals": totals(coverage),
        "drop_reasons": drop_reasons(ledger),
        "segment_coverage": segment_coverage(coverage),
        "sector_masking": masking_impact(df, catalog),
    }
    if any(a in df.columns and b in df.columns for a, b, _ in K.CONFLICT_PAIRS):
        out["source_conflicts"] = disagreeing_pairs(df)
    if "qtrs_available" in df.columns or "fy_available" in df.columns:
        out["history_depth"] = history_depth(df)
    for i, check in enumerate(checks or []):
        out["reconstruction_checks"] = check if i == 0 else out["reconstruction_checks"].unionByName(check)
    return out
