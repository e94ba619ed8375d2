"""Joins on the stable key: assembling the wide frame, coverage, resolution, parity."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions.exprs import count_where, safe_div
from panelyard.operators import order_stats


def keep_first(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """One row per key, the first in input order. An aggregate and not a window, so that
    a key repeated very often is thinned before the shuffle."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    picked = df.groupBy(key).agg(F.min_by(row, order).alias("__r"))
    return picked.select(key, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def assemble(base: DataFrame, others: Sequence[DataFrame], key: str | list[str] = "isin", checked: bool = True) -> DataFrame:
    """Left-join secondary frames onto the base, which defines the universe. Every other
    frame must hold a key once, or rows would multiply."""
    for other in others:
        clash = (set(other.columns) & set(base.columns)) - set([key] if isinstance(key, str) else key)
        if clash and checked:
            other = other.select(*[F.col(c).alias(f"{c}_sc" if c in clash else c) for c in other.columns])
        base = base.join(other, key, "left")
    return base


def source_coverage(base: DataFrame, sources: dict[str, DataFrame], key: str = "isin") -> DataFrame:
    """Per secondary source: base rows matched, of how many, in percent. The base is
    read once."""
    marked = base.select(key)
    for i, source in enumerate(sources.values()):
        marked = marked.join(source.select(key).distinct().withColumn(f"__hit{i}", F.lit(1)), key, "left")
    counts = marked.agg(F.count("*").alias("of"), *[F.count(f"__hit{i}").alias(f"__n{i}") for i in range(len(sources))])
    rows = F.array(*[
        F.struct(F.lit(name).alias("source"), F.col(f"__n{i}").alias("matched"), F.col("of"))
        for i, name in enumerate(sources)
    ])
    return counts.select(F.inline(rows)).withColumn("pct", F.try_divide(F.col("matched") * 100.0, F.col("of")))


def unmatched(base: DataFrame, source: DataFrame, shown: Sequence[str], key: str = "isin") -> DataFrame:
    """Base rows a source does not cover; a null key is not covered."""
    return base.join(source.select(key), key, "left_anti").select(*shown)


def feed_coverage(universe: DataFrame, feed: DataFrame, key: str = "isin") -> DataFrame:
    """Size of a universe, how much of it a feed covers, and the size of the feed."""
    known = feed.select(key).where(F.col(key).isNotNull()).distinct()
    hit = universe.join(known.withColumn("__hit", F.lit(1)), key, "left").agg(
        F.count("*").alias("size"), F.count("__hit").alias("matched")
    )
    feed_size = known.agg(F.count("*")).scalar()
    return hit.withColumns({"feed_companies": feed_size, "unmatched": F.col("size") - F.col("matched")})


def verdict_state(df: DataFrame, verdicts: DataFrame, key: str = "isin", out: str = "profit_state") -> DataFrame:
    """``at_ath``, ``not_at_ath`` or ``no_data``: absence from the feed is no verdict, a
    null flag is a negative one."""
    table = verdicts.select(key, F.coalesce("pat_both_at_ath", F.lit(False)).alias("__v"))
    state = F.when(F.col("__v").isNull(), "no_data").when(F.col("__v"), "at_ath").otherwise("not_at_ath")
    return df.join(table, key, "left").withColumn(out, state).drop("__v")


def verdict_status(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("companies"), F.max("fetched_at").alias("fetched_at"))


def parity(a: DataFrame, b: DataFrame, flag: str = "pat_both_at_ath", key: str = "isin") -> DataFrame:
    """Keys both tables hold whose flags differ; null counts as False."""
    left = a.select(key, F.coalesce(flag, F.lit(False)).alias("a"))
    right = b.select(key, F.coalesce(flag, F.lit(False)).alias("b"))
    return left.join(right, key).where(F.col("a") != F.col("b"))


def parity_counts(a: DataFrame, b: DataFrame, flag: str = "pat_both_at_ath", key: str = "isin") -> DataFrame:
    left = a.select(key, F.coalesce(flag, F.lit(False)).alias("a"))
    right = b.select(key, F.coalesce(flag, F.lit(False)).alias("b"))
    both = left.join(right, key, "full_outer")
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(
        F.count("a").alias("rows_a"), F.count("b").alias("rows_b"), count_where(shared).alias("shared"),
        count_where(shared & (F.col("a") != F.col("b"))).alias("mismatched"),
    )


def latest_supplied(provenance: DataFrame, as_of: str, sources: Sequence[str] | None = None) -> DataFrame:
    """For every source the newest earlier snapshot that supplied it.

    ``provenance``: snapshot_date, source, filename, carried_forward.
    """
    rows = provenance.where(
        (F.col("snapshot_date") <= F.lit(as_of).cast("date")) & ~F.col("carried_forward")
    )
    if sources:
        rows = rows.where(F.col("source").isin(list(sources)))
    return rows.groupBy("source").agg(
        F.max("snapshot_date").alias("from_snapshot"), F.max_by("filename", "snapshot_date").alias("filename")
    )


def disagreeing_pairs(
    df: DataFrame, pairs: Sequence[tuple[str, str, str]] | None = None, min_overlap: int = K.CONFLICT_MIN_OVERLAP,
) -> DataFrame:
    """Two columns for one concept: overlap, correlation, median absolute gap. All pairs
    come from one pass."""
    present = [(a, b, c) for a, b, c in pairs or K.CONFLICT_PAIRS if a in df.columns and b in df.columns]
    plain, medians = {}, {}
    for i, (a, b, _) in enumerate(present):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        plain[f"n{i}"] = count_where(both)
        plain[f"r{i}"] = F.corr(F.when(both, F.col(a)), F.when(both, F.col(b)))
        medians[f"m{i}"] = order_stats.median(F.abs((safe_div(a, b) - 1) * 100))
    rows = F.array(*[
        F.struct(
            F.lit(label).alias("concept"), F.lit(a).alias("primary_col"), F.lit(b).alias("secondary_col"),
            F.col(f"n{i}").alias("n_overlap"), F.col(f"r{i}").alias("correlation"),
            F.col(f"m{i}").alias("median_abs_diff_pct"),
            F.when(F.col(f"m{i}") > K.CONFLICT_BOTH_ABOVE_PCT, "both retained").otherwise("primary").alias("resolution"),
        )
        for i, (a, b, label) in enumerate(present)
    ])
    return order_stats.aggregate(df, [], plain, medians).select(F.inline(rows)).where(F.col("n_overlap") >= min_overlap)
