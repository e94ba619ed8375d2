"""Column catalog: coverage joined with supplied metadata (segment, group, unit, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.operators.order_stats import aggregate, median


def coverage(df: DataFrame) -> DataFrame:
    """(column, non_null, total, coverage_pct): one aggregate pass, then one row per
    column."""
    columns = df.columns
    wide = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("non_null")) for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(cells), F.col("n").alias("total")).withColumn(
        "coverage_pct", F.try_divide(F.col("non_null") * 100.0, F.col("total"))
    )


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(df.dtypes), "name string, dtype string")


METADATA = (
    "name string, label string, segment string, `group` string, description string, "
    "description_source string, source string, provenance string, unit string, fmt string, "
    "polarity string, notes string"
)


def screenable(name: Column, coverage_pct: Column, unit: Column) -> Column:
    """At least half populated and neither text nor date; a tag flag always."""
    return name.startswith("idx_") | (
        (coverage_pct >= K.SCREENABLE_FROM_COVERAGE_PCT) & ~unit.isin("text", "date")
    )


def build(df: DataFrame, metadata: DataFrame, masked: list[str] | None = None) -> DataFrame:
    """One row per column of ``df``. Columns without metadata get the neutral defaults."""
    name, cov = F.col("name"), F.col("coverage_pct")
    base = coverage(df).select(F.col("column").alias("name"), F.bround("coverage_pct", 1).alias("coverage_pct"))
    joined = base.join(column_types(df), "name").join(metadata, "name", "left")
    d = F.col("dtype")
    default_unit = (
        F.when(d == "boolean", "bool").when(d.isin("date", "timestamp", "timestamp_ntz"), "date")
        .when(d.isin("string") | d.startswith("array"), "text").otherwise("ratio")
    )
    unit = F.coalesce("unit", default_unit)
    provenance = F.coalesce("provenance", F.lit("reported"))
    flags = F.array_compact(F.array(
        F.when(cov < K.SCREENABLE_FROM_COVERAGE_PCT,
               F.concat(F.lit("low_coverage_"), F.bround(cov, 0).cast("int").cast("string"), F.lit("pct"))),
        F.when(name.startswith("idx_"), "index_membership"),
        F.when(provenance != "reported", provenance),
    ))
    hidden = K.MASKED_METRICS if masked is None else masked
    return joined.select(
        "name", F.coalesce("label", "name").alias("label"),
        F.coalesce("segment", F.lit("Overview")).alias("segment"),
        F.coalesce("group", F.lit("Other")).alias("group"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("description_source", F.lit("none")).alias("description_source"),
        F.coalesce("source", F.lit("derived")).alias("source"),
        provenance.alias("provenance"), "dtype", "coverage_pct", unit.alias("unit"),
        F.coalesce("fmt", F.lit("text")).alias("fmt"),
        F.coalesce("polarity", F.lit("neutral")).alias("polarity"),
        (~name.isin(hidden)).alias("finance_valid"),
        screenable(name, cov, unit).alias("screenable"),
        F.coalesce("notes", F.lit("")).alias("notes"), flags.alias("flags"),
    )


def by_segment(catalog: DataFrame) -> DataFrame:
    """Columns of each segment as a list ordered by name; a list is as long as the
    schema is wide."""
    spec = F.struct("name", "label", "unit", "group", "fmt", "polarity", "coverage_pct", "screenable", "provenance", "finance_valid")
    return catalog.groupBy("segment").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(spec)).alias("columns")
    ).orderBy("segment")


def ordered(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("segment", "name")


def segment_summary(catalog: DataFrame) -> DataFrame:
    """Columns, screenable columns, median and lowest coverage per segment."""
    return aggregate(
        catalog, ["segment"],
        {
            "columns": F.count("*"), "screenable": F.count_if("screenable"),
            "min_coverage": F.min("coverage_pct"),
        },
        {"median_coverage": median("coverage_pct")},
        bounded=True,
    )


def tag_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith("idx_"))
