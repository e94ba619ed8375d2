"""Column cleaning: header names, dead columns with reasons, input checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions.exprs import to_snake


def _c(name: str):
    return F.col(f"`{name}`")


def normal_name(column: str, mapping: dict[str, str] | None = None, key: str = "isin") -> str:
    """The explicit new name, or else snake case."""
    mapping = K.BASE_HEADERS if mapping is None else mapping
    name = mapping.get(column, column)
    return name if name in set(mapping.values()) or name == key else to_snake(name)


def normalise_names(df: DataFrame, mapping: dict[str, str] | None = None, key: str = "isin") -> DataFrame:
    """Explicit renames, snake case for the rest; two columns of one name are an error."""
    names = [normal_name(column, mapping, key) for column in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"name collision after normalisation: {twice}")
    return df.toDF(*names)


def nan_to_null(df: DataFrame) -> DataFrame:
    from panelyard.functions.exprs import number

    kinds = dict(df.dtypes)
    return df.select(*[
        number(_c(c)).alias(c) if kinds[c] in ("double", "float") else _c(c) for c in df.columns
    ])


def drop_listed(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*(K.SECONDARY_DROPPED if columns is None else columns))


def column_facts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and group of ``by``), from one aggregate over the frame: column, base
    (what a repeated header ``name.1`` repeats), rows, filled, and whether it equals its base
    throughout."""
    columns = [c for c in df.columns if c not in by]
    base_of = {c: c[:-2] for c in columns if c.endswith(".1")}
    measures = [F.count("*").alias("rows")]
    cells = []
    for i, c in enumerate(columns):
        base = base_of.get(c)
        measures.append(F.count(_c(c)).alias(f"filled{i}"))
        equal = F.lit(False)
        if base in df.columns:
            measures.append(F.coalesce(F.bool_and(_c(c).eqNullSafe(_c(base))), F.lit(True)).alias(f"equal{i}"))
            equal = F.col(f"equal{i}")
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit(base).cast("string").alias("base"), F.col("rows"),
            F.col(f"filled{i}").alias("filled"), equal.alias("equal"),
        ))
    return df.groupBy(*by).agg(*measures).select(*by, F.inline(F.array(*cells)))


def dropped_columns(
    df: DataFrame, min_coverage_pct: float = K.DROP_BELOW_COVERAGE_PCT, universe_n: int | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """(column, reason, detail) of currency, repeated, listed-empty and thin columns, per group of
    ``by``. Of several reasons the first holds."""
    total = F.col("rows") if universe_n is None else F.lit(universe_n)
    share = F.coalesce(F.try_divide(F.col("filled") * 100.0, total), F.lit(0.0))
    rebuilt = F.lit(None).cast("string")
    if K.REBUILT_AS:
        rebuilt = F.try_element_at(F.create_map(*[F.lit(x) for pair in K.REBUILT_AS.items() for x in pair]), F.col("column"))
    rules = [
        ("currency", F.endswith("column", F.lit(K.CURRENCY_SUFFIX)), F.lit("all values INR")),
        ("duplicate", F.col("base").isNotNull(), F.concat(
            F.lit("re-export of '"), "base", F.lit("'"), F.when(F.col("equal"), "").otherwise(" (values differ; base kept)"),
        )),
        ("empty", F.col("column").isin(list(K.ALWAYS_DROPPED)), F.lit("no populated values")),
        ("low_coverage", share < min_coverage_pct, F.concat(
            F.format_string("%.1f%% populated", F.bround(share, 1)),
            F.coalesce(F.concat(F.lit("; reconstructed as '"), rebuilt, F.lit("'")), F.lit("")),
        )),
    ]
    verdicts = [F.when(holds, F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))) for reason, holds, detail in rules]
    judged = column_facts(df, by).select(*by, "column", F.coalesce(*verdicts).alias("v")).where("v IS NOT NULL")
    return judged.select(*by, "column", "v.reason", "v.detail")


def drop_dead_columns(
    df: DataFrame, min_coverage_pct: float = K.DROP_BELOW_COVERAGE_PCT, universe_n: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The frame without its dead columns, and the reason ledger. A schema has to be known
    before a plan can be built, so the names of the dropped columns are read here."""
    ledger = dropped_columns(df, min_coverage_pct, universe_n)
    gone = {r[0] for r in ledger.select("column").collect()}
    return df.select(*[_c(c) for c in df.columns if c not in gone]), ledger


def currency_violations(df: DataFrame, currency: str = K.REQUIRED_CURRENCY) -> DataFrame:
    """Values other than the required currency, per currency column."""
    marked = [c for c in df.columns if c.endswith(K.CURRENCY_SUFFIX)]
    if not marked:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value")) for c in marked])
    return (
        df.select(F.inline(cells)).where(F.col("value") != currency)
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )


def key_violations(
    df: DataFrame, key: str = "isin", low: int | None = K.UNIVERSE_MIN, high: int | None = K.UNIVERSE_MAX,
) -> DataFrame:
    """Broken rules of the base frame: (rule, found). Keys are counted by groups, so the
    distinct keys never meet in one task."""
    per_key = df.groupBy(key).agg(F.count("*").alias("c"))
    facts = per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("c"))), F.lit(0)).alias("nulls"),
        F.count_if(F.col(key).isNotNull() & (F.col("c") > 1)).alias("twice"),
    )
    n = F.col("n")
    outside = F.lit(False)
    if low is not None:
        outside = outside | (n < low)
    if high is not None:
        outside = outside | (n > high)
    rules = F.array(
        F.struct(F.lit("row_count").alias("rule"), n.alias("found"), outside.alias("bad")),
        F.struct(F.lit("null_key").alias("rule"), F.col("nulls").alias("found"), (F.col("nulls") > 0).alias("bad")),
        F.struct(F.lit("duplicate_key").alias("rule"), F.col("twice").alias("found"), (F.col("twice") > 0).alias("bad")),
    )
    return facts.select(F.inline(rules)).where("bad").drop("bad")
