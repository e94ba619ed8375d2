"""Entity card and comparison of a few entities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.screen import by_symbol, mask_sector

NOT_METRICS = ("idx_", "is_", "pct_rank_", "_")
META = ["segment", "group", "label", "unit", "fmt", "polarity", "provenance"]


def _long(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return df.select(*ids, F.inline(cells))


def card(df: DataFrame, catalog: DataFrame, symbol: str, mask: bool = True, **masking) -> DataFrame:
    """One entity as (name, value) rows with their catalog entry. Values are text, for
    the columns differ in type."""
    row = by_symbol(df, symbol)
    row = mask_sector(row, **masking) if mask else row
    columns = [c for c in row.columns if not c.startswith(("idx_", "pct_rank_", "_"))]
    meta = catalog.select("name", *[c for c in META if c in catalog.columns])
    return _long(row, [], columns).join(meta, "name", "left").withColumn(
        "segment", F.coalesce("segment", F.lit("Overview"))
    )


def card_ranks(df: DataFrame, symbol: str, scopes: Sequence[str] = ("sector", "tier")) -> DataFrame:
    """The entity's percentile ranks: one row per metric, one column per scope."""
    ranks = [c for c in df.columns if c.startswith("pct_rank_")]
    endings = {f"_in_{s}": s for s in scopes}
    found: dict[str, dict[str, str]] = {}
    for column in ranks:
        base, scope = column.removeprefix("pct_rank_"), "universe"
        for ending, name in endings.items():
            if base.endswith(ending):
                base, scope = base.removesuffix(ending), name
        found.setdefault(base, {})[scope] = column
    cells = F.array(*[
        F.struct(
            F.lit(metric).alias("metric"),
            *[
                (F.col(by[s]) if s in by else F.lit(None).cast("double")).alias(s)
                for s in ("universe", *scopes)
            ],
        )
        for metric, by in found.items()
    ])
    return by_symbol(df, symbol).select(F.inline(cells))


def card_memberships(df: DataFrame, symbol: str) -> DataFrame:
    """Tags of the entity: its tag array where the frame keeps one, else its flags."""
    row = by_symbol(df, symbol)
    if "tags" in df.columns:
        return row.select(F.explode("tags").alias("tag"))
    flags = [c for c in df.columns if c.startswith("idx_")]
    held = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in flags]))
    return row.select(F.explode(held).alias("tag"))


def card_masked(df: DataFrame, symbol: str, **masking) -> DataFrame:
    return mask_sector(by_symbol(df, symbol), **masking).select(F.explode("_masked_fields").alias("field"))


def compare(
    df: DataFrame, catalog: DataFrame, symbols: Sequence[str], segments: Sequence[str] | None = None,
    metrics: Sequence[str] | None = None, **masking,
) -> DataFrame:
    """Two to six entities as metric rows: values in the requested order, the best by
    polarity (first on ties), and the spread ``(max - min) / max(abs)``.

    The entities are few by contract, so every metric is one conditional aggregate and
    the whole comparison is a single row before it is turned into rows.
    """
    if not 2 <= len(symbols) <= 6:
        raise ValueError("compare takes two to six symbols")
    wanted = list(dict.fromkeys(s.upper() for s in symbols))
    rows = mask_sector(df.where(F.upper("symbol").isin(wanted)), **masking)
    kinds = dict(df.dtypes)
    names = [
        c for c in (metrics or df.columns)
        if not c.startswith(NOT_METRICS)
        and kinds[c].startswith(("double", "float", "int", "bigint", "smallint", "decimal", "boolean"))
    ]
    at = reduce(lambda acc, kv: acc.when(F.upper("symbol") == kv[1], kv[0]), enumerate(wanted), F.when(F.lit(False), -1))
    placed = rows.withColumn("__at", at)
    one = placed.agg(*[
        F.max(F.when(F.col("__at") == i, F.col(c).cast("double"))).alias(f"v{k}_{i}")
        for k, c in enumerate(names) for i in range(len(wanted))
    ], *[F.count_if(F.col("__at") == i).alias(f"f{i}") for i in range(len(wanted))])
    cells = F.array(*[
        F.struct(F.lit(c).alias("name"), F.array(*[F.col(f"v{k}_{i}") for i in range(len(wanted))]).alias("all_values"))
        for k, c in enumerate(names)
    ])
    found = F.array(*[F.col(f"f{i}") > 0 for i in range(len(wanted))])
    long = one.select(F.inline(cells), found.alias("found"))
    # A symbol that is not held has no place among the values.
    held = F.filter(F.arrays_zip("all_values", "found"), lambda z: z["found"])
    long = long.withColumn("values", F.transform(held, lambda z: z["all_values"]))
    meta = catalog.select("name", *[c for c in META if c in catalog.columns])
    out = long.join(meta, "name").where(
        F.exists("values", lambda v: v.isNotNull()) & ~F.col("unit").isin("text", "date")
    )
    if segments:
        out = out.where(F.col("segment").isin(list(segments)))
    numeric = ~F.col("name").isin([c for c in names if kinds[c] == "boolean"])
    return out.select(
        "name", "segment", "unit", "polarity", "values",
        _best("values", F.col("polarity")).alias("best_index"),
        F.when(numeric, _spread("values")).alias("spread"),
    )


def _best(values: str, polarity: Column) -> Column:
    """Index of the best value, the first on ties; none for a neutral metric."""
    v = F.col(values)
    top = F.when(polarity == "higher_better", F.array_max(v)).otherwise(F.array_min(v))
    return F.when(polarity != "neutral", (F.array_position(v, top) - 1)).cast("int")


def _spread(values: str) -> Column:
    present = F.filter(F.col(values), lambda v: v.isNotNull())
    lo, hi = F.array_min(present), F.array_max(present)
    base = F.greatest(F.abs(lo), F.abs(hi))
    return F.when(F.size(present) >= 2, F.try_divide(hi - lo, F.nullif(base, F.lit(0.0))))


def spread_ranking(compared: DataFrame, n: int = 30) -> DataFrame:
    """Metrics on which the compared entities differ most."""
    return compared.where("spread IS NOT NULL").orderBy(F.col("spread").desc(), "name").limit(n)


def missing_symbols(df: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Requested symbols that are not held."""
    asked = df.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    held = df.where(F.upper("symbol").isin([s.upper() for s in symbols])).select(F.upper("symbol").alias("__s"))
    return asked.join(held, F.upper("symbol") == F.col("__s"), "left_anti")
