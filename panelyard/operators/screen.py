"""Validated filters, sorting, paging, masking, search and export of an entity frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K

Filter = tuple  # (field, op) or (field, op, value)

COMPARISONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
OPERATORS = [*COMPARISONS, "between", "in", "not_in", "contains", "is_null", "not_null"]
MAX_PAGE = 750


def check_fields(df: DataFrame, fields: Sequence[str]) -> None:
    unknown = [f for f in fields if f not in df.columns]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")


def numeric_fields(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("unit").isin(K.NUMERIC_UNITS)).select("name")


def screenable_fields(catalog: DataFrame) -> DataFrame:
    return catalog.where("screenable").select("name")


def check_numeric(df: DataFrame, field: str) -> None:
    check_fields(df, [field])
    kinds = dict(df.dtypes)
    if not kinds[field].startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")):
        raise ValueError(f"'{field}' is not a numeric field")


def predicate(df: DataFrame, one: Filter) -> Column:
    """One filter as a Column. SQL null logic holds: ``ne`` and ``not_in`` drop nulls."""
    field, op, *rest = one
    value: Any = rest[0] if rest else None
    check_fields(df, [field])
    if op not in OPERATORS:
        raise ValueError(f"unknown op '{op}'")
    col = F.col(field)
    many = isinstance(value, (list, tuple))
    if op == "is_null":
        return col.isNull()
    if op == "not_null":
        return col.isNotNull()
    if op in ("in", "not_in"):
        if not many or not value:
            raise ValueError(f"op '{op}' needs a non-empty list")
        inside = col.isin(list(value))
        return ~inside if op == "not_in" else inside
    if op == "between":
        if not many or len(value) != 2:
            raise ValueError("op 'between' needs exactly two values")
        return col.between(value[0], value[1])
    if many or value is None:
        raise ValueError(f"op '{op}' needs a single value")
    if op == "contains":
        return F.lower(col.cast("string")).like(f"%{_literal_backslash(str(value).lower())}%")
    return COMPARISONS[op](col, F.lit(value))


def _literal_backslash(pattern: str) -> str:
    """A backslash of a search text stands for itself; % and _ stay wildcards."""
    return pattern.replace("\\", "\\\\")


def where_all(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    parts = [predicate(df, f) for f in filters]
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


def order_by(df: DataFrame, sort: Sequence[tuple[str, str]] = (), tiebreak: str | None = None) -> DataFrame:
    """Sort keys with nulls last in both directions; size descending by default."""
    check_fields(df, [f for f, _ in sort])
    keys = []
    for field, direction in sort or [("market_cap", "desc")]:
        if direction not in ("asc", "desc"):
            raise ValueError(f"unknown direction '{direction}'")
        c = F.col(field)
        keys.append(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last())
    if tiebreak:
        keys.append(F.col(tiebreak).asc())
    return df.orderBy(*keys)


def project(df: DataFrame, columns: Sequence[str] | None = None, sector: str = "sector") -> DataFrame:
    """Chosen columns (or the default list) with the sector always present."""
    wanted = list(columns) if columns else K.DEFAULT_COLUMNS
    check_fields(df, wanted)
    return df.select(*wanted, *([] if sector in wanted else [sector]))


def mask_sector(
    df: DataFrame, masked: Sequence[str] | None = None, sector_value: str = K.MASKED_SECTOR,
    sector: str = "sector",
) -> DataFrame:
    """Null the metrics that mean nothing in one sector and list which were nulled."""
    hit = [c for c in (K.MASKED_METRICS if masked is None else masked) if c in df.columns]
    inside = F.coalesce(F.col(sector) == sector_value, F.lit(False))
    listed = F.array_compact(
        F.array(*[F.when(inside & F.col(c).isNotNull(), F.lit(c)) for c in hit])
    ) if hit else F.array().cast("array<string>")
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.when(~inside, F.col(c)).cast(kinds[c]).alias(c) if c in hit else F.col(c)
            for c in df.columns
        ],
        listed.alias("_masked_fields"),
    )


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def screen(
    df: DataFrame,
    filters: Sequence[Filter] = (),
    sort: Sequence[tuple[str, str]] = (),
    columns: Sequence[str] | None = None,
    limit: int = 100,
    offset: int = 0,
    mask: bool = True,
    masked: Sequence[str] | None = None,
    sector_value: str = K.MASKED_SECTOR,
    tiebreak: str | None = "symbol",
) -> DataFrame:
    """Filter, sort, page, and only then mask: a masked row can still match or rank."""
    found = page(order_by(where_all(df, filters), sort, tiebreak), limit, offset)
    found = project(found, columns)
    return mask_sector(found, masked, sector_value) if mask else found


def total(df: DataFrame, filters: Sequence[Filter] = ()) -> DataFrame:
    return where_all(df, filters).agg(F.count("*").alias("n"))


def health(entities: DataFrame, column_count: int | None = None) -> DataFrame:
    return entities.agg(
        F.count("*").alias("companies"),
        F.lit(column_count if column_count is not None else len(entities.columns)).cast("bigint").alias("columns"),
    )


def named_screen(df: DataFrame, name: str) -> DataFrame:
    return where_all(df, K.SCREENS[name])


def named_view(df: DataFrame, name: str, identity: Sequence[str] = ("symbol", "name", "sector", "cap_tier")) -> DataFrame:
    """Identity columns plus those columns of a named view that the frame has."""
    return df.select(*identity, *[c for c in K.VIEWS[name] if c in df.columns])


def search(df: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """Type-ahead on symbol and name: exact, then prefix, then anywhere; larger first."""
    if not q:
        raise ValueError("empty query")
    symbol, name = F.lower("symbol"), F.lower("name")
    exact, term = q.lower(), _literal_backslash(q.lower())
    rank = F.when(symbol == exact, 0).when(symbol.like(f"{term}%"), 1).otherwise(2)
    return (
        df.where(symbol.like(f"%{term}%") | name.like(f"%{term}%"))
        .orderBy(rank, F.col("market_cap").desc_nulls_last(), F.col("symbol"))
        .limit(limit)
        .select("symbol", "name", "sector", "cap_tier", "market_cap")
    )


def prefix_search(df: DataFrame, q: str = "", limit: int = 200, column: str = "symbol") -> DataFrame:
    return df.where(F.col(column).ilike(f"{_literal_backslash(q)}%")).orderBy(column).limit(limit)


def by_symbol(df: DataFrame, symbol: str) -> DataFrame:
    return df.where(F.upper("symbol") == symbol.upper())


def movers(df: DataFrame, field: str = "perf_1y_pct", n: int = 10, tier: str | None = None) -> DataFrame:
    """Top and bottom ``n`` on a numeric field, marked by ``side``."""
    check_numeric(df, field)
    rows = df.where(F.col(field).isNotNull())
    if tier:
        rows = rows.where(F.col("cap_tier") == tier)
    rows = rows.select(*dict.fromkeys(["symbol", "name", "sector", "cap_tier", "market_cap", field]))
    top = rows.orderBy(F.col(field).desc(), "symbol").limit(n).withColumn("side", F.lit("top"))
    bottom = rows.orderBy(F.col(field).asc(), "symbol").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def export_frame(df: DataFrame, specs: Sequence[dict[str, str]]) -> DataFrame:
    """Chosen columns in order, under their labels, as they belong in a file: amounts in
    crore, booleans Yes/No, dates to ten characters, masked cells ``n/a``.

    ``specs`` entries: name, label, unit, fmt.
    """
    masked = F.col("_masked_fields") if "_masked_fields" in df.columns else F.array().cast("array<string>")
    kinds = dict(df.dtypes)
    out = []
    for spec in specs:
        name, unit, fmt = spec["name"], spec.get("unit"), spec.get("fmt")
        label = spec.get("label") or name
        c = F.col(name)
        if unit == "bool" or kinds[name] == "boolean":
            cell = F.when(c, "Yes").when(~c, "No")
        elif unit == "date":
            cell = F.substring(c.cast("string"), 1, 10)
        elif fmt == "cr":
            label = f"{label} (₹ Cr)"
            cell = F.bround(F.try_divide(c.cast("double"), F.lit(1e7)), 2).cast("string")
        else:
            cell = F.nullif(c.cast("string"), F.lit(""))
        out.append(F.when(F.array_contains(masked, name), "n/a").otherwise(cell).alias(label))
    return df.select(*out)
