"""Readers for the raw exports and feeds, with the checks each input must pass."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.operators import clean, periods
from panelyard.operators.matching import keep_first
from panelyard.session import cut_lineage

ORDINAL = "__ordinal"


def _unique_headers(names: list[str]) -> list[str]:
    """A repeated header gets ``.1``, ``.2``, ... like spreadsheet exports number it."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def input_order() -> Column:
    """Position of a row in its files: file, block, and row within the block."""
    return F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")
    )


def read_csv(spark: SparkSession, path: str, schema: str | None = None, ordinal: bool = False) -> DataFrame:
    """CSV with a header row. Give a ``schema`` to spare the inference pass."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    if not schema:
        first = spark.read.text(path).limit(1).first()
        names = _unique_headers(next(csv.reader([first[0].lstrip("﻿")]))) if first else df.columns
        read_as = df.columns
        picked = [F.col(f"`{c}`").alias(n) for c, n in zip(read_as, names)]
    else:
        picked = [F.col(f"`{c}`") for c in df.columns]
    out = df.select(*picked, *([input_order().alias(ORDINAL)] if ordinal else []))
    return clean.nan_to_null(out)


MOST_HEADERS = 500  # different headers of one input


def read_csv_files(
    spark: SparkSession, path: str, types: dict[str, str] | None = None, ordinal: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files that each have a header of their own: columns may be in
    another order, or missing, from file to file. ``rows`` has every column that any file names,
    as text or as ``types`` says. ``rejects`` has file, line (from 1, the header), reason and
    record of every line that has not as many values as its header, or a value that is not of its
    type; such lines are in no row. Blank lines are skipped; a record is one line.

    A file's header is its first line, found by the path and offset of the block that it lies in.
    The driver gets the different headers; the header of each file is joined by path."""
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("record"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min_by("record", "id").alias("head"))
    in_file = W.partitionBy("file").orderBy("block")  # a row per block
    blocks = blocks.withColumns({"before": F.sum("n").over(in_file) - F.col("n"), "header": F.first("head").over(in_file)})
    blocks = cut_lineage(blocks.select("file", "block", "first", "before", "header"))
    headers = [r[0] for r in blocks.select("header").distinct().orderBy("header").limit(MOST_HEADERS + 1).collect()]
    _require(len(headers) <= MOST_HEADERS, f"more than {MOST_HEADERS} different headers")
    named = {h: _unique_headers(next(csv.reader([h]))) for h in headers if h.strip()}
    columns = list(dict.fromkeys(n for names in named.values() for n in names))
    kinds = {c: (types or {}).get(c, "string") for c in columns}

    # one row per block of a file, as in the listing that the driver holds
    placed = lines.join(F.broadcast(blocks), ["file", "block"])
    line = F.col("before") + F.col("id") - F.col("first") + 1
    placed = placed.select("file", "record", "id", "block", line.alias("line"), "header").where((F.col("line") > 1) & (F.trim("record") != ""))
    by_width: dict[int, list[str]] = {}
    for h, names in named.items():
        by_width.setdefault(len(names), []).append(h)
    options = {"columnNameOfCorruptRecord": "__bad", "escape": '"', "mode": "PERMISSIVE"}
    parsed = F.lit(None).cast("array<string>")
    for width, of in by_width.items():
        cells = [f"v{i}" for i in range(width)]
        read = F.from_csv("record", ", ".join(f"{c} string" for c in [*cells, "__bad"]), options)
        values = F.when(read["__bad"].isNull(), F.array(*[read[c] for c in cells]))
        parsed = F.when(F.col("header").isin(of), values).otherwise(parsed)
    at = F.create_map(*[x for h, names in named.items() for x in (F.lit(h), F.create_map(*[y for i, n in enumerate(names) for y in (F.lit(n), F.lit(i))]))]) if named else None
    found = placed.withColumn("__values", parsed)
    if named:
        found = found.withColumn("__at", F.try_element_at(at, F.col("header")))
    text = {c: F.get("__values", F.try_element_at("__at", F.lit(c))) for c in columns}
    typed = {c: text[c] if kinds[c] == "string" else F.trim(text[c]).try_cast(kinds[c]) for c in columns}
    width_of = F.size("__at") if named else F.lit(0)
    reason = F.coalesce(
        F.when(F.col("__values").isNull(), F.concat(F.lit("not the "), width_of.cast("string"), F.lit(" values of the header"))),
        *[F.when(text[c].isNotNull() & (F.trim(text[c]) != "") & typed[c].isNull(), F.lit(f"{c}: not a {kinds[c]}")) for c in columns if kinds[c] != "string"],
    )
    found = found.withColumn("__reason", reason)
    order = [F.struct("file", "block", "id").alias(ORDINAL)] if ordinal else []
    rows = found.where("__reason IS NULL").select(*[typed[c].alias(c) for c in columns], *order)
    return rows, found.where("__reason IS NOT NULL").select("file", "line", F.col("__reason").alias("reason"), "record")


def read_json_payload(
    spark: SparkSession, path: str, schema: str | None = None, ordinal: bool = False, lines: bool = False,
) -> DataFrame:
    """JSON records with headers in trimmed upper case. A file that is one array is one
    task; with ``lines`` (a record per line) files are split."""
    reader = spark.read.option("multiLine", not lines)
    df = (reader.schema(schema) if schema else reader).json(path)
    picked = [F.col(f"`{c}`").alias(c.strip().upper()) for c in df.columns]
    return df.select(*picked, *([input_order().alias(ORDINAL)] if ordinal else []))


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def load_base(
    df: DataFrame, low: int | None = K.UNIVERSE_MIN, high: int | None = K.UNIVERSE_MAX, check: bool = True,
) -> DataFrame:
    """The frame that defines the universe. A broken rule stops the load."""
    _require("ISIN" in df.columns, "base: ISIN column missing")
    if check:
        bad = clean.key_violations(df, "ISIN", low, high).collect()  # at most three rows
        _require(not bad, f"base: {[tuple(r) for r in bad]}")
        other = clean.currency_violations(df).limit(10).collect()
        _require(not other, f"base: unexpected currency values {[tuple(r) for r in other]}")
    return df.withColumnRenamed("ISIN", "isin")


def load_secondary(df: DataFrame, order: str = ORDINAL) -> DataFrame:
    """The wider second export, first row per key."""
    _require("ISIN Code" in df.columns, "secondary: ISIN Code column missing")
    return keep_first(df.withColumnRenamed("ISIN Code", "isin"), "isin", order).drop(order)


def load_periods(df: DataFrame, freq: str, order: str = ORDINAL, periods_n: int | None = None) -> DataFrame:
    """A wide period feed with every period column present, first row per key."""
    _require("ISIN" in df.columns, "period feed: ISIN column missing")
    names = periods.period_names(freq, periods_n)
    missing = [c for c in names if c not in df.columns]
    _require(not missing, f"period feed: missing period columns {missing[:5]}")
    extra = ["TTM"] if freq == "FY" else []
    kept = df.select(F.col("ISIN").alias("isin"), *extra, *names, order)
    return keep_first(kept, "isin", order).drop(order)


def validate_payload(df: DataFrame, label: str, freq: str) -> None:
    """Reject an empty payload, one without keys, or one without any period."""
    names = {c.strip().upper() for c in df.columns}
    _require("ISIN" in names, f"{label}: no ISIN column; got {sorted(names)[:8]}")
    present = any(c in names for c in periods.period_names(freq))
    _require(present, f"{label}: no {periods.PREFIX[freq]} period columns in payload")
    _require(not df.isEmpty(), f"{label}: empty payload")


def prepare_payload(df: DataFrame, order: str = ORDINAL) -> DataFrame:
    """Trimmed keys, numeric periods, all quarters present, first row per key."""
    name = next((c for c in ("ISIN", "isin") if c in df.columns), None)
    _require(name is not None, f"payload has no ISIN column; got {df.columns[:10]}")
    out = df.withColumnRenamed(name, "isin").withColumn("isin", F.trim(F.col("isin").cast("string")))
    out = periods.as_numbers(periods.pad_periods(out.where(F.length("isin") > 0), "Q"))
    return keep_first(out, "isin", order).drop(order)


def feed_status(fetched_at: Column, as_of: Column) -> list[Column]:
    from panelyard.functions.exprs import feed_age_hours, feed_is_stale

    return [
        fetched_at.alias("fetched_at"), feed_age_hours(fetched_at, as_of).alias("age_hours"),
        feed_is_stale(fetched_at, as_of).alias("stale"),
    ]
