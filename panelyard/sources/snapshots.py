"""Dated snapshots, one Parquet table per kind.

Kinds of a store: ``companies``, ``profit_quarterly``, ``profit_annual``, ``provenance``,
``ledger``, ``checks`` and the raw inputs under ``archive/<source>``. What counts of them is
resolved through the store's manifest. A table of its own, partitioned by ``snapshot_date`` and
without a manifest, is read as it lies.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard import constants as K
from panelyard.sources import manifest as M
from panelyard.sources import tables
from panelyard.sources.manifest import DATE, SnapshotError

TABLES = ["companies", "profit_quarterly", "profit_annual"]
PROVENANCE = (
    "source string, filename string, content_hash string, content_rows bigint, "
    "from_snapshot date, carried_forward boolean, built_at timestamp, universe bigint, columns int"
)


KINDS = [*TABLES, "provenance", "ledger", "checks", "rejected", *[f"archive/{s}" for s in K.SOURCE_NAMES]]


# ------------------------------------------------------------------ reading
def _published(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """Store and kind, if ``path`` is a table of a store with a manifest."""
    for kind in KINDS:
        if path.endswith(f"/{kind}") and M.exists(spark, path[: -len(kind) - 1]):
            return path[: -len(kind) - 1], kind
    return None


def read_table(spark: SparkSession, path: str, dates: Sequence[str] | None = None) -> DataFrame:
    """All snapshots, or those of some dates, united by column name and widened. Without a
    manifest a date's columns are taken from one of its files, and a folder whose suffix is no
    date is left out."""
    found = _published(spark, path)
    if found:
        return M.read(spark, *found, dates=dates)
    held = [d for d in list_snapshots(spark, path) if dates is None or d in dates]
    if not held:
        raise SnapshotError(f"no snapshot at {path}")
    schemas = {d: spark.read.parquet(f"{path}/{DATE}={d}").schema for d in held}
    target = M.united(schemas.values())
    alike: dict[str, list[str]] = {}
    for d in held:
        alike.setdefault(schemas[d].json(), []).append(d)
    parts = []
    for days in alike.values():
        own = {f.name: f.dataType for f in schemas[days[0]].fields}
        schema = T.StructType([*[T.StructField(f.name, own.get(f.name, f.dataType)) for f in target.fields], T.StructField(DATE, T.DateType())])
        part = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{DATE}={d}" for d in days])
        parts.append(part.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target.fields], DATE))
    return union_by_name(parts)


def list_snapshots(spark: SparkSession, path: str) -> list[str]:
    """Dates that have data, oldest first, from the manifest or else the folder names."""
    published = _published(spark, path)
    if published:
        return M.days(spark, *published)
    found = []
    for folder in tables.subfolders(spark, path):
        name, _, value = folder.partition("=")
        if name == DATE and _is_date(value) and tables.folder_bytes(spark, f"{path}/{folder}") > 0:
            found.append(value)
    return sorted(found)


def _is_date(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text)) and bool(Date.fromisoformat(text))
    except ValueError:
        return False


def snapshot_dates(history: DataFrame) -> DataFrame:
    return history.select(DATE).distinct().orderBy(DATE)


def as_of(history: DataFrame, date: str) -> DataFrame:
    """The table at one past date; an unknown date is an error, not an empty answer."""
    if not _is_date(date):
        raise SnapshotError(f"'{date}' is not a date in YYYY-MM-DD form")
    found = history.where(F.col(DATE) == F.lit(date).cast("date"))
    if found.isEmpty():
        raise SnapshotError(f"no snapshot for {date}")
    return found


def latest(history: DataFrame, newest: str | None = None) -> DataFrame:
    """The newest snapshot. The date is known before the plan is made (from the folder
    names by ``list_snapshots``, or else by a first small job), so that the scan is
    pruned to one partition instead of joined with a maximum."""
    found = newest or history.agg(F.max(DATE)).first()[0]
    return history.where(F.col(DATE) == F.lit(found).cast("date"))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ writing
def write_partition(df: DataFrame, path: str, date: str | None = None) -> None:
    """Overwrite only the partitions present in ``df``. Rebalancing evens out the files
    and splits a snapshot that outgrows the rest."""
    dated = df if date is None else df.withColumn(DATE, F.lit(date).cast("date"))
    (
        dated.hint("rebalance", DATE).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(path)
    )


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and a hash of the content that does not depend on row order."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns) if not c.startswith("__")]
    return df.agg(
        F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content_hash"),
        F.count("*").alias("content_rows"),
    )


# ------------------------------------------------------------------ inputs
def classify(names: Sequence[str]) -> dict[str, str]:
    """Source of every supplied file, by name pattern; order does not matter."""
    out: dict[str, str] = {}
    strangers = []
    for name in names:
        base = re.split(r"[/\\]", name)[-1]
        hit = next(
            (
                s for s, patterns in K.SOURCE_FILE_PATTERNS.items()
                if s not in out and any(fnmatch.fnmatch(base, p) for p in patterns)
            ),
            None,
        )
        if hit:
            out[hit] = name
        else:
            strangers.append(base)
    if strangers:
        raise SnapshotError(f"could not identify: {', '.join(strangers)}")
    return out


def resolve_date(names: dict[str, str], explicit: str | None, today: str) -> str:
    """Explicit date, or the date in the name of a daily file, or today."""
    if explicit:
        if not _is_date(explicit):
            raise SnapshotError(f"'{explicit}' is not a date in YYYY-MM-DD form")
        return explicit
    for source in K.DAILY_SOURCES:
        found = re.search(r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})", re.split(r"[/\\]", names.get(source, ""))[-1])
        if found and _is_date("-".join(found.groups())):
            return "-".join(found.groups())
    return today


def read_provenance(spark: SparkSession, store: str) -> DataFrame:
    if not M.days(spark, store, "provenance"):
        return spark.createDataFrame([], f"{PROVENANCE}, {DATE} date")
    return M.read(spark, store, "provenance")


def carried_sources(provenance: DataFrame, missing: Sequence[str], before: str) -> dict[str, dict]:
    """Newest earlier snapshot that supplied each missing source. One row per source."""
    from panelyard.operators.matching import latest_supplied

    rows = latest_supplied(provenance, before, missing).collect()
    return {
        r["source"]: {"from_snapshot": str(r["from_snapshot"]), "filename": r["filename"], "carried_forward": True}
        for r in rows
    }


def resolve_sources(
    provenance: DataFrame, supplied: dict[str, str], date: str, feed: dict[str, str] | None = None,
) -> dict[str, dict]:
    """Supplied files first, then the last fetched feed, then carry-forward."""
    out = {s: {"filename": n, "from_snapshot": None, "carried_forward": False} for s, n in supplied.items()}
    for source, name in (feed or {}).items():
        out.setdefault(source, {"filename": name, "from_snapshot": None, "carried_forward": False})
    missing = [s for s in K.SOURCE_NAMES if s not in out]
    if missing:
        out.update(carried_sources(provenance, missing, date))
    absent = [s for s in K.SOURCE_NAMES if s not in out]
    if absent:
        raise SnapshotError(f"not supplied and held by no earlier snapshot: {absent}")
    return out


def notes(resolved: dict[str, dict], feed_stale: bool = False, has_feed: bool = True) -> list[str]:
    said = []
    old = [s for s in K.DAILY_SOURCES if resolved[s]["carried_forward"]]
    if old:
        said.append(f"carrying forward daily source(s): {', '.join(old)}")
    if feed_stale:
        said.append("the period feed was not fetched today")
    if not has_feed and all(resolved[s]["carried_forward"] for s in K.PERIODIC_SOURCES):
        said.append("no period feed: carried forward from an earlier snapshot")
    return said


def duplicate_of(provenance: DataFrame, hashes: DataFrame) -> DataFrame:
    """Snapshots whose daily inputs all equal the given ones (``hashes``: source,
    content_hash, content_rows), newest first."""
    fresh = hashes.where(F.col("source").isin(K.DAILY_SOURCES))
    same = fresh.join(
        provenance.select(DATE, "source", "content_hash", "content_rows"),
        ["source", "content_hash", "content_rows"],
    )
    needed = fresh.agg(F.count("*")).scalar()
    return (
        same.groupBy(DATE).agg(F.countDistinct("source").alias("hits"))
        .where(F.col("hits") == needed).select(DATE).orderBy(F.col(DATE).desc())
    )


def source_hashes(frames: dict[str, DataFrame]) -> DataFrame:
    parts = [content_hash(df).withColumn("source", F.lit(s)) for s, df in frames.items()]
    return union_by_name(parts)


# ------------------------------------------------------------------ upkeep
def describe(provenance: DataFrame) -> DataFrame:
    """One row per snapshot: size, columns, build time, carried sources."""
    carried = F.array_sort(F.collect_set(F.when(F.col("carried_forward"), F.col("source"))))
    return provenance.groupBy(DATE).agg(
        F.max("built_at").alias("built_at"), F.max("universe").alias("universe"),
        F.max("columns").alias("columns"), carried.alias("carried_forward"),
        F.count("*").alias("sources"),
    ).orderBy(DATE)


def sizes(spark: SparkSession, store: str) -> DataFrame:
    held = [e for e in M.load(spark, store)[1] if e.kind == "companies"]
    rows = [(e.snapshot_date, tables.folder_bytes(spark, f"{store}/{e.folder}") / 1024 if e.folder else 0.0) for e in held]
    return spark.createDataFrame(rows, f"{DATE} string, size_kb double").withColumn(DATE, F.col(DATE).cast("date"))


def reachable_archives(provenance: DataFrame, dates: Sequence[str]) -> set[tuple[str, str]]:
    """(source, day) of all archives that the given days are built from: what their provenance
    names, what the provenance of those days names in turn, and so on. There is one provenance
    row per source and day."""
    origin = {(r["source"], str(r[DATE])): str(r["from_snapshot"]) for r in provenance.select("source", DATE, "from_snapshot").collect()}
    wanted = {(source, day) for source, day in origin if day in dates}
    found: set[tuple[str, str]] = set()
    while wanted:
        named = {(source, origin[source, day]) for source, day in wanted if (source, day) in origin}
        wanted = named - found
        found |= named
    return found


def delete(spark: SparkSession, store: str, date: str, keep_archive: bool = True) -> list[str]:
    """Take one snapshot out of the manifest, but never the only one. Without ``keep_archive`` its
    archived inputs go as well, unless a day that remains was built from them. Folders stay until
    ``manifest.remove``. Returns the dates that remain."""
    seen, entries = M.load(spark, store)
    held = sorted(e.snapshot_date for e in entries if e.kind == "companies")
    if date not in held:
        raise SnapshotError(f"no snapshot for {date}")
    if len(held) == 1:
        raise SnapshotError("refusing to delete the only snapshot")
    remaining = [d for d in held if d != date]
    gone = {e.key for e in entries if e.snapshot_date == date and not e.kind.startswith("archive/")}
    if not keep_archive:
        needed = reachable_archives(read_provenance(spark, store), remaining)
        # archives of days deleted earlier that were kept for this one go with it
        gone |= {e.key for e in entries if e.kind.startswith("archive/") and e.snapshot_date not in remaining and (e.kind.removeprefix("archive/"), e.snapshot_date) not in needed}
    M.publish(spark, store, removed=gone, seen=seen, alone=True)
    return remaining


def archive_kind(source: str) -> str:
    return f"archive/{source}"


def provenance_rows(
    spark: SparkSession, resolved: dict[str, dict], hashes: DataFrame, date: str, built_at: Column,
    universe: int, columns: int,
) -> DataFrame:
    rows = [
        # what the day itself supplied before it was replaced is not carried: it stays its own
        (s, info["filename"], info["from_snapshot"] or date, bool(info["carried_forward"]) and info["from_snapshot"] != date)
        for s, info in resolved.items()
    ]
    base = spark.createDataFrame(rows, "source string, filename string, from_snapshot string, carried_forward boolean")
    return base.join(hashes, "source", "left").select(
        "source", "filename", "content_hash", "content_rows", F.col("from_snapshot").cast("date").alias("from_snapshot"),
        "carried_forward", built_at.cast("timestamp").alias("built_at"),
        F.lit(universe).cast("bigint").alias("universe"), F.lit(columns).cast("int").alias("columns"),
    )
