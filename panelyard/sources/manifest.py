"""What a dated store has published.

Data folders are written once and never changed: ``<store>/<kind>/version=<id>/snapshot_date=<day>``.
A manifest, ``<store>/_manifest/m<number>.json``, names for every kind and day the folder that
counts, with its rows, content hash and columns. All tables of a day (or of many days) change
together when the next manifest is moved into place by one rename; until then, and after a crash
anywhere before it, readers resolve everything through the manifest before.

A manifest has one line per kind and day, so it is read on the driver. The columns of each day
come from it and not from file footers; days with other columns are united by name, and a column
whose type differs between days is widened. Only folders of wanted days are listed and opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.sources import tables

DATE = "snapshot_date"
FOLDER = "_manifest"
VERSION = "version"
ATTEMPTS = 20
STAGED_AT_ONCE = 4
ENTRIES = f"kind string, {DATE} string, folder string, rows bigint, content_hash string, schema string"
# Narrower numbers first; each may be read as any later one.
NUMBERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


class SnapshotError(RuntimeError):
    """A snapshot cannot be built, read or removed."""


@dataclass(frozen=True)
class Entry:
    """One kind on one day; the folder is empty where there are no rows."""

    kind: str
    snapshot_date: str
    folder: str
    rows: int
    content_hash: str
    schema: str

    @property
    def key(self) -> tuple[str, str]:
        return self.kind, self.snapshot_date

    @property
    def columns(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


# ------------------------------------------------------------------ manifests
def numbers(spark: SparkSession, store: str) -> list[int]:
    names = tables.file_names(spark, f"{store}/{FOLDER}")
    return sorted(int(n[1:10]) for n in names if len(n) == 15 and n.startswith("m") and n.endswith(".json") and n[1:10].isdigit())


def path_of(store: str, number: int) -> str:
    return f"{store}/{FOLDER}/m{number:09d}.json"


def exists(spark: SparkSession, store: str) -> bool:
    return bool(numbers(spark, store))


def load(spark: SparkSession, store: str, number: int | None = None) -> tuple[int, list[Entry]]:
    """Number and entries of the newest manifest, or of a given one; -1 and none before the first."""
    if number is None:
        held = numbers(spark, store)
        if not held:
            return -1, []
        number = held[-1]
    if number < 0:
        return -1, []
    lines = tables.read_text(spark, path_of(store, number)).splitlines()
    return number, [Entry(**json.loads(line)) for line in lines if line]


def entries(spark: SparkSession, store: str, number: int | None = None) -> DataFrame:
    """A manifest as a table, for queries."""
    _, held = load(spark, store, number)
    return spark.createDataFrame([tuple(asdict(e).values()) for e in held], ENTRIES).withColumn(DATE, F.col(DATE).cast("date"))


def publish(
    spark: SparkSession, store: str, added: Sequence[Entry] = (), removed: Iterable[tuple[str, str]] = (), seen: int | None = None,
    needed: Iterable[tuple[str, str]] = (), alone: bool = False,
) -> int:
    """Move to a manifest with ``added`` and without ``removed``. ``seen`` is the manifest that the
    work was based on: if another writer has since changed what is added, removed or ``needed``
    (with ``alone``: anything), nothing is published. A number that another writer took is left to
    it and the next is tried."""
    new, gone = {e.key: e for e in added}, set(removed)
    touched = {*new, *gone, *needed}
    for _ in range(ATTEMPTS):
        number, held = load(spark, store)
        now = {e.key: e for e in held}
        if seen is not None and seen != number:
            then = {e.key: e for e in load(spark, store, seen)[1]}
            clash = sorted(k for k in ({*now, *then} if alone else touched) if now.get(k) != then.get(k))
            if clash:
                raise SnapshotError(f"another writer changed {clash[0][0]} of {clash[0][1]} meanwhile; nothing was published")
        after = {k: e for k, e in {**now, **new}.items() if k not in gone or k in new}
        text = "\n".join(json.dumps(asdict(after[k])) for k in sorted(after))
        if tables.write_once(spark, path_of(store, number + 1), text):
            return number + 1
    raise SnapshotError("other writers took every new manifest")


# ------------------------------------------------------------------ writing
def stage(
    df: DataFrame, store: str, kind: str, dates: Sequence[str], columns: dict[str, Sequence[str]] | None = None,
) -> list[Entry]:
    """``df`` (with a date column) written to a folder of its own, one entry per date. Nothing
    shows until the entries are published. ``columns`` names the columns that each day has, where
    they differ; the others are null in its rows. Rows and hashes are those of the files."""
    spark = df.sparkSession
    data = [f for f in df.schema.fields if f.name != DATE]
    folder = f"{kind}/{VERSION}={uuid.uuid4().hex}"
    if columns is not None:
        has = {f.name: [d for d in dates if f.name in columns[d]] for f in data}
        df = df.select(DATE, *[
            F.col(f"`{c}`") if len(days) == len(dates) else F.when(F.col(DATE).cast("string").isin(days), F.col(f"`{c}`")).alias(c)
            for c, days in has.items()
        ])
    # evens out the files and splits a day that outgrows the rest
    df.hint("rebalance", DATE).write.partitionBy(DATE).parquet(f"{store}/{folder}")
    facts = {}
    if tables.subfolders(spark, f"{store}/{folder}"):
        written = spark.read.schema(T.StructType([*data, T.StructField(DATE, T.DateType())])).parquet(f"{store}/{folder}")
        names = sorted(f.name for f in data)
        found = written.groupBy(DATE).agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in names]).cast("decimal(38,0)")).cast("string"))
        facts = {str(r[0]): (r[1], r[2]) for r in found.collect()}
    strangers = sorted(set(facts) - set(dates))
    if strangers:
        raise SnapshotError(f"rows of {strangers[0]} in a write of {', '.join(dates)}")
    out = []
    for day in dates:
        kept = data if columns is None else [f for f in data if f.name in columns[day]]
        rows, digest = facts.get(day, (0, "0"))
        out.append(Entry(kind, day, f"{folder}/{DATE}={day}" if rows else "", rows, digest, T.StructType(kept).json()))
    return out


def stage_all(store: str, work: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> list[Entry]:
    """``stage`` for several (kind, frame, dates), a few of them at a time."""
    with ThreadPoolExecutor(STAGED_AT_ONCE) as pool:
        return [e for found in pool.map(lambda w: stage(w[1], store, w[0], w[2]), work) for e in found]


# ------------------------------------------------------------------ reading
def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both, or an error."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in NUMBERS and b in NUMBERS:
        widest = NUMBERS[max(NUMBERS.index(a), NUMBERS.index(b))]
        return T.DoubleType() if widest == T.FloatType() and T.LongType() in (a, b) else widest
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    dates = (T.DateType(), T.TimestampNTZType())
    if a in dates and b in dates:
        return T.TimestampNTZType()
    raise SnapshotError(f"no type holds both {a.simpleString()} and {b.simpleString()}")


def united(schemas: Iterable[T.StructType]) -> T.StructType:
    """All columns in the order in which they first occur, each wide enough for all."""
    types: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            types[f.name] = wider(types[f.name], f.dataType) if f.name in types else f.dataType
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def days(spark: SparkSession, store: str, kind: str) -> list[str]:
    return sorted(e.snapshot_date for e in load(spark, store)[1] if e.kind == kind)


def read(spark: SparkSession, store: str, kind: str, dates: Sequence[str] | None = None, number: int | None = None) -> DataFrame:
    """One kind on all or some days, with the day in ``snapshot_date``. Days whose columns have the
    same types share one scan; a column that a day lacks is null."""
    held = [e for e in load(spark, store, number)[1] if e.kind == kind and (dates is None or e.snapshot_date in dates)]
    if not held:
        raise SnapshotError(f"no {kind} is published" + (f" for {', '.join(dates)}" if dates else ""))
    return scan(spark, store, kind, held)


def scan(spark: SparkSession, store: str, kind: str, held: Sequence[Entry]) -> DataFrame:
    """The rows of some entries of one kind, published or only staged."""
    target = united(e.columns for e in held)
    wanted = {f.name: f.dataType for f in target.fields}
    alike: dict[tuple, list[Entry]] = {}
    for e in held:
        narrow = {f.name: f.dataType for f in e.columns.fields if f.dataType != wanted[f.name]}
        alike.setdefault(tuple(sorted((n, t.json()) for n, t in narrow.items())), []).append(e)
    parts = []
    for group in alike.values():
        own = {f.name: f.dataType for e in group for f in e.columns.fields}
        schema = T.StructType([
            *[T.StructField(f.name, own.get(f.name, f.dataType)) for f in target.fields], T.StructField(VERSION, T.StringType()), T.StructField(DATE, T.DateType()),
        ])
        folders = [f"{store}/{e.folder}" for e in group if e.folder]
        if folders:
            part = spark.read.schema(schema).option("basePath", f"{store}/{kind}").parquet(*folders)
            parts.append(part.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target.fields], DATE))
    out = parts[0] if parts else spark.createDataFrame([], T.StructType([*target.fields, T.StructField(DATE, T.DateType())]))
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


# ------------------------------------------------------------------ upkeep
def removable(spark: SparkSession, store: str, kinds: Sequence[str], keep: int = 2, min_age_hours: float = 24.0) -> DataFrame:
    """Folders below ``kinds`` that none of the newest ``keep`` manifests names: left by writers
    that crashed, replaced, or deleted. Younger folders may belong to a writer at work."""
    live = {e.folder for n in numbers(spark, store)[-max(keep, 1):] for e in load(spark, store, n)[1]}
    found = []
    for kind in kinds:
        for version in tables.subfolders(spark, f"{store}/{kind}"):
            for day in tables.subfolders(spark, f"{store}/{kind}/{version}"):
                folder = f"{kind}/{version}/{day}"
                age = tables.age_hours(spark, f"{store}/{folder}")
                if folder not in live and age >= min_age_hours:
                    found.append((kind, day.partition("=")[2], folder, tables.folder_bytes(spark, f"{store}/{folder}")))
    return spark.createDataFrame(found, f"kind string, {DATE} string, folder string, bytes bigint").withColumn(DATE, F.col(DATE).try_cast("date"))


def remove(spark: SparkSession, store: str, kinds: Sequence[str], keep: int = 2, min_age_hours: float = 24.0) -> list[str]:
    """Deletes what ``removable`` lists, and version folders that are empty then."""
    gone = [r["folder"] for r in removable(spark, store, kinds, keep, min_age_hours).collect()]
    for folder in gone:
        tables.delete_folder(spark, f"{store}/{folder}")
    for version in sorted({f.rpartition("/")[0] for f in gone}):
        if not tables.subfolders(spark, f"{store}/{version}"):
            tables.delete_folder(spark, f"{store}/{version}")
    return gone
