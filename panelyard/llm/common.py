"""Helpers shared by the training-data operators: stored intermediates, checked broadcasts,
connected components and row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only after its rows were counted and its files measured, and
# found to be at most this; beyond it the join shuffles.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 8 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NULL_ID = -(1 << 63)

_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)  # the folder of the intermediates of stored_alone


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share. One of our
    own is set only where none is configured (local sessions, tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelyard-llm-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    parent = _SCOPE.get() or f"{shared_folder(spark).rstrip('/')}/llm"
    return f"{parent}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes one of our own intermediates."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends here, so a
    lost executor costs a re-read, and later joins know the true size."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, stored; all intermediates that were stored to make it go
    once it is written."""
    path, scope = new_folder(spark, name), new_folder(spark, f"{name}-from")
    outer = _SCOPE.set(scope)
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _SCOPE.reset(outer)
        remove_folder(spark, scope)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table has at most ``rows`` rows and its files BROADCAST_BYTES bytes."""
    files = df.groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("b"))
    n, size = files.agg(F.sum("n"), F.sum("b")).first()
    return n is None or (n <= rows and size <= BROADCAST_BYTES)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if is_small(df, rows) else df


def row_key(id_column: str, text_column: str) -> list[Column]:
    """Two longs that tell rows apart: the id (a null has its own value) and a hash of the
    text. Equal rows share a key and get equal results; rows that repeat an id with another
    text stay apart."""
    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("_i"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("_h"),
    ]


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, all else untouched. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, UPPER, UPPER.lower())
    )


def small_batches(spark: SparkSession, rows: int = 2000, mib: float = 2) -> None:
    """Bounds the Arrow batches handed to Python by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(int(mib * (1 << 20))))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and row offsets; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def batches_of(batches: Iterable[pa.RecordBatch], byte_limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined up to ``byte_limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= byte_limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b: longs), component being the smallest
    node that can be reached. Alternates large-star and small-star steps until only stars are
    left; every round is stored, so the plan stays short. A hot node is met by partial
    aggregates and by skew-splitting joins only. Nodes without an edge are not listed."""
    links = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )

    def only_stars(df: DataFrame) -> bool:
        """No node has two smaller neighbours, or a smaller and a larger one."""
        ends = df.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
        ends = ends.union(df.select("v", F.lit(0), F.lit(1)))
        degrees = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        return degrees.where("down > 1 or (down = 1 and up = 1)").isEmpty()

    for _ in range(rounds):
        if only_stars(links):
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        links = stored(small.where("u <> v").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined_components(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) after ``edges`` (a, b; stored) are added to ``groups`` (node,
    component; stored). Only links between different components are followed."""
    if edges.isEmpty():
        return groups
    known = checked_broadcast(groups)
    ends = edges
    for side in ("a", "b"):
        placed = known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))
        ends = ends.join(placed, side, "left").withColumn(f"{side}_component", F.coalesce(f"{side}_component", side))
    merged = stored(components(ends.select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))), "merged")
    moved = checked_broadcast(merged.select(F.col("node").alias("component"), F.col("component").alias("to")))
    kept = groups.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(kept.union(merged).distinct(), "groups")
