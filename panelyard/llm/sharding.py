"""Resharding by minimum-cost flow.

The files of a table are its blocks; a rule says in which old shard a file lies. From the
old shards' bytes and the new shards' capacities a minimum-cost flow (a byte that stays costs
nothing, a byte that moves costs one) gives the transfers that move the fewest bytes. A
shard's rows are laid out in file and row order; the part that stays comes first, then one
run per target. Only files that hold a row of another target are rewritten; the others stay
where they are and are named in the manifest.

Offsets are found top down - files, then stretches of rows within files that straddle a run's
end, then rows within stretches that do - so no window is longer than one file's stretches.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelyard.llm.common import checked_broadcast, new_folder, stored

STRETCH_ROWS = 1024


def minimum_cost_transfers(supply: Sequence[int], capacity: Sequence[int]) -> list[list[int]]:
    """flow[i][j]: bytes that go from old shard i to new shard j. Same numbers are one shard:
    staying costs 0, moving costs 1 a byte. Needs sum(supply) <= sum(capacity). Shortest
    augmenting paths on the residual graph; its size depends on the numbers of shards alone."""
    old, new = len(supply), len(capacity)
    source, sink = old + new, old + new + 1
    heads: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, r: int, c: int) -> None:
        for x, y, k, w in ((a, b, r, c), (b, a, 0, -c)):
            heads[x].append(len(to))
            to.append(y)
            room.append(k)
            cost.append(w)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(new):
            arc(i, old + j, s, int(i != j))
    for j, c in enumerate(capacity):
        arc(old + j, sink, c, 0)
    while True:
        distance, through, queued = {source: 0}, {}, deque([source])
        while queued:
            at = queued.popleft()
            for e in heads[at]:
                if room[e] and distance[at] + cost[e] < distance.get(to[e], 1 << 60):
                    distance[to[e]], through[to[e]] = distance[at] + cost[e], e
                    queued.append(to[e])
        if sink not in distance:
            break
        path, at = [], sink
        while at != source:
            path.append(through[at])
            at = to[through[at] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    flow = [[0] * new for _ in range(old)]
    for i in range(old):
        for e in heads[i]:
            if old <= to[e] < old + new:
                flow[i][to[e] - old] = room[e ^ 1]
    if sum(map(sum, flow)) != sum(supply):
        raise ValueError("capacities do not hold all bytes")
    return flow


def runs_of(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(old shard, from byte, to byte, target): what stays first, then targets in order."""
    out = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, at, at + row[j], j))
                at += row[j]
    return out


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _target(start: Column, runs: list[tuple[int, int, int, int]]) -> Column:
    """The run's target for a row that begins at byte ``start`` of its old shard."""
    out = F.lit(None).cast("int")
    for shard, low, high, target in reversed(runs):
        out = F.when((F.col("old") == shard) & (start >= low) & (start < high), target).otherwise(out)
    return out


def _placed(parts: DataFrame, by: str, order: list[str], runs, base: Column) -> DataFrame:
    """``parts`` (bytes) with their first byte's place and their target; null if they straddle."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", base + F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    last = _target(F.col("start") + F.col("bytes") - 1, runs)
    return placed.withColumn("target", F.when(_target(F.col("start"), runs) == last, last))


def _path_within(table: str) -> Column:
    """A file's path from the table's own name on: files of one name in two folders differ, and a
    table that is moved keeps its paths."""
    name = re.escape(quote(table.rstrip("/").rpartition("/")[2]))
    return F.coalesce(F.nullif(F.regexp_extract("_metadata.file_path", f"/{name}(/.*)?$", 0), F.lit("")), F.col("_metadata.file_path"))


def reshard(
    spark: SparkSession, path: str, new_shards: int = 8, old_shards: int = 5, text: str = "text",
    capacity: Sequence[int] | None = None, target_folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Reshards the Parquet table at ``path`` into shards 0 .. new_shards - 1 of near-equal
    bytes (or the given capacities). A file lies in old shard hash(path within the table) mod old_shards.

    Returns the rows in their new places - ``row`` (a struct of all columns of the table),
    shard and slot (gapless from 0 within a shard) - and the manifest (file, shard, rows, moved). A row is
    one byte longer than its text; a null text has none. Rows with equal or null ids are rows
    of their own. An empty table gives no rows.
    """
    table = spark.read.parquet(path)
    part = "shard"  # a name for the folders that no column of the table has
    while part in table.columns:
        part = "_" + part
    raw = table.select(F.struct("*").alias("row"), _path_within(path).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = raw.select("_file", "_row", row_size(F.col("row")[text]).alias("bytes"), F.floor(F.col("_row") / STRETCH_ROWS).alias("_stretch"))
    old = F.pmod(F.xxhash64("_file"), F.lit(old_shards)).cast("int")
    stretches = stored(sizes.groupBy("_file", "_stretch").agg(F.sum("bytes").alias("bytes")).withColumn("old", old), "stretches")
    files = stretches.groupBy("old", "_file").agg(F.sum("bytes").alias("bytes"))
    supply = [0] * old_shards
    for r in files.groupBy("old").agg(F.sum("bytes").alias("n")).collect():  # one row per old shard
        supply[r["old"]] = r["n"]
    even = -(-sum(supply) // new_shards)
    room = list(capacity) if capacity else [even] * new_shards
    flow = minimum_cost_transfers(supply, room)
    runs = runs_of(flow)

    by_file = stored(_placed(files, "old", ["_file"], runs, F.lit(0)), "files")
    cut = by_file.where("target is null").select("_file", F.col("start").alias("base"))
    by_stretch = stored(_placed(stretches.join(cut, "_file"), "_file", ["_stretch"], runs, F.col("base")).drop("base"), "cut-stretches")
    cut = by_stretch.where("target is null").select("_file", "_stretch", "old", F.col("start").alias("base"))
    by_row = _placed(
        sizes.join(checked_broadcast(cut), ["_file", "_stretch"]).withColumn("_part", F.concat_ws("/", "_file", "_stretch")), "_part", ["_row"], runs, F.col("base")
    )
    by_row = stored(by_row.select("_file", "_row", "old", "start", "bytes", "target"), "cut-rows")
    # rows that straddle: one for each end of a run at most, so few; the largest choose first
    filled, homes_of = [sum(c) for c in zip(*flow, strict=True)], []
    across = sorted(by_row.where("target is null").collect(), key=lambda r: (-r["bytes"], r["_file"], r["_row"]))
    for r in across:
        parts = [(j, min(r["start"] + r["bytes"], high) - max(r["start"], low)) for i, low, high, j in runs if i == r["old"]]
        for j, n in parts:
            filled[j] -= max(n, 0)
    for r in across:
        among = [j for i, low, high, j in runs if i == r["old"] and low < r["start"] + r["bytes"] and high > r["start"]]
        j = min(among, key=lambda j: (filled[j] - room[j], j))
        filled[j] += r["bytes"]
        homes_of.append((r["_file"], r["_row"], j))
    chosen = spark.createDataFrame(homes_of, "_file string, _row long, home int")
    by_row = by_row.join(F.broadcast(chosen), ["_file", "_row"], "left").select("_file", "_row", F.coalesce("target", "home").alias("_by_row"))
    by_row = stored(by_row, "row-targets")

    stays = F.coalesce(F.col("target") == F.col("old"), F.lit(False))
    unmoved = [r["_file"] for r in by_file.where(stays).select("_file").collect()]  # names of files, as in a listing
    moving = raw.where(~F.col("_file").isin(unmoved)) if unmoved else raw
    placed = (
        moving.withColumn("_stretch", F.floor(F.col("_row") / STRETCH_ROWS))
        .join(checked_broadcast(by_file.select("_file", F.col("target").alias("_by_file"))), "_file")
        .join(checked_broadcast(by_stretch.select("_file", "_stretch", F.col("target").alias("_by_stretch"))), ["_file", "_stretch"], "left")
        .join(checked_broadcast(by_row), ["_file", "_row"], "left")
        .withColumn("_shard", F.coalesce("_by_file", "_by_stretch", "_by_row"))
    )
    folder = target_folder or new_folder(spark, "shards")
    placed.select("row.*", F.col("_shard").alias(part)).write.partitionBy(part).option("maxRecordsPerFile", 200_000).parquet(folder)

    schema = T.StructType([*table.schema.fields, T.StructField(part, T.IntegerType())])
    rewritten = spark.read.schema(schema).parquet(folder).select(
        F.struct(*table.columns).alias("row"), F.col(part).alias("_shard"), _path_within(folder).alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    homes = by_file.where(stays).select("_file", F.col("target").alias("_shard"))
    kept = raw.where(F.col("_file").isin(unmoved) if unmoved else F.lit(False)).join(checked_broadcast(homes), "_file")
    everything = kept.select(*rewritten.columns, F.lit(False).alias("_moved")).union(rewritten.withColumn("_moved", F.lit(True)))
    manifest = stored(
        everything.groupBy(F.col("_file").alias("file"), F.col("_shard").alias("shard"), F.col("_moved").alias("moved")).agg(F.count(F.lit(1)).alias("rows")), "manifest"
    )
    before = Window.partitionBy("shard").orderBy("moved", "file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(manifest.select(F.col("file").alias("_file"), F.col("moved").alias("_moved"), F.col("shard").alias("_shard"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_first")), "firsts")
    out = everything.join(checked_broadcast(firsts), ["_file", "_moved", "_shard"])
    return out.select("row", F.col("_shard").alias("shard"), (F.col("_first") + F.col("_row")).alias("slot")), manifest
