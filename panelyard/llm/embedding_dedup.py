"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are projected on their leading principal dimensions (a projection never lengthens
a distance), laid on a grid with cells of side epsilon and sorted by label and cell. The
sequence is cut into blocks; pairs of intervals of blocks are joined recursively, halving both
sides, and pairs whose bounding boxes are further apart than epsilon are skipped. What is left
are pairs of blocks, compared exactly in double precision.

Equal vectors are one entry with a count, so copies cost nothing. A pair of blocks returns link
counts per entry and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.llm.common import checked_broadcast, components, small_batches, stored

BLOCK_ROWS = 512
LEADING = 4


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, raws, dims = [], [], []
        for v in batch.column(2).to_pylist():
            a = None if v is None or not len(v) or any(x is None for x in v) else np.array(v, np.float64)
            if a is None or not np.isfinite(a).all() or not a.any() or not np.isfinite(float(a @ a)):
                digests.append(None)
                raws.append(None)
                dims.append(None)
            else:
                raw = (a + 0.0).tobytes()
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
                raws.append(raw)
                dims.append(len(a))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())],
            names=["vec_id", "label", "dim", "digest", "raw"],
        )


def _unit(raw: pa.Array, dim: int) -> np.ndarray:
    m = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(-1, dim)
    scale = np.abs(m).max(axis=1, keepdims=True)
    m = m / scale
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_axes(entries: DataFrame, leading: int) -> dict[int, np.ndarray]:
    """dim -> its leading principal directions. Moments are summed over all entries in Spark;
    the driver gets dim * (dim + 1) numbers per distinct dim."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                u = _unit(batch.column(1).filter(pa.array(dims == d)), int(d))
                sums[int(d)] = sums.get(int(d), 0.0) + np.concatenate([[len(u)], u.sum(axis=0), (u.T @ u).ravel()])
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(s), pa.int32()), pa.array(np.arange(len(s)), pa.int32()), pa.array(s)], names=["dim", "at", "x"])

    got = entries.select("dim", "raw").mapInArrow(moments, "dim int, at int, x double").groupBy("dim", "at").agg(F.sum("x").alias("x")).collect()
    out = {}
    for d in {r["dim"] for r in got}:
        s = np.zeros(1 + d + d * d)
        for r in got:
            if r["dim"] == d:
                s[r["at"]] = r["x"]
        mean = s[1 : d + 1] / s[0]
        _, vectors = np.linalg.eigh(s[d + 1 :].reshape(d, d) / s[0] - np.outer(mean, mean))
        out[d] = np.ascontiguousarray(vectors[:, ::-1][:, :leading])
    return out


def sorted_blocks(entries: DataFrame, axes: dict[int, np.ndarray], eps: float, block_rows: int) -> DataFrame:
    """(label, dim, seq, reps, counts, raw, low, high): the grid-ordered sequence in blocks; seq
    counts a label's blocks from 0, low and high bound the leading coordinates."""
    leading = min((a.shape[1] for a in axes.values()), default=1)
    cells = ", ".join(f"c{i} long" for i in range(leading))
    fields = "label long, dim int, rep long, n long, digest binary, raw binary, " + cells + ", at array<double>"

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in fields.split(", ")]
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            at = np.zeros((len(dims), leading))
            for d in np.unique(dims):
                at[dims == d] = _unit(batch.column(5).filter(pa.array(dims == d)), int(d)) @ axes[int(d)][:, :leading]
            cell = np.floor(at / eps).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(cell[:, i]) for i in range(leading)], pa.array(at.tolist(), pa.list_(pa.float64()))], names=names
            )

    order = ["label", "dim", *[f"c{i}" for i in range(leading)], "digest"]
    ordered = entries.mapInArrow(projected, fields).repartitionByRange(*order).sortWithinPartitions(*order)
    out = "label long, dim int, part int, inner int, reps array<long>, counts array<long>, raw binary, low array<double>, high array<double>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, inner, held, key = TaskContext.get().partitionId(), 0, [], None

        def block() -> pa.RecordBatch:
            at = np.array([r["at"] for r in held])
            row = {
                "label": key[0], "dim": key[1], "part": part, "inner": inner, "reps": [r["rep"] for r in held], "counts": [r["n"] for r in held],
                "raw": b"".join(r["raw"] for r in held), "low": at.min(axis=0).tolist(), "high": at.max(axis=0).tolist(),
            }
            schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("part", pa.int32()), ("inner", pa.int32()), ("reps", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("raw", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (key != (r["label"], r["dim"]) or len(held) == block_rows):
                    yield block()
                    inner, held = inner + 1, []
                key = (r["label"], r["dim"])
                held.append(r)
        if held:
            yield block()

    blocks = stored(ordered.mapInArrow(cut, out), "blocks")
    # sequence numbers: blocks before this partition, then within it; one row per partition and label
    parts = blocks.groupBy("label", "dim", "part").agg(F.count(F.lit(1)).alias("n"), F.min("inner").alias("least"))
    before = Window.partitionBy("label", "dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("label", "dim", "part", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return blocks.join(parts, ["label", "dim", "part"]).withColumn("seq", F.col("first") + F.col("inner") - F.col("least"))


def interval_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """(label, dim, a, b), a <= b: pairs of blocks that may hold vectors within ``eps``. Starts
    with each label's whole sequence against itself and halves both intervals, level by
    level, dropping pairs of intervals whose boxes are further apart."""
    top = boxes.agg(F.max("seq")).first()[0]
    if top is None:
        return boxes.select("label", "dim", F.col("seq").alias("a"), F.col("seq").alias("b"))
    levels = max(1, int(top)).bit_length()
    def nodes(level: int) -> DataFrame:
        keyed = boxes.select("label", "dim", F.shiftright("seq", level).alias("node"), F.posexplode(F.arrays_zip("low", "high")).alias("d", "x"))
        ends = keyed.groupBy("label", "dim", "node", "d").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
        return ends.groupBy("label", "dim", "node").agg(F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("box"))

    root = stored(nodes(levels), "intervals")
    pairs = root.select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in range(levels - 1, -1, -1):
        node = stored(nodes(level), "intervals")
        one = lambda n, side: node.select("label", "dim", F.shiftright("node", 1).alias(side), F.col("node").alias(f"{side}_next"), F.col("box").alias(f"{side}_box"))  # noqa: E731, B023
        apart = F.aggregate(
            F.zip_with("a_box", "b_box", lambda x, y: F.greatest(x["low"] - y["high"], y["low"] - x["high"], F.lit(0.0))),
            F.lit(0.0), lambda s, g: s + g * g,
        )
        grown = pairs.join(one(node, "a"), ["label", "dim", "a"]).join(one(node, "b"), ["label", "dim", "b"]).where("a_next <= b_next")
        pairs = stored(grown.where(apart <= eps * eps).select("label", "dim", F.col("a_next").alias("a"), F.col("b_next").alias("b")), "interval-pairs")
    return pairs


def _compare(threshold: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["a"] == r["b"]
                x = np.frombuffer(r["raw_a"], np.float64).reshape(-1, r["dim"])
                y = x if same else np.frombuffer(r["raw_b"], np.float64).reshape(-1, r["dim"])
                nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
                linked = (x @ y.T) / (nx[:, None] * ny[None, :]) >= threshold
                if same:
                    np.fill_diagonal(linked, False)
                ra, rb = np.array(r["reps_a"], np.int64), np.array(r["reps_b"], np.int64)
                ca, cb = np.array(r["counts_a"], np.int64), np.array(r["counts_b"], np.int64)
                ids, links = [ra], [linked @ cb]
                if not same:
                    ids.append(rb)
                    links.append(linked.T @ ca)
                ids, links = np.concatenate(ids), np.concatenate(links)
                some = links > 0
                # a spanning set: the first partner of every entry, and the components' smallest entries
                label = ra.copy()
                if linked.any():
                    other = rb.copy()
                    while True:
                        far = np.where(linked, other[None, :], np.iinfo(np.int64).max).min(axis=1)
                        new = np.minimum(label, far)
                        back = np.where(linked, new[:, None], np.iinfo(np.int64).max).min(axis=0)
                        newer = np.minimum(other, back)
                        if same:
                            new = newer = np.minimum(new, newer)
                        if (new == label).all() and (newer == other).all():
                            break
                        label, other = new, newer
                    ends = label if same else np.concatenate([label, other])
                else:
                    ends = ids
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ends[some])], names=["rep", "links", "least"])

    return compared


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    block_rows: int = BLOCK_ROWS, leading: int = LEADING,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows with an equal label and a
    cosine of ``threshold`` or more), component_id (the smallest vec_id reachable by links)
    and kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows with a null label or id, nor vectors of different lengths. Rows that
    repeat a vector are linked with each other, also under one id. Other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    units = stored(rows.mapInArrow(_unit_vectors, "vec_id long, label long, dim int, digest binary, raw binary"), "units")
    usable = units.where("digest is not null and label is not null and vec_id is not null")
    # an entry's number, given once and stored: two vectors may bear one id
    entries = stored(
        usable.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.min("raw").alias("raw"))
        .select("label", "dim", F.monotonically_increasing_id().alias("rep"), "n", "digest", "raw", "vec_id"), "entries"
    )
    axes = principal_axes(entries, leading)
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    blocks = stored(sorted_blocks(entries.drop("vec_id"), axes, eps, block_rows), "sequence")
    pairs = interval_pairs(blocks.select("label", "dim", "seq", "low", "high"), eps)
    side = lambda s: blocks.select("label", "dim", F.col("seq").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("reps", "counts", "raw")])
    small_batches(vectors.sparkSession, rows=16)
    met = pairs.repartition("label", "dim", "a", "b").join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
    links = stored(met.mapInArrow(_compare(threshold), "rep long, links long, least long"), "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("rep").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "rep")
    smallest = groups.join(entries.select("rep", "vec_id"), "rep").groupBy("component").agg(F.min("vec_id").alias("smallest"))
    groups = groups.join(smallest, "component").select("rep", "smallest")
    known = entries.select("label", "dim", "digest", "rep", "n", "vec_id").join(counts, "rep", "left").join(groups, "rep", "left")
    known = stored(
        known.select("label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "vec_id").alias("component")), "entry-results"
    )
    keyed = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), "dim", "digest")
    out = keyed.join(checked_broadcast(known), ["label", "dim", "digest"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
