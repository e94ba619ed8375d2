"""Vector code compression: product quantisation with LAESA pivots.

Integer vectors are cut into parts; each part position has a codebook that is refined for some
rounds. A few fixed pivots per position are taken from the first codebook. The distance of every
part to its pivots is computed once and stored. In each round the distances of pivots and entries
give, by the triangle inequality, |d(part, pivot) - d(entry, pivot)| as lower bounds of
d(part, entry). Entries are visited in the order of their bounds, in tiles of like parts and
entries, and evaluated exactly in integers unless the bounds, with a margin for rounding, exceed
the best distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.llm.common import checked_broadcast, new_folder, small_batches, stored
from panelyard.llm.integer_vectors import floored_means, keep_vectors, lists, packed, replaced, squared, squared_tile, unpacked

PIVOTS = 8
CHUNK = 1024  # parts whose bounds are held at once
TILE = 16  # entries that are evaluated together


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different entries, each the furthest from those before it."""
    chosen, gap = [0], squared(entries, entries[:1])
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(entries, entries[chosen[-1]][None, :]))
    return entries[chosen]


def to_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all rows to all pivots."""
    return np.sqrt(np.stack([squared(rows, p[None, :]) for p in pivots], axis=1).astype(np.float64))


def nearest(rows: np.ndarray, at_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry numbers, squared distances, distances evaluated): the nearest entry of each row,
    ties to the lower number. Rows are taken in chunks of like distances to the pivots, so that
    whole tiles of rows and entries are out of reach together."""
    codes, best, evaluated = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 0
    order = np.lexsort((at_pivots.min(axis=1), at_pivots.argmin(axis=1)))
    for at in range(0, len(rows), CHUNK):
        part = order[at : at + CHUNK]
        codes[part], best[part], n = _nearest_chunk(rows[part], at_pivots[part], entries, entry_pivots)
        evaluated += n
    return codes, best, evaluated


def _nearest_chunk(rows, at_pivots, entries, entry_pivots):
    """The entry of the least bound comes first, row by row. Then entries go tile by tile in the
    order of their bounds; a tile holds the rows and entries with a pair within reach."""
    bounds = np.zeros((len(rows), len(entries)))
    for p in range(entry_pivots.shape[1]):
        np.maximum(bounds, np.abs(at_pivots[:, p, None] - entry_pivots[None, :, p]), out=bounds)
    bounds -= 1e-6 * (1.0 + at_pivots.max(axis=1, keepdims=True) + entry_pivots.max())  # stored distances are in single precision
    code = bounds.argmin(axis=1)
    best = squared(rows, entries[code])
    evaluated = len(rows)
    by_bound = np.argsort(bounds.mean(axis=0), kind="stable")
    for at in range(0, len(entries), TILE):
        tile = np.sort(by_bound[at : at + TILE])  # ascending, so the first of equal distances is the lowest entry
        near = bounds[:, tile] <= np.sqrt(best.astype(np.float64))[:, None]
        who, which = np.flatnonzero(near.any(axis=1)), tile[near.any(axis=0)]
        if not len(who):
            continue
        squares = squared_tile(rows[who], entries[which])
        evaluated += squares.size
        first = squares.argmin(axis=1)
        least, number = squares[np.arange(len(who)), first], which[first]
        better = (least < best[who]) | ((least == best[who]) & (number < code[who]))
        code[who[better]], best[who[better]] = number[better], least[better]
    return code, best, evaluated


def common_length(vectors: DataFrame, parts: int) -> int | None:
    """The length that most usable vectors have (ties: the greater) among multiples of ``parts``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, _ = lists(batch.column(0))
            found, n = np.unique(lengths[(lengths > 0) & (lengths % parts == 0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["length", "n"])

    most = vectors.select("v").mapInArrow(counted, "length long, n long").groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return most and most["length"]


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    pivots: int = PIVOTS,
) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): per kept vector vec_id, label, codes (binary, a byte per part) and error
    (squared distances to its entries, summed over parts); codebooks are integers by part, entry
    and position within the part.

    Components become floor(scale * x). Codebooks start as the parts of the vectors with the
    smallest ids (null ids last, ties by components); fewer vectors give fewer entries, at most
    256 are allowed. Null vectors and those with null or non-finite components are left out, and
    so are vectors that cannot share the codebooks: those of another length than the one that
    most vectors have, and of lengths that do not divide into parts. Repeated rows are vectors
    of their own; without any vector there are no rows and no codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 256 entries at most")
    spark = vectors.sparkSession
    small_batches(spark, rows=4096, mib=4)
    label_type = vectors.schema[label].dataType
    chosen = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    base = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label_type)])
    coded = T.StructType([*base.fields, T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])
    dim = common_length(chosen, parts)
    if dim is None:
        return spark.createDataFrame([], coded), np.zeros((parts, 0, 0), np.int64)
    width = dim // parts
    path = new_folder(spark, "vectors")
    table = keep_vectors(chosen, f"vec_id long, label {label_type.simpleString()}", dim, scale, path)
    starts = table.orderBy(F.asc_nulls_last("vec_id"), F.col("x")).limit(entries).select("x").collect()
    books = np.stack([np.frombuffer(r["x"], np.int32) for r in starts]).astype(np.int64).reshape(len(starts), parts, width).transpose(1, 0, 2)
    fixed = [choose_pivots(book, pivots) for book in books]
    cuts = np.cumsum([0, *[len(p) for p in fixed]])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(2), np.int32, dim).reshape(-1, parts, width)
            gaps = np.concatenate([to_pivots(x[:, p], fixed[p]) for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, packed(gaps.astype(np.float32))], names=["vec_id", "label", "x", "gaps"])

    with_gaps = T.StructType([*base.fields, T.StructField("x", T.BinaryType()), T.StructField("gaps", T.BinaryType())])
    table, path = replaced(table.mapInArrow(measured, with_gaps), path, "pivots")

    def coder(books: np.ndarray):
        entry_gaps = [to_pivots(books[p], fixed[p]) for p in range(parts)]

        def of(x: pa.Array, gaps: pa.Array):
            """Part number, its rows, their entries and squared distances."""
            rows, far = unpacked(x, np.int32, dim).reshape(-1, parts, width), unpacked(gaps, np.float32, int(cuts[-1])).astype(np.float64)
            for p in range(parts):
                codes, squares, _ = nearest(rows[:, p], far[:, cuts[p] : cuts[p + 1]], books[p], entry_gaps[p])
                yield p, rows[:, p], codes, squares
        return of

    for _ in range(rounds):
        code = coder(books)

        def members(batch: pa.RecordBatch, code=code):
            for p, rows, codes, _ in code(batch.column(0), batch.column(1)):
                yield codes + p * books.shape[1], rows

        books = floored_means(table, members, books.reshape(-1, width), ["x", "gaps"]).reshape(books.shape)
    code = coder(books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(code(batch.column(2), batch.column(3)))
            codes = np.stack([c for _, _, c, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), packed(codes), pa.array(sum(s for *_, s in found), pa.int64())], names=["vec_id", "label", "codes", "error"]
            )

    rows, _ = replaced(table.mapInArrow(final, coded), path, "codes")
    return rows, books


def decompress(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` of compress with the integer vector that each code stands for, in ``decoded``."""
    parts, _, width = books.shape

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = unpacked(batch.column(batch.schema.get_field_index("codes")), np.uint8, parts)
            flat = np.concatenate([books[p][codes[:, p]] for p in range(parts)], axis=1)
            offsets = np.arange(len(codes) + 1, dtype=np.int32) * (parts * width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))], names=[*batch.schema.names, "decoded"])

    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(decoded, schema)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` (stored) with label_error: the error summed over equal labels, nulls together. The
    sums of labels that hold over a thousandth of the rows (a thousand at most) are broadcast, so
    no hot label meets in one task; the others are joined as their size allows."""
    totals = stored(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    all_rows = totals.agg(F.sum("n")).first()[0] or 0
    sums = totals.select(F.col("label").alias("_label"), "label_error", "n")
    wide = rows.select("vec_id", "label", "codes", "error")
    on = F.col("label").eqNullSafe(F.col("_label"))
    hot = sums.where(F.col("n") * 1000 > all_rows).drop("n")
    found = wide.join(F.broadcast(hot), on, "left").drop("_label")
    if totals.where(F.col("n") * 1000 <= all_rows).isEmpty():
        return found
    rest = found.where("label_error is null").drop("label_error").join(checked_broadcast(sums.drop("n")), on).drop("_label")
    return found.where("label_error is not null").unionByName(rest)


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all components by part, entry and position, as decimal numbers."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
