"""Vectors as integers: parsing, exact squared distances, exact component sums.

Components become floor(scale * x). Distances are 64-bit integers, so results do not depend
on the order in which anything is added. A component whose integer is out of EXACT_LIMIT would
overflow them and raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelyard.llm.common import new_folder, remove_folder

EXACT_LIMIT = 1 << 26
PAIRS = 16_384  # pairs evaluated at once


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, values) of a column of lists of doubles; the length is -1 where the
    list is null or holds a null or non-finite component."""
    values = column.values
    flat = values.fill_null(np.nan) if values.null_count else values
    flat = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    lengths = np.diff(offsets)
    lengths[bad[offsets[1:]] > bad[offsets[:-1]]] = -1
    if column.null_count:
        lengths[column.is_null().to_numpy(zero_copy_only=False)] = -1
    return offsets[:-1], lengths, flat


def integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the rows that hold ``dim`` finite components, and those as integers."""
    starts, lengths, flat = lists(column)
    rows = np.flatnonzero(lengths == dim)
    whole = np.floor(flat[starts[rows, None] + np.arange(dim)] * scale)
    if whole.size and np.abs(whole).max() > EXACT_LIMIT:
        raise ValueError(f"a component beyond {EXACT_LIMIT / scale:g} has no exact 64-bit distance")
    return rows, whole.astype(np.int32)


def packed(matrix: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    raw = np.ascontiguousarray(matrix)
    width = raw.shape[1] * raw.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())


def unpacked(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """The matrix behind a column made by ``packed``."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def squared(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of row i to row i of ``others``, exactly."""
    gap = rows.astype(np.int64) - others
    return np.einsum("ij,ij->i", gap, gap)


def squared_pairs(rows: np.ndarray, entries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows[i] to entries[j], exactly, a bounded number at a time."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = squared(rows[i[part]], entries[j[part]])
    return out


def squared_tile(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exactly: in double precision where every
    product and sum stays below 2^53, otherwise in 64-bit integers."""
    most = max(int(np.abs(rows).max()), int(np.abs(entries).max()))
    kind = np.float64 if 4 * rows.shape[1] * most * most < 1 << 53 else np.int64
    a, b = rows.astype(kind), entries.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def keep_vectors(vectors: DataFrame, columns: str, dim: int, scale: int, path: str) -> DataFrame:
    """The rows of ``vectors`` (vector last, array<double>) that hold ``dim`` finite components,
    written to ``path`` with the integers as bytes in ``x``; the other columns, declared by
    ``columns``, stay."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(batch.num_columns - 1), dim, scale)
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], packed(x)], names=[*batch.schema.names[:-1], "x"])

    return written(vectors.mapInArrow(parsed, f"{columns}, x binary"), path)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, old: str, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a new folder; ``old``, which it was made from, goes once it is written."""
    path = new_folder(df.sparkSession, name)
    out = written(df, path)
    remove_folder(df.sparkSession, old)
    return out, path


def floored_means(table: DataFrame, assign: Callable, entries: np.ndarray, columns: list[str]) -> np.ndarray:
    """``entries`` (n, width) with each replaced by floor(sum / count) of the rows that
    ``assign(batch)`` gives it, componentwise; entries without rows stay. ``assign`` returns
    pairs (entry numbers, integer rows). Tasks add up their own rows, Spark adds the tasks;
    the driver gets n * (width + 1) numbers at most."""
    n, width = entries.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n, width + 1), np.int64)
        for batch in batches:
            for at, rows in assign(batch):
                order = np.argsort(at, kind="stable")
                found, first = np.unique(at[order], return_index=True)
                if len(found):
                    sums[found, :width] += np.add.reduceat(rows[order].astype(np.int64), first, axis=0)
                    sums[found, width] += np.diff(np.append(first, len(at)))
        used = np.flatnonzero(sums[:, width])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width + 1), pa.int32()), pa.array(np.tile(np.arange(width + 1), len(used)), pa.int32()), pa.array(sums[used].ravel())],
            names=["entry", "at", "total"],
        )

    totals = table.select(*columns).mapInArrow(added, "entry int, at int, total long").groupBy("entry", "at").sum("total").collect()
    sums = np.zeros((n, width + 1), np.int64)
    for entry, at, total in totals:
        sums[entry, at] = total
    used = sums[:, width] > 0
    out = entries.copy()
    out[used] = sums[used, :width] // sums[used, width:]
    return out
