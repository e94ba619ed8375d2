"""Centroid clustering of integer vectors with ns-bounds.

Every vector keeps, per centroid, a lower bound of its distance and the round in which that was
last evaluated, and an upper bound for its own centroid. All centroids of all rounds are kept as
history. Later, a bound is loosened by the norm of the centroid's total displacement since the
bound's round (never the sum of its moves, which is at least as long). Where some lower bound
does not clear the upper one, the vector fails: its own distance is evaluated, then every centroid
whose bound still does not clear it, exactly in integers.

The bounds are only used with a margin for rounding; ties go to the smaller number by exact
comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import new_folder, small_batches
from panelyard.llm.integer_vectors import floored_means, keep_vectors, packed, replaced, squared, squared_pairs, unpacked

STATE = "vec_id long, x binary, cluster int, distance long, since int, lower binary, evaluated binary"


def below(squares: np.ndarray) -> np.ndarray:
    """Square roots as single precision numbers that are not above them."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-1))


class Bounds:
    """The state of some vectors, and its passage to the next round."""

    def __init__(self, x, cluster, distance, since, lower, evaluated):
        self.x, self.cluster, self.distance, self.since, self.lower, self.evaluated = x, cluster, distance, since, lower, evaluated

    @classmethod
    def first(cls, x: np.ndarray, centroids: np.ndarray) -> Bounds:
        """All distances, evaluated."""
        squares = np.stack([squared(x, c[None, :]) for c in centroids], axis=1) if len(x) else np.zeros((0, len(centroids)), np.int64)
        cluster = squares.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
        nearest = squares[np.arange(len(x)), cluster]
        return cls(x, cluster, nearest, np.zeros(len(x), np.int64), below(squares), np.zeros(squares.shape, np.int8))

    def loosened(self, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bound of the own distance and lower bounds of all distances in the newest round."""
        moved = np.sqrt(((history[-1][None] - history).astype(np.float64) ** 2).sum(axis=2))
        upper = np.sqrt(self.distance.astype(np.float64)) + moved[self.since, self.cluster]
        return upper, self.lower - moved[self.evaluated, np.arange(history.shape[1])[None, :]]

    def advance(self, history: np.ndarray, exact: bool = False) -> int:
        """To the newest round of ``history``; with ``exact`` every own distance is evaluated.
        Returns the number of distances evaluated."""
        now, newest = len(history) - 1, history[-1]
        upper, lower = self.loosened(history)
        lower[np.arange(len(self.x)), self.cluster] = np.inf
        fails = np.flatnonzero((lower <= (upper * (1 + 1e-9) + 1e-6)[:, None]).any(axis=1))
        renewed = np.arange(len(self.x)) if exact else fails
        own = squared_pairs(self.x, newest, renewed, self.cluster[renewed])
        self.distance[renewed], self.since[renewed] = own, now
        self.lower[renewed, self.cluster[renewed]], self.evaluated[renewed, self.cluster[renewed]] = below(own), now
        upper = np.sqrt(self.distance[fails].astype(np.float64)) * (1 + 1e-9) + 1e-6
        at, j = np.nonzero(lower[fails] <= upper[:, None])
        i = fails[at]
        found = squared_pairs(self.x, newest, i, j)
        self.lower[i, j], self.evaluated[i, j] = below(found), now
        # the least (distance, number) of the own centroid and the evaluated ones
        all_i, all_j = np.concatenate([fails, i]), np.concatenate([self.cluster[fails], j])
        all_d = np.concatenate([self.distance[fails], found])
        order = np.lexsort((all_j, all_d, all_i))
        rows, first = np.unique(all_i[order], return_index=True)
        self.cluster[rows], self.distance[rows] = all_j[order][first], all_d[order][first]
        self.since[rows] = now
        return len(renewed) + len(found)

    def columns(self) -> list[pa.Array]:
        return [
            packed(self.x), pa.array(self.cluster, pa.int32()), pa.array(self.distance, pa.int64()), pa.array(self.since, pa.int32()), packed(self.lower), packed(self.evaluated),
        ]

    @classmethod
    def read(cls, batch: pa.RecordBatch, dim: int, k: int) -> Bounds:
        whole = lambda i: batch.column(i).to_numpy().astype(np.int64)
        return cls(
            unpacked(batch.column(1), np.int32, dim), whole(2), whole(3), whole(4),
            unpacked(batch.column(5), np.float32, k).copy(), unpacked(batch.column(6), np.int8, k).copy(),
        )


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: str = "1",
) -> DataFrame:
    """One row per vector of exactly ``dim`` finite components: vec_id, cluster, distance (squared),
    cluster_inertia, inertia, centroid_sha256 and centroid (the final integer components).

    Components become floor(scale * x). Centroids start as the ``k`` vectors with the smallest
    sha256 of ``seed:vec_id`` (null ids last, ties by components); fewer vectors give fewer
    centroids. Null vectors, other lengths and null or non-finite components are left out;
    repeated rows are vectors of their own; without any vector there are no rows. ``rounds`` may
    be 126 at most, as the history of rounds is numbered in a byte."""
    spark = vectors.sparkSession
    small_batches(spark, rows=4096, mib=4)
    chosen = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    path = new_folder(spark, "vectors")
    table = keep_vectors(chosen, "vec_id long", dim, scale, path)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = table.orderBy(F.asc_nulls_last(digest), F.col("x")).limit(k).select("x").collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    history = np.stack([np.frombuffer(r["x"], np.int32) for r in starts]).astype(np.int64)[None]

    def passed(history: np.ndarray, last: bool):
        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(history) == 1:
                    state = Bounds.first(unpacked(batch.column(1), np.int32, dim), history[0])
                else:
                    state = Bounds.read(batch, dim, history.shape[1])
                    state.advance(history, exact=last)
                yield pa.RecordBatch.from_arrays([batch.column(0), *state.columns()], names=[f.split()[0] for f in STATE.split(", ")])
        return moved

    def members(batch: pa.RecordBatch):
        yield batch.column(0).to_numpy().astype(np.int64), unpacked(batch.column(1), np.int32, dim)

    for now in range(rounds + 1):
        moved = table.mapInArrow(passed(history, last=now == rounds), STATE)
        if now == rounds:
            moved = moved.select("vec_id", "cluster", "distance")
        table, path = replaced(moved, path, "clusters")
        if now < rounds:
            history = np.concatenate([history, floored_means(table, members, history[-1], ["cluster", "x"])[None]])
    return described(table, history[-1])


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assigned vectors with the sums and the final centroid of their cluster. The joined
    table has a row per centroid."""
    whole = F.sum(F.col("distance").cast("decimal(38,0)")).cast("long")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(whole.alias("s")).collect()}
    rows = [
        (c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist())
        for c in sorted(inertia)
    ]
    clusters = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
