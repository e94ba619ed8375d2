"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 .. 3 are ordered. One weight vector is shared by all thresholds:
P(grade <= k) = logistic(threshold_k - w . x), thresholds increasing. The expected severity is
the sum over k of P(grade > k).

Features are sparse: words and word beginnings of four to six letters (so inflected forms
share weight), counted up to CAP times. Which features are kept, and the weights, come from a
bounded sample of labelled rows (``sample_rows``, taken by a hash of the id). Labels tell
toxic from not toxic; the grade of a toxic row is the number of its words that hold a feature
seen in toxic rows only, from 1 up to 3.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.llm.common import small_batches, stored

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
GRADES = 4
CAP = 3
SAMPLE_ROWS = 40_000
FEATURES = 4096
LEAST_ROWS = 3  # labelled rows that a kept feature occurs in, at least
LEAST_ODDS = 1.5  # log-odds of a kept feature, at least
REJECT_FROM = 0.5  # expected severity


def word_features(word: str) -> list:
    """The word itself and its beginnings; a beginning is marked, so it differs from a word."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]]


@dataclass
class Model:
    features: dict  # feature -> column
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list) -> np.ndarray:
        """Expected severity of each text."""
        get = self.features.get
        out = np.zeros(len(texts))
        memo: dict[str, tuple] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            seen: dict[int, int] = {}
            for word in WORD.findall(text.lower()):
                columns = memo.get(word)
                if columns is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    columns = memo[word] = tuple(c for f in word_features(word) if (c := get(f)) is not None)
                for c in columns:
                    seen[c] = seen.get(c, 0) + 1
            out[i] = sum(self.weights[c] * min(n, CAP) for c, n in seen.items())
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - out[:, None], -60, 60))) @ np.ones(GRADES - 1)


def fit(at: np.ndarray, columns: np.ndarray, counts: np.ndarray, grades: np.ndarray, width: int, steps: int = 400, rate: float = 0.1, penalty: float = 1e-4):
    """Weights and thresholds by gradient steps (Adam) on the mean log-likelihood. The
    samples are a sparse matrix: sample, column and count of each entry."""
    rows = grades
    w = np.zeros(width)
    raw = np.array([0.0, *np.log(np.ones(GRADES - 2))])  # first threshold, logs of the gaps
    params, m, v = np.concatenate([w, raw]), 0.0, 0.0
    sizes = np.bincount(grades, minlength=GRADES)
    weight = (len(grades) / (GRADES * np.maximum(sizes, 1)))[grades] ** 0.5  # rare grades count more
    for step in range(1, steps + 1):
        w, raw = params[:width], params[width:]
        gaps = np.exp(np.clip(raw[1:], -8, 4))
        theta = np.concatenate([[raw[0]], raw[0] + np.cumsum(gaps)])
        score = np.bincount(at, w[columns] * counts, len(rows))
        upper = np.concatenate([theta, [np.inf]])[grades] - score
        lower = np.concatenate([[-np.inf], theta])[grades] - score
        fu, fl = 1 / (1 + np.exp(-np.clip(upper, -60, 60))), 1 / (1 + np.exp(-np.clip(lower, -60, 60)))
        p = np.maximum(fu - fl, 1e-12)
        du, dl = weight * fu * (1 - fu) / p / len(rows), weight * fl * (1 - fl) / p / len(rows)
        g_score = du - dl  # of the negative log-likelihood
        g_w = np.bincount(columns, g_score[at] * counts, width) + penalty * w
        g_theta = np.array([-(du[grades == k].sum()) + dl[grades == k + 1].sum() for k in range(GRADES - 1)])
        g_raw = np.concatenate([[g_theta.sum()], gaps * np.cumsum(g_theta[:0:-1])[::-1]])
        g = np.concatenate([g_w, g_raw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, raw = params[:width], params[width:]
    return w, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(np.clip(raw[1:], -8, 4)))])


def train(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, features: int = FEATURES,
) -> Model | None:
    """A model from at most ``sample_rows`` labelled rows; None if they lack toxic or clean
    rows. Labels that are null, or that contradict each other for one id, are left out."""
    spark = documents.sparkSession
    small_batches(spark)
    agreed = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z")
    )
    chosen = stored(agreed.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).select("_id", "_y"), "labelled")
    sample = (
        documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).where("_t is not null")
        .join(F.broadcast(chosen), "_id").select("_id", "_y", "_t")  # at most sample_rows rows
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list] = {}

        def flushed() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([
                pa.array(keys, pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())
            ], names=["feature", "clean", "toxic"])
            counts.clear()
            return out

        for batch in batches:
            for y, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for f in {f for w in set(WORD.findall(t.lower())) for f in word_features(w)}:
                    counts.setdefault(f, [0, 0])[y] += 1
                if len(counts) > 300_000:
                    yield flushed()
        if counts:
            yield flushed()

    seen = (
        sample.mapInArrow(counted, "feature string, clean long, toxic long")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("clean") + F.col("toxic") >= LEAST_ROWS)
    )
    totals = chosen.groupBy("_y").count().collect()
    size = {r["_y"]: r["count"] for r in totals}
    if set(size) != {0, 1}:
        return None
    odds = F.log((F.col("toxic") + 0.5) / (size[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (size[0] + 1.0))
    # log-odds over their standard error, at least: more rows hold more words that are toxic by chance
    least_z = 0.8 * float(np.sqrt(2 * np.log(size[0] + size[1])))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    kept = (
        seen.withColumn("odds", odds).withColumn("gain", F.col("toxic") * F.col("odds"))
        .where(F.col("odds") >= F.greatest(F.lit(LEAST_ODDS), least_z * error)).orderBy(F.desc("gain"), "feature").limit(features).collect()  # at most ``features`` rows
    )
    columns = {r["feature"]: i for i, r in enumerate(kept)}
    only_toxic = {r["feature"] for r in kept if r["clean"] == 0}
    schema = "_id long, y int, marks int, columns array<int>, counts array<int>"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys, marks, cs, ns = [], [], [], [], []
            for i, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found: Counter = Counter()
                marked = 0
                for w in WORD.findall(t.lower()):
                    fs = word_features(w)
                    marked += any(f in only_toxic for f in fs)
                    found.update(columns[f] for f in fs if f in columns)
                ids.append(i)
                ys.append(y)
                marks.append(marked)
                cs.append(list(found))
                ns.append([min(n, CAP) for n in found.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(marks, pa.int32()), pa.array(cs, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32()))],
                names=["_id", "y", "marks", "columns", "counts"],
            )

    rows = sample.mapInArrow(vectors, schema).select("_id", "y", "marks", "columns", "counts").toPandas().sort_values("_id", kind="stable")
    if not len(rows):
        return None
    grades = np.where(rows.y == 0, 0, np.clip(rows.marks, 1, GRADES - 1)).astype(np.int64)
    at = np.repeat(np.arange(len(rows)), rows["columns"].map(len).to_numpy())
    weights, thresholds = fit(
        at, np.concatenate([*rows["columns"], []]).astype(np.int64), np.concatenate([*rows["counts"], []]).astype(float), grades, max(len(columns), 1)
    )
    return Model(columns, weights, thresholds)


def score(documents: DataFrame, model: Model | None, text: str = "text", out: str = "severity") -> DataFrame:
    """``documents`` with the expected severity (0 to 3) of the whole text in ``out``. Null and
    empty texts, and all texts if there is no model, have 0. Repeated rows get equal scores."""
    small_batches(documents.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            values = np.zeros(len(texts)) if model is None else model.scores(texts)
            values = [0.0 if not t else float(v) for t, v in zip(texts, values, strict=True)]
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(values, pa.float64())], names=[*[n for n in batch.schema.names if n != "_text"], out])

    schema = T.StructType([*documents.schema.fields, T.StructField(out, T.DoubleType())])
    return documents.withColumn("_text", F.col(text).cast("string")).mapInArrow(scored, schema)


def grade(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", reject_from: float = REJECT_FROM, **sample) -> DataFrame:
    """One row per row of ``documents``: doc_id, severity (expected), grade (rounded) and toxic
    (severity of ``reject_from`` or more)."""
    model = train(documents, labels, doc_id, text, **sample)
    rows = score(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= reject_from).alias("toxic"))
