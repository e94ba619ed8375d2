"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Words are runs of letters and digits, or of other signs, with their case. Every word has a row in
a table of fixed size, chosen by its hash, and every row an index vector: a few +1 and -1 at
places drawn from the row's number. A row's context vector is the sum of the index vectors of all
words up to WINDOW places away, over the whole corpus; rows are also counted. The table does not
grow with the corpus: more words share a row, and none is left out.

A document is pooled from its words' vectors, weighted by rarity, once over all occurrences and
once over different rows, with its length, its share of different rows and its share of words
that repeat the one before. A two-layer network turns that into a probability, divided by a
temperature that is fitted on labelled rows which the network has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.llm.common import batches_of, mix, powers, small_batches, stored, text_buffer

ROWS = 1 << 15  # of the word table
DIM = 32
ONES = 4  # places of an index vector that are not zero
WINDOW = 2
HIDDEN = 32
SAMPLE_ROWS = 40_000
FOLDS = 5  # documents of remainder 0 are held out
LEAST_SCORE = 0.3
BATCH_BYTES = 2 << 20

SPACE, WORD, SIGN = 0, 1, 2
KINDS = np.full(256, SIGN, np.uint8)
KINDS[:33] = SPACE
KINDS[127] = SPACE
KINDS[128:] = WORD
for _first, _last in ("09", "AZ", "az"):
    KINDS[ord(_first) : ord(_last) + 1] = WORD


def words(texts: pa.Array, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(row of the word table, number of its text) of each word of the texts, in order."""
    raw, offsets = text_buffer(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = KINDS[raw]
    begins = np.ones(len(raw), bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    hashes = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers(0x9E3779B97F4A7C15, int(lengths.max()))[place], starts)
    used = kinds[starts] != SPACE
    at = (mix(hashes[used]) % np.uint64(rows)).astype(np.int64)
    return at, np.searchsorted(offsets, starts[used], side="right") - 1


def index_vectors(rows: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), both (rows, ONES): the index vector of each row, from its number alone."""
    drawn = mix(np.arange(1, rows * ONES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(rows, ONES)
    return (drawn % np.uint64(dim)).astype(np.int64), np.where(drawn >> np.uint64(63), 1.0, -1.0)


@dataclass
class Words:
    """Unit context vectors without their common part, and the weight of each row."""

    vectors: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, contexts: np.ndarray) -> Words:
        length = np.sqrt((contexts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        unit = contexts / np.maximum(length, 1.0)
        common = (unit * counts[:, None]).sum(axis=0) / max(counts.sum(), 1)
        return cls((unit - common).astype(np.float32), np.log1p(counts.sum() / np.maximum(counts, 1)).astype(np.float32))

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """A row of features per text; texts without words have zeros."""
        rows, dim = self.vectors.shape
        out = np.zeros((len(texts), 2 * dim + 3), np.float32)
        at, doc = words(texts, rows)
        if not len(at):
            return out
        n = np.bincount(doc, minlength=len(texts))
        again = np.bincount(doc[1:][(at[1:] == at[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
        keys, times = np.unique(doc * rows + at, return_counts=True)
        row, of = keys % rows, keys // rows
        present, first, different = np.unique(of, return_index=True, return_counts=True)
        for begin, weight in ((0, self.weights[row] * times), (dim, self.weights[row])):
            total = np.add.reduceat(weight, first)
            out[present, begin : begin + dim] = np.add.reduceat(self.vectors[row] * weight[:, None], first, axis=0) / total[:, None]
        out[present, -3:] = np.stack([np.log1p(n[present]), different / n[present], again[present] / n[present]], axis=1)
        return out


def word_table(documents: DataFrame, text: str = "text", rows: int = ROWS, dim: int = DIM) -> Words:
    """Context vectors and counts of all words of all texts. A task adds up its own texts in
    ``rows`` x ``dim`` sums, Spark adds the tasks; the driver gets the table."""
    spark = documents.sparkSession
    small_batches(spark)
    places, signs = index_vectors(rows, dim)
    columns = [f"c{i}" for i in range(dim)]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(rows), np.zeros(rows * dim)
        for batch in batches_of(batches, BATCH_BYTES):
            at, doc = words(batch.column(0), rows)
            counts += np.bincount(at, minlength=rows)
            for gap in range(1, WINDOW + 1):
                near = np.flatnonzero(doc[gap:] == doc[:-gap])
                for word, other in ((at[near], at[near + gap]), (at[near + gap], at[near])):
                    for k in range(ONES):
                        sums += np.bincount(word * dim + places[other, k], signs[other, k], rows * dim)
        used = np.flatnonzero(counts)
        table = sums.reshape(rows, dim)[used].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used].astype(np.int64)), *[pa.array(table[:, i]) for i in range(dim)]], names=["at", "n", *columns])

    fields = "at long, n long, " + ", ".join(f"{c} long" for c in columns)
    parts = documents.select(F.col(text).cast("string").alias("text")).where("text <> ''").mapInArrow(gathered, fields)
    found = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", *columns)]).toPandas()
    counts, contexts = np.zeros(rows), np.zeros((rows, dim))
    at = found["at"].to_numpy()
    counts[at], contexts[at] = found["n"].to_numpy(), found[columns].to_numpy()
    return Words.of(counts, contexts)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Network:
    """Features are standardised; tanh(x A + a) B + b is the logit, divided by the temperature."""

    mean: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.spread
        return np.tanh(x @ self.first + self.first_bias) @ self.second + self.second_bias

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return logistic(self.logits(features) / self.temperature)


def fit(features: np.ndarray, labels: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, batch: int = 256, rate: float = 3e-3, penalty: float = 1e-4) -> Network:
    """Both layers by Adam on the mean cross entropy, over a fixed order of the rows."""
    rng = np.random.default_rng(12)
    features = features.astype(np.float64)
    mean, spread = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-6)
    x, y, width = (features - mean) / spread, labels.astype(np.float64), features.shape[1]
    params = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for begin in range(0, len(x), batch):
            xs, ys = x[order[begin : begin + batch]], y[order[begin : begin + batch]]
            inner = np.tanh(xs @ params[0] + params[1])
            error = (logistic(inner @ params[2] + params[3]) - ys) / len(xs)
            back = np.outer(error, params[2]) * (1 - inner**2)
            gradients = [xs.T @ back + penalty * params[0], back.sum(axis=0), inner.T @ error + penalty * params[2], error.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(gradients):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, spread, params[0], params[1], params[2], float(params[3][0]))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross entropy, by narrowing an interval of its logarithm. The
    cross entropy is convex in 1 / temperature, so it has one valley. Targets are drawn in from 0
    and 1 as by one more row of either kind, or rows told apart without error would have no least."""
    ones = labels.sum()
    labels = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        return float((np.logaddexp(0.0, z) - labels * z).mean())

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(80):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    words: Words
    network: Network | None
    share: float  # the score if there is no network

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.probabilities(self.words.pooled(texts))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def train(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS,
    rows: int = ROWS, dim: int = DIM,
) -> Model:
    """Word vectors from all ``documents``; the network from at most ``sample_rows`` labelled ids
    with a remainder other than 0, chosen by a hash of the id: remainder 1 sets the temperature,
    the others the weights. Labels that are null or contradict each other for one id are left out,
    and so are null ids; of rows that repeat an id, one counts. Without labels of both kinds there
    is no network, and every score is the share of label 1 (0.5 without labels)."""
    table = word_table(documents, text, rows, dim)
    agreed = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").where(remainder(F.col("_id")) != 0)
    )
    chosen = stored(agreed.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).select("_id", "_y", remainder(F.col("_id")).alias("_r")), "labelled")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, BATCH_BYTES):
            got = table.pooled(batch.column(3))
            offsets = pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(got.ravel()))], names=["_id", "_y", "_r", "f"])

    sample = documents.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_t")).join(F.broadcast(chosen), "_id")  # at most sample_rows ids
    kind = documents.schema[doc_id].dataType.simpleString()
    got = sample.select("_id", "_y", "_r", "_t").mapInArrow(featured, f"_id {kind}, _y int, _r int, f array<float>")
    got = got.groupBy("_id").agg(F.min(F.struct("_y", "_r", "f")).alias("s")).select("_id", "s.*").toPandas().sort_values("_id", kind="stable")
    y = got["_y"].to_numpy(dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return Model(table, None, float(y.mean()) if len(y) else 0.5)
    x, calibration = np.stack(got["f"].to_numpy()), got["_r"].to_numpy() == 1
    enough = len(set(y[calibration].tolist())) == 2 and len(set(y[~calibration].tolist())) == 2
    network = fit(x[~calibration], y[~calibration]) if enough else fit(x, y)
    if enough:
        network.temperature = fit_temperature(network.logits(x[calibration]), y[calibration])
    return Model(table, network, float(y.mean()))


def score(documents: DataFrame, model: Model, text: str = "text", keep: tuple = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns ``keep`` and the probability of label 1 for the whole text, in ``out``. Null and
    empty texts are scored as texts without words; repeated rows get equal scores."""
    small_batches(documents.sparkSession)
    fields = [documents.schema[c] for c in keep]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, BATCH_BYTES):
            values = np.clip(model.scores(batch.column(batch.num_columns - 1)), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], names=[*batch.schema.names[:-1], "p"])

    schema = T.StructType([*[T.StructField(f"k{i}", f.dataType, True) for i, f in enumerate(fields)], T.StructField("p", T.DoubleType())])
    carried = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    return carried.mapInArrow(scored, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("p").alias(out))


def judge(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", least: float = LEAST_SCORE, **sample,
) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score and predicted (1 if the score is
    ``least`` or more)."""
    model = train(documents, labels, doc_id, text, label, **sample)
    rows = score(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
