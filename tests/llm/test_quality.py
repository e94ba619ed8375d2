"""The quality classifier: its parts against brute force, its accuracy on rows it has not seen."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelyard.llm import quality

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20\x7f]+")
DOCS = "doc_id long, text string, score double, t string, k0 int, _id int"  # the last four clash with names used inside


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "t", 1, 2) for i, t in rows], DOCS)


def row_of(word, rows):
    x = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor % (1 << 64)
    return (x ^ (x >> 31)) % rows


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = ["uno", "DOS", "tres,", "ñandú", "a|b", "!!", "--", "x1", "Ü", "\t", "\n\n", "e.g.", "日本", "z" * 900]
    made = [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    return [*made, "", None, "   ", "!", "a", " a", "a a a a", "words " * 9000, "end\x00\x7fof"]


def tokens(text):
    return TOKEN.findall((text or "").encode())


def test_words(texts):
    at, doc = quality.words(pa.array(texts, pa.string()), 997)
    expected = [(row_of(w, 997), i) for i, t in enumerate(texts) for w in tokens(t)]
    assert list(zip(at.tolist(), doc.tolist(), strict=True)) == expected
    assert len(quality.words(pa.array([], pa.string()))[0]) == 0
    assert len(quality.words(pa.array(["", None], pa.string()))[0]) == 0


def test_word_table_and_pooling(spark, texts):
    rows, dim = 211, 8
    places, signs = quality.index_vectors(rows, dim)
    counts, contexts = np.zeros(rows), np.zeros((rows, dim))
    for t in texts:
        found = [row_of(w, rows) for w in tokens(t)]
        for i, w in enumerate(found):
            counts[w] += 1
            for j in range(max(i - 2, 0), min(i + 3, len(found))):
                if j != i:
                    for p, s in zip(places[found[j]], signs[found[j]], strict=True):
                        contexts[w, p] += s
    table = quality.word_table(docs_frame(spark, enumerate(texts)).repartition(3), rows=rows, dim=dim)
    expected = quality.Words.of(counts, contexts)
    assert np.allclose(table.vectors, expected.vectors, atol=1e-6) and np.allclose(table.weights, expected.weights)
    got = table.pooled(pa.array(texts, pa.string()))
    for t, features in zip(texts, got, strict=True):
        found = [row_of(w, rows) for w in tokens(t)]
        if not found:
            assert not features.any()
            continue
        weight = np.array([expected.weights[w] for w in found])
        different = sorted(set(found))
        rare = np.array([expected.weights[w] for w in different])
        assert np.allclose(features[:dim], (expected.vectors[found] * weight[:, None]).sum(axis=0) / weight.sum(), atol=1e-4)
        assert np.allclose(features[dim : 2 * dim], (expected.vectors[different] * rare[:, None]).sum(axis=0) / rare.sum(), atol=1e-4)
        again = sum(a == b for a, b in zip(found, found[1:], strict=False))
        assert np.allclose(features[2 * dim :], [np.log1p(len(found)), len(different) / len(found), again / len(found)], atol=1e-5)


def test_network_learns_what_is_not_linear():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = quality.fit(x[:3000], y[:3000])
    assert ((net.probabilities(x[3000:]) > 0.5) == (y[3000:] == 1)).mean() > 0.95


def test_temperature_calibrates():
    """Logits drawn out threefold get a temperature near 3; a grid finds nothing better."""
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < quality.logistic(z)).astype(float)
    found = quality.fit_temperature(3 * z, y)
    assert abs(found - 3) < 0.15
    loss = lambda t: (np.logaddexp(0, 3 * z / t) - y * 3 * z / t).mean()
    assert loss(found) <= min(loss(t) for t in np.linspace(0.5, 8, 200)) + 1e-5
    apart = quality.fit_temperature(np.array([-5.0] * 40 + [5.0] * 40), np.array([0.0] * 40 + [1.0] * 40))
    assert 0.5 < apart < 5  # no certainty from rows that are told apart without error


def test_held_out_accuracy(spark):
    """Half of the usual training labels are hidden; the model judges those rows well."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    hidden = F.xxhash64("doc_id") % 2 == 0
    got = quality.judge(docs, labels.where(~hidden)).join(labels.where(hidden), "doc_id").collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in got)
    assert len(got) > 20 and right >= 0.85 * len(got)
    low, high = ([r["score"] for r in got if r["quality"] == q] for q in (0, 1))
    assert sum(a < b for a in low for b in high) >= 0.95 * len(low) * len(high)


def test_labels_of_held_out_rows_are_not_read(spark):
    """Turning the labels of remainder 0 around changes nothing; scores do not depend on ids or other columns."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["good", "fine", "well"] if i % 2 else ["BAD!!", "###", "x|"]) for _ in range(30))) for i in range(200)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    schema = "doc_id long, quality int, text string"
    one = quality.judge(docs_frame(spark, rows), spark.createDataFrame([(i, i % 2, "") for i, _ in rows], schema)).collect()
    two = quality.judge(docs_frame(spark, rows), spark.createDataFrame([(i, (i % 2) ^ held(i), "") for i, _ in rows], schema)).collect()
    assert sorted(one) == sorted(two)
    assert all(r["held_out"] == held(r["doc_id"]) for r in one)
    assert all(r["predicted"] == (r["doc_id"] % 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in one)


def test_odd_rows(spark):
    long = "word " * 50_000
    rows = [(1, "some words here"), (1, "some words here"), (2, None), (2, ""), (None, "no id"), (None, None), (3, long), (4, "BAD!! BAD!!"), (6, "BAD!! BAD!!")]
    labels = [(1, 1), (2, 1), (3, 1), (3, 0), (4, 0), (None, 1), (5, None), (6, 0), (7, 0), (99, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.judge(docs_frame(spark, rows), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1,)}) == 1 and len({r["score"] for r in found if r["doc_id"] == 2}) == 1
    # no labels, labels of one kind, no documents
    assert {r["score"] for r in quality.judge(docs_frame(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.judge(docs_frame(spark, rows), labels.where("quality = 0")).collect()} == {0.0}
    assert quality.judge(docs_frame(spark, rows).limit(0), labels).count() == 0
