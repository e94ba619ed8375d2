"""The operators' queries against SQL or invariants on the smallest tables, and the pipeline."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from panelyard.llm.common import new_folder  # noqa: E402
from panelyard.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()
KEYS = {"op7_embedding_dedup": ("embeddings", "vec_id"), "op9_warc": ("pages", "page_id")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    return repr(v) if v is None or isinstance(v, (str, bool)) else repr(float(v))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLES:
        done = duck.execute(ORACLES[name])
        columns = [d[0] for d in done.description]
        assert sorted(columns) == sorted(df.columns)
        expected = sorted(tuple(shown(r[columns.index(c)]) for c in sorted(columns)) for r in done.fetchall())
        assert sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in rows) == expected
    elif name != "op10_chat_format":
        table, key = KEYS.get(name, ("documents", "doc_id"))
        assert sorted(r[key] for r in rows) == [x for (x,) in duck.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]


def test_pipeline(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        path = new_folder(spark, "test-stage")
        made.write.parquet(path)
        after = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        counts.append(after.count())
        docs = after
    assert counts[0] >= counts[1] >= counts[2] == counts[3] >= counts[4] == counts[5] > 0.7 * counts[0]
    assert docs.where("not round_trip").count() == 0
    clean = {x for (x,) in duck.execute("SELECT doc_id FROM labels WHERE toxic = 0").fetchall()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id").collect()}
    assert len(clean - kept) <= 0.05 * len(clean)  # too few labels here to tell how many toxic rows go


def test_pipeline_odd_rows(spark):
    """Nulls, empty texts, repeated rows and extra columns pass every stage."""
    odd = [(None, None, None, "s", None), (1, "", "en", "s", 0), (2, None, "en", None, 3), (2, None, "en", None, 3), (None, "some words here", "en", "s", 15)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in odd], "doc_id long, text string, lang string, source string, n_chars long, id int, _i string")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
            assert made.count() == len(odd)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
