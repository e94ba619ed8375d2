"""Every registered query against its SQL counterpart on the smallest tables."""

import datetime as dt
import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_spec = importlib.util.spec_from_file_location("spark_entry", f"{ROOT}/__spark_entry__.py")
entry = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry)
from workload.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return repr(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return repr(float(v))


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = rows(df.columns, df.collect())
    done = duck.execute(ORACLES[name])
    columns = [d[0] for d in done.description]
    assert sorted(columns) == sorted(df.columns)
    assert found == rows(columns, done.fetchall())


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
