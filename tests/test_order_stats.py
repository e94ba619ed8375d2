"""The bucketed forms against brute force, with one group holding most rows, heavy ties,
nulls and NaN."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelyard.operators import order_stats as O

random.seed(7)
ROWS = []
for i in range(3000):
    group = "hot" if i % 3 else random.choice(["a", "b", None, "c"])
    x = random.choice([None, float("nan"), 0.0, 0.0, 0.0, random.gauss(0, 1e3), float(random.randint(-3, 3))])
    y = 5.0 if i % 2 else random.expovariate(1e-6)
    ROWS.append((i, group, x, y))
SCHEMA = "k int, g string, x double, y double"
QUANTILES = {"x10": ("x", 0.1), "x50": ("x", 0.5), "x99": ("x", 0.99), "y50": ("y", 0.5), "y0": ("y", 0.0), "y100": ("y", 1.0)}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def pdf():
    out = pd.DataFrame(ROWS, columns=["k", "g", "x", "y"])
    out["x"] = out["x"].astype(float)
    return out


def expected(frame):
    return {o: frame[c].dropna().quantile(p) for o, (c, p) in QUANTILES.items()}


@pytest.mark.parametrize("buckets", [None, 1, 2, 16, 300])
def test_group_quantiles(df, pdf, buckets):
    wanted = {o: (F.col(c), p) for o, (c, p) in QUANTILES.items()}
    got = {r.g: r for r in O.aggregate(df, ["g"], {"n": F.count("*")}, wanted, buckets).collect()}
    assert set(got) == {"hot", "a", "b", "c", None}
    for g, row in got.items():
        part = pdf[pdf.g.isna()] if g is None else pdf[pdf.g == g]
        assert row.n == len(part)
        for o, v in expected(part).items():
            assert row[o] == pytest.approx(v, rel=1e-12, abs=1e-9), (g, o)


@pytest.mark.parametrize("buckets", [None, 16])
def test_global_quantiles(df, pdf, buckets):
    wanted = {o: (F.col(c), p) for o, (c, p) in QUANTILES.items()}
    row = O.aggregate(df, [], {"n": F.count("*")}, wanted, buckets).first()
    for o, v in expected(pdf).items():
        assert row[o] == pytest.approx(v, rel=1e-12, abs=1e-9)


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = O.aggregate(empty, [], {"n": F.count("*")}, {"m": O.median("x")}, 8).first()
    assert (row.n, row.m) == (0, None)
    nulls = spark.createDataFrame([(1, "a", None, 1.0), (2, "a", None, 2.0)], SCHEMA)
    row = O.aggregate(nulls, ["g"], {"n": F.count("*")}, {"m": O.median("x"), "y": O.median("y")}, 8).first()
    assert (row.n, row.m, row.y) == (2, None, 1.5)


@pytest.mark.parametrize("buckets", [1, 16])
def test_percentile_ranks(df, pdf, buckets):
    out = O.add_percentile_ranks(df, "k", ["x", "y", "absent"], {"group": "g"}, buckets)
    got = out.toPandas().set_index("k").sort_index()
    assert "pct_rank_absent" not in got.columns and len(got) == len(pdf)
    for m in ("x", "y"):
        universe = (pdf[m].rank(pct=True) * 100).to_numpy()
        grouped = (pdf.groupby("g")[m].rank(pct=True) * 100).to_numpy()
        np.testing.assert_allclose(got[f"pct_rank_{m}"].to_numpy(float), universe, rtol=1e-12)
        np.testing.assert_allclose(got[f"pct_rank_{m}_in_group"].to_numpy(float), grouped, rtol=1e-12)


def test_no_window_over_a_whole_group(df):
    """The bucketed plan orders values within a bucket only."""
    plan = O.aggregate(df, ["g"], {}, {"m": O.median("x")}, 8)._jdf.queryExecution().toString()
    ordered = [line for line in plan.splitlines() if "windowspecdefinition" in line and "v#" in line and " ASC" in line]
    assert ordered and all("b#" in line for line in ordered)
    assert "SinglePartition" not in plan


def test_a_frequent_value_is_spread(spark):
    """A third of all rows share one value; its rank is broadcast and its rows spread over salts."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("x"))
    plan = O.percentile_ranks(df, "id", ["x"], {"": None}, 64)._jdf.queryExecution().toString()
    assert "salt" in plan and "BroadcastHashJoin" in plan
    got = O.percentile_ranks(df, "id", ["x"], {"": None}, 64).toPandas().set_index("id").sort_index()
    want = df.toPandas().set_index("id").sort_index()["x"].rank(pct=True) * 100
    np.testing.assert_allclose(got["pct_rank_x"].to_numpy(), want.to_numpy(), rtol=1e-12)


def test_values_are_counted_once_and_ranges_hold_them_all(spark):
    """The stored counts have one row a value; ranges do not overlap, and the plan after them does
    not go back to the input."""
    df = spark.range(40_000).select((F.col("id") % 5000).cast("double").alias("x"), F.lit(0).alias("g"))
    counts = O._in_buckets(df.groupBy("g", F.col("x").alias("v")).agg(F.count("*").alias("c")), ["g", "v"], 16)
    parts = counts.groupBy("b").agg(F.min("v"), F.max("v"), F.sum("c")).orderBy("b").collect()
    assert len(parts) == 16 and sum(r[3] for r in parts) == 40_000
    assert all(p[2] < q[1] for p, q in zip(parts, parts[1:]))
    plan = O.aggregate(df, ["g"], {}, {"m": O.median("x")}, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1  # the plain aggregates' own pass


def test_columns_named_like_the_internals(df, pdf):
    odd = df.select(F.col("k").alias("v"), F.col("g").alias("m"), F.col("x").alias("n"))
    got = {r.m: r.b for r in O.aggregate(odd, ["m"], {"c": F.count("*")}, {"b": O.median("n")}, 8).collect()}
    assert got["hot"] == pytest.approx(pdf[pdf.g == "hot"].x.median())
    for buckets in (1, 8):
        ranks = O.percentile_ranks(odd, "v", ["n"], {"": None, "b": "m"}, buckets).toPandas().set_index("v").sort_index()
        want = (pdf.x.rank(pct=True) * 100).dropna()
        np.testing.assert_allclose(ranks["pct_rank_n"].to_numpy(), want.to_numpy(), rtol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=40), p=st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]), buckets=st.integers(1, 9))
def test_any_values(spark, values, p, buckets):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = O.aggregate(df, [], {"n": F.count("*")}, {"q": (F.col("x"), p)}, buckets).first().q
    assert got == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-6)
