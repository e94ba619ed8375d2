import pytest
from pyspark.sql import functions as F

from panelyard.operators import screen as S

ROWS = [
    ("AAA", "Alpha Ltd", "Finance", "Large", 900.0, 12.0, 30.0, True),
    ("AAB", "Beta aaa", "Energy", "Mid", 500.0, None, 10.0, False),
    ("BBB", "Gamma", "Energy", "Small", None, 8.0, None, None),
    ("CCC", "Delta 100%", "Finance", "Large", 100.0, 25.0, -5.0, True),
    ("AA", "Short", None, "Micro", 50.0, 1.0, 2.0, False),
]
SCHEMA = "symbol string, name string, sector string, cap_tier string, market_cap double, roce double, perf_1y_pct double, flag boolean"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def names(frame):
    return [r.symbol for r in frame.collect()]


def count(df, *filters):
    return S.where_all(df, filters).count()


def test_null_and_not_null_split_the_rows(df):
    for c in ("roce", "market_cap", "sector"):
        assert count(df, (c, "is_null")) + count(df, (c, "not_null")) == len(ROWS)


def test_in_and_not_in_leave_out_nulls(df):
    assert count(df, ("sector", "in", ["Finance"])) + count(df, ("sector", "not_in", ["Finance"])) == count(df, ("sector", "not_null"))


def test_between_is_two_bounds(df):
    assert count(df, ("roce", "between", [8, 25])) == count(df, ("roce", "gte", 8), ("roce", "lte", 25)) == 3


def test_a_filter_never_adds_rows(df):
    assert count(df, ("roce", "gt", 5), ("flag", "eq", True)) <= count(df, ("roce", "gt", 5))


def test_ne_drops_nulls(df):
    assert names(S.where_all(df, [("sector", "ne", "Finance")]).orderBy("symbol")) == ["AAB", "BBB"]


def test_contains_ignores_case_and_keeps_wildcards(df):
    assert set(names(S.where_all(df, [("name", "contains", "AAA")]))) == {"AAB"}
    assert set(names(S.where_all(df, [("name", "contains", "g_mma")]))) == {"BBB"}


@pytest.mark.parametrize("bad", [
    ("nope", "eq", 1), ("roce", "like", 1), ("roce", "between", [1]), ("roce", "between", 3), ("roce", "in", []), ("roce", "in", 3),
    ("roce", "eq", None), ("roce", "gt", [1, 2]), ("roce", "eq"),
])
def test_bad_filters(df, bad):
    with pytest.raises(ValueError):
        S.where_all(df, [bad])


def test_order_puts_nulls_last_both_ways(df):
    assert names(S.order_by(df, [("market_cap", "asc")]))[-1] == "BBB"
    assert names(S.order_by(df))[-1] == "BBB"
    with pytest.raises(ValueError):
        S.order_by(df, [("roce", "up")])


def test_paging(df):
    full = names(S.order_by(df, tiebreak="symbol"))
    pages = [names(S.page(S.order_by(df, tiebreak="symbol"), 2, i)) for i in (0, 2, 4)]
    assert sum(pages, []) == full
    for limit, offset in ((0, 0), (751, 0), (1, -1)):
        with pytest.raises(ValueError):
            S.page(df, limit, offset)


def test_mask_comes_after_filter_and_sort(df):
    out = S.screen(df, [("roce", "gt", 5)], [("roce", "desc")], ["symbol", "roce"], mask=True).collect()
    assert [r.symbol for r in out] == ["CCC", "AAA", "BBB"]
    assert [(r.roce, r._masked_fields) for r in out] == [(None, ["roce"]), (None, ["roce"]), (8.0, [])]
    assert all(r.sector is not None for r in out)


def test_mask_names_only_what_it_hid(spark):
    df = spark.createDataFrame([("Finance", None, 2.0), ("Finance", 1.0, 2.0)], "sector string, roce double, current_ratio_annual double")
    rows = S.mask_sector(df).collect()
    assert [r._masked_fields for r in rows] == [[], ["roce"]] and rows[1].current_ratio_annual == 2.0


def test_search_ranks_exact_then_prefix_then_anywhere(df):
    assert names(S.search(df, "aa")) == ["AA", "AAA", "AAB"]
    assert names(S.search(df, "aaa")) == ["AAA", "AAB"]
    with pytest.raises(ValueError):
        S.search(df, "")


def test_prefix_lookup_and_movers(df):
    assert names(S.prefix_search(df, "aa")) == ["AA", "AAA", "AAB"]
    assert names(S.by_symbol(df, "bbb")) == ["BBB"]
    moved = S.movers(df, n=2).collect()
    assert [(r.symbol, r.side) for r in moved] == [("AAA", "top"), ("AAB", "top"), ("CCC", "bottom"), ("AA", "bottom")]
    assert names(S.movers(df, "market_cap", 5, "Large").where("side = 'top'")) == ["AAA", "CCC"]
    with pytest.raises(ValueError):
        S.movers(df, "name")


def test_export(df):
    specs = [{"name": "symbol", "label": "Symbol", "unit": "text"}, {"name": "market_cap", "label": "Size", "unit": "inr", "fmt": "cr"},
             {"name": "flag", "label": "Flag", "unit": "bool"}, {"name": "roce", "label": "ROCE", "unit": "pct", "fmt": "0.1f%"}]
    rows = S.export_frame(S.mask_sector(df.withColumn("market_cap", F.col("market_cap") * 1e7)), specs).collect()
    assert rows[0].asDict() == {"Symbol": "AAA", "Size (₹ Cr)": "900.0", "Flag": "Yes", "ROCE": "n/a"}
    assert rows[2]["Flag"] is None and rows[1]["Flag"] == "No" and rows[2]["ROCE"] == "8.0"


def test_filter_reaches_the_parquet_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = S.where_all(orders, [("o_totalprice", "gt", 1e5), ("o_orderstatus", "in", ["F"])]).select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in text
    assert "o_orderdate" not in text.split("ReadSchema")[1]
