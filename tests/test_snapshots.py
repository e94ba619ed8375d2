"""Build from raw exports, commit, carry forward, compare, rebuild and delete."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.operators import catalog as C
from panelyard.operators import history as H
from panelyard.operators import quality as Q
from panelyard.operators import views as V
from panelyard.plans import build as B
from panelyard.sources import ingest as I
from panelyard.sources import snapshots as S
from panelyard.sources import tables as T

NAMES = ["x_tradingview_2026-08-20.csv", "total-market-all-data.csv", "Qtr_Profit_Data.csv", "Yearly_Profit_Data.csv"]


def raw_base(spark, bump=0.0, n=40):
    tiers = [t for t, _ in K.TIER_TAGS]
    rows = []
    for i in range(n):
        rows.append((
            f"IN{i:03d}", f"SYM{i}", f"Name {i}", "Finance" if i % 4 == 0 else "Energy", "Banks", f"{tiers[i % 4]}, Nifty Alpha 50" if i % 5 else None,
            1000.0 + i, 100.0 + i + bump, "INR", 100.0 + i + bump, 90.0 + i, 80.0, 70.0, 20.0 - i, 5.0, 15.0 + i if i % 3 else None,
            float(i), 12.0, "Buy" if i % 2 else "Sell", "Strong sell", 10.0 if i < 3 else None,
        ))
    schema = (
        "isin string, Symbol string, Description string, Sector string, Industry string, Index string, `Market capitalization` double, Price double, "
        "`Price - Currency` string, `Price.1` double, `Exponential moving average, 20, 1 day` double, `Exponential moving average, 50, 1 day` double, "
        "`Exponential moving average, 200, 1 day` double, `Performance %, 1 year` double, `Performance %, 1 month` double, `Price to earnings ratio` double, "
        "`Return on capital employed %, Annual` double, `Revenue per share, Trailing 12 months` double, `Analyst rating` string, `Technical rating, 1 day` string, "
        "`Net revenue, Trailing 12 months` double"
    )
    return spark.createDataFrame(rows, schema)


def raw_secondary(spark, n=45):
    rows = [(f"IN{i:03d}", f"N{i}", 100.0 + i, 20.0 + i, float(i % 7), None) for i in range(2, n)]
    return spark.createDataFrame(rows, "isin string, Name string, `Current Price` double, `Price to Earning` double, `FII holding` double, `Credit rating` string")


def profit(spark, n=40):
    q = [(f"IN{i:03d}", *[float(100 - j if i % 2 else 50 + j) if j < 10 else 0.0 for j in range(48)]) for i in range(n)]
    y = [(f"IN{i:03d}", 1.0, *[float(300 - j) if j < 4 else 0.0 for j in range(15)]) for i in range(n)]
    return (
        spark.createDataFrame(q, "isin string, " + ", ".join(f"QL{i} double" for i in range(1, 49))),
        spark.createDataFrame(y, "isin string, TTM double, " + ", ".join(f"FYL{i} double" for i in range(1, 16))),
    )


def at():
    return F.lit("2026-08-21 07:00:00")


def supplied(spark, bump=0.0, day="20", profit_too=True):
    out = {"tradingview": (f"x_tradingview_2026-08-{day}.csv", raw_base(spark, bump)), "screener": ("total-market-all-data.csv", raw_secondary(spark))}
    if profit_too:
        q, y = profit(spark)
        out.update(profit_q=("Qtr_Profit_Data.csv", q), profit_y=("Yearly_Profit_Data.csv", y))
    return out


@pytest.fixture(scope="module")
def built(spark):
    q, y = profit(spark)
    return B.build(raw_base(spark), raw_secondary(spark), q, y)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    first = B.commit(spark, path, supplied(spark), at(), "2026-08-25", low=10, high=50)
    second = B.commit(spark, path, supplied(spark, 5.0, "21", profit_too=False), at(), "2026-08-25", low=10, high=50)
    return path, first, second


def test_build(spark, built):
    df = built.companies.cache()
    assert df.count() == 40 and df.select("isin").distinct().count() == 40
    columns = set(df.columns)
    assert {"cap_tier", "idx_nifty_alpha_50", "is_alpha", "price_screener", "pat_ttm", "pat_cagr_3y_pct", "pat_both_at_ath", "dist_ema_200_pct", "momentum_12_1_pct", "pct_rank_pe_ratio_in_tier"} <= columns
    assert not {"price_currency", "credit_rating", "name_sc"} & columns
    row = df.where("isin = 'IN001'").first()
    assert (row.pat_ttm, row.qtrs_available, row.pat_q_at_ath, row.pat_ttm_at_ath, row.pat_both_at_ath) == (394.0, 10, True, True, True)
    assert (row.cap_tier, row.ema_stack_bullish, row.shares_implied, row.rating_conflict) == ("Mid", True, 1001.0 / 101.0, True)
    assert df.where("isin = 'IN000'").first().price_screener is None
    reasons = {r.column: r.reason for r in built.ledger.collect()}
    assert reasons["Price.1"] == "duplicate" and reasons["Net revenue, Trailing 12 months"] == "low_coverage"
    assert built.profit_quarterly.count() == 400 and built.profit_annual.count() == 160
    check = built.checks[0].first()
    assert check.field == "Net revenue, Trailing 12 months" and check.n_overlap == 3
    # Cohorts split as they must.
    from panelyard.operators import groups as G
    c = G.record_profit_counts(df).first()
    assert c.ttm_only + c.both_at_ath == c.ttm_at_ath and c.q_only + c.both_at_ath == c.q_at_ath


def test_report_and_catalog(spark, built):
    df = built.companies
    meta = spark.createDataFrame([("price", "Price", "Performance", "Main", "", "none", "tradingview", "reported", "inr", "0.2f", "neutral", "")], C.METADATA)
    cat = C.build(df, meta).cache()
    assert cat.count() == len(df.columns)
    rows = {r.name: r for r in cat.collect()}
    assert not rows["roce"].finance_valid and rows["idx_nifty_alpha_50"].screenable and not rows["symbol"].screenable
    assert rows["pat_cagr_7y_pct"].coverage_pct == 0.0 and rows["pat_cagr_7y_pct"].flags == ["low_coverage_0pct"]
    report = Q.build_report(df, cat, built.ledger, built.checks)
    assert report["totals"].first().columns_retained == len(df.columns)
    assert report["sector_masking"].first().finance_companies == 10
    depth = {r.series: r for r in report["history_depth"].collect()}
    assert depth["quarterly PAT"].median_available == 10.0 and depth["annual PAT"].under_half_n == 40
    assert sum(r.n for r in report["drop_reasons"].collect()) == built.ledger.count()
    conflicts = {r.concept: r for r in report["source_conflicts"].collect()}
    assert conflicts["Price"].n_overlap == 38 and conflicts["Price"].resolution == "primary"


def test_views(spark, built):
    df = built.companies
    cat = C.build(df, spark.createDataFrame([
        ("pe_ratio", "P/E", "Valuation", "M", "", "none", "t", "reported", "ratio", "0.2f", "lower_better", ""),
        ("roce", "ROCE", "Profitability", "M", "", "none", "t", "reported", "pct", "0.1f%", "higher_better", ""),
        ("market_cap", "Size", "Overview", "M", "", "none", "t", "reported", "inr", "cr", "neutral", "")], C.METADATA))
    out = {r.name: r for r in V.compare(df, cat, ["sym5", "SYM1", "SYM4", "absent"]).collect()}
    assert out["pe_ratio"]["values"] == [20.0, 16.0, 19.0] and out["pe_ratio"].best_index == 1
    assert out["roce"]["values"] == [5.0, 1.0, None] and out["roce"].best_index == 0
    assert out["market_cap"].best_index is None and "pat_cagr_7y_pct" not in out and "is_alpha" not in out
    assert out["pe_ratio"].spread == pytest.approx(0.2)
    assert [r.symbol for r in V.missing_symbols(df, ["sym5", "absent"]).collect()] == ["absent"]
    for bad in (["a"], list("abcdefg")):
        with pytest.raises(ValueError):
            V.compare(df, cat, bad)
    card = {r.name: r.value for r in V.card(df, cat, "sym4").collect()}
    assert card["roce"] is None and card["symbol"] == "SYM4" and not any(n.startswith(("idx_", "pct_rank")) for n in card)
    ranks = {r.metric: r for r in V.card_ranks(df, "SYM4").collect()}
    assert 0 < ranks["pe_ratio"].universe <= 100 and ranks["roce"].tier is not None
    assert {r.tag for r in V.card_memberships(df, "SYM4").collect()} == {"idx_nifty_100", "idx_nifty_alpha_50"}
    assert [r.field for r in V.card_masked(df, "SYM4").collect()] == ["roce"]


def test_commit_and_carry_forward(spark, store):
    path, first, second = store
    assert (first["snapshot_date"], first["universe"], first["replaced"]) == ("2026-08-20", 40, False)
    assert second["sources"]["profit_q"] == {"from_snapshot": "2026-08-20", "filename": "Qtr_Profit_Data.csv", "carried_forward": True}
    history = S.read_table(spark, f"{path}/companies")
    assert dict(history.dtypes)["snapshot_date"] == "date" and history.count() == 80
    assert S.list_snapshots(spark, f"{path}/companies") == ["2026-08-20", "2026-08-21"]
    assert {r.companies for r in H.snapshot_counts(history).collect()} == {40}
    described = {str(r.snapshot_date): r.carried_forward for r in S.describe(S.read_provenance(spark, path)).collect()}
    assert described == {"2026-08-20": [], "2026-08-21": ["profit_q", "profit_y"]}
    assert S.sizes(spark, path).where("size_kb > 0").count() == 2
    delta = H.changes(history, "price", *H.resolve_pair(history)).collect()
    assert {r.delta for r in delta} == {5.0} and len(delta) == 15


def test_reads_are_pruned_to_one_partition(spark, store):
    history = S.read_table(spark, f"{store[0]}/companies")
    for df in (S.latest(history), S.as_of(history, "2026-08-20")):
        assert df.count() == 40
        scan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(snapshot_date" in scan and "(snapshot_date#" in scan
    for bad in ("2026-08-19", "yesterday"):
        with pytest.raises(S.SnapshotError):
            S.as_of(history, bad)


def test_refusals(spark, store):
    path = store[0]
    again = supplied(spark)
    for kwargs, files in (
        ({}, again),  # date exists
        ({"date": "2026-08-24"}, again),  # same content as an earlier day
        ({"date": "2026-08-24"}, supplied(spark, 9.0, "24")),  # row-count band below
        ({"date": "2026/08/24"}, again),
        ({}, {}),
    ):
        band = {"low": 100, "high": 200} if "24" in str(files.get("tradingview", "")) else {"low": 10, "high": 50}
        with pytest.raises(S.SnapshotError):
            B.commit(spark, path, files, at(), "2026-08-25", **kwargs, **band)
    assert S.list_snapshots(spark, f"{path}/companies") == ["2026-08-20", "2026-08-21"]
    with pytest.raises(S.SnapshotError):
        B.commit(spark, path + "_empty", supplied(spark, profit_too=False), at(), "2026-08-25", low=1, high=99)


def test_preview(spark, store):
    path = store[0]
    files = supplied(spark, profit_too=False)
    frames = {s: f for s, (_, f) in files.items()}
    seen = B.preview(spark, path, NAMES[:2], frames, "2026-08-25")
    assert seen["ok"] and seen["already_exists"] and seen["duplicate_of"] == "2026-08-20" and seen["snapshots_held"] == 2
    assert seen["carried_forward"] == {"profit_q": "2026-08-20", "profit_y": "2026-08-20"}
    assert not B.preview(spark, path, ["what.txt"], {}, "2026-08-25")["ok"]
    assert not B.preview(spark, path + "_none", NAMES[:2], frames, "2026-08-25")["ok"]


def test_classify_and_dates():
    assert S.classify(NAMES[::-1]) == dict(zip(["tradingview", "screener", "profit_q", "profit_y"], NAMES))
    assert S.resolve_date({"tradingview": "Total_Market_20260820_x.csv"}, None, "2026-01-01") == "2026-08-20"
    assert S.resolve_date({"tradingview": "a_2026-13-45.csv"}, None, "2026-01-01") == "2026-01-01"


def test_content_hash_ignores_row_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    a = S.content_hash(df).first()
    assert a == S.content_hash(df.orderBy(F.col("id").desc()).repartition(7)).first()
    assert a != S.content_hash(df.withColumn("v", F.col("v") + (F.col("id") == 3).cast("int"))).first()
    assert a != S.content_hash(df.union(df.limit(1))).first()


def test_stray_folders_are_no_snapshots(spark, store, tmp_path):
    df = spark.range(3)
    for name in ("snapshot_date=2026-08-20", "snapshot_date=notadate", ".backup_2026-08-19"):
        df.write.parquet(str(tmp_path / "t" / name))
    path = str(tmp_path / "t")
    assert S.list_snapshots(spark, path) == ["2026-08-20"]
    assert [str(r[0]) for r in S.snapshot_dates(S.read_table(spark, path)).collect()] == ["2026-08-20"]


def test_union_by_name(spark):
    out = S.union_by_name([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "c int, a int")])
    assert [tuple(r) for r in out.select("a", "b", "c").orderBy("a").collect()] == [(1, 2, None), (4, None, 3)]


def test_replace_keeps_the_old_version_on_failure(spark, tmp_path):
    path = str(tmp_path / "state")
    T.replace(spark.range(3), path)
    bad = spark.range(5).select((F.col("id") / F.lit(1)).cast("bigint").alias("id"), F.assert_true(F.col("id") < 4).alias("x"))
    with pytest.raises(Exception):
        T.replace(bad, path)
    assert T.read_current(spark, path, "id bigint").count() == 3
    T.replace(T.read_current(spark, path, "id bigint").limit(1), path)
    assert T.read_current(spark, path, "id bigint").count() == 1
    T.replace(spark.range(9), path)
    assert len(T.versions(spark, path)) == 3 and len(T.prune(spark, path, 1)) == 2
    assert T.read_current(spark, path, "id bigint").count() == 9


def test_symbol_rename_keeps_the_series(spark):
    h = spark.createDataFrame(
        [("I1", "OLD", dt.date(2026, 8, 20), -50.0), ("I1", "NEW", dt.date(2026, 8, 21), -25.0), ("I2", "X", dt.date(2026, 8, 21), 1.0)],
        "isin string, symbol string, snapshot_date date, price double")
    assert [r.price for r in H.entity_series(h, "new", ["price"]).collect()] == [-50.0, -25.0]
    r = H.first_to_last(h, "price").where("isin = 'I1'").first()
    assert r.change_pct == -150.0
    with pytest.raises(ValueError):
        H.resolve_pair(h.where("snapshot_date = DATE'2026-08-20'"))


def test_rebuild_and_delete(spark, store):
    path = store[0]
    before = S.read_table(spark, f"{path}/companies").orderBy("snapshot_date", "isin").drop("x").toPandas()
    assert B.rebuild_all(spark, path, F.lit("2026-08-26 00:00:00"), 10, 50) == ["2026-08-20", "2026-08-21"]
    after = S.read_table(spark, f"{path}/companies").orderBy("snapshot_date", "isin").toPandas()
    assert before.equals(after[before.columns])
    assert S.read_provenance(spark, path).where("built_at = TIMESTAMP'2026-08-26 00:00:00'").count() == 8
    assert S.delete(spark, path, "2026-08-20") == ["2026-08-21"]
    assert S.list_snapshots(spark, f"{path}/companies") == ["2026-08-21"]
    for bad in ("2026-08-21", "2026-08-20"):
        with pytest.raises(S.SnapshotError):
            S.delete(spark, path, bad)
    assert I.feed_status(F.lit("2026-08-21 06:00:00").cast("timestamp"), F.lit("2026-08-21 12:00:00").cast("timestamp"))
