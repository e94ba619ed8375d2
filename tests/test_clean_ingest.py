import json

import pytest
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.operators import clean as C
from panelyard.operators import matching as M
from panelyard.sources import ingest as I


def test_normalise_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "isin int, Price int, `Average daily range %` int, `R&D, Annual` int")
    assert C.normalise_names(df).columns == ["isin", "price", "adr_pct", "r_and_d_annual"]
    with pytest.raises(ValueError):
        C.normalise_names(spark.createDataFrame([(1, 2)], "`A b` int, `a-b` int"))


def test_drop_dead_columns(spark):
    rows = [(i, 1.0, "INR", 1.0, float(i), 2.0, None, 1 if i == 0 else None, 1 if i < 2 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "isin int, Price double, `Price - Currency` string, `Price.1` double, X double, `X.1` double, `Credit rating` string, Thin int, Kept int")
    kept, ledger = C.drop_dead_columns(df)
    assert kept.columns == ["isin", "Price", "X", "Kept"]
    got = {r.column: (r.reason, r.detail) for r in ledger.collect()}
    assert got == {
        "Price - Currency": ("currency", "all values INR"), "Price.1": ("duplicate", "re-export of 'Price'"),
        "X.1": ("duplicate", "re-export of 'X' (values differ; base kept)"), "Credit rating": ("empty", "no populated values"),
        "Thin": ("low_coverage", "10.0% populated"),
    }


def test_checks(spark):
    df = spark.createDataFrame([("a", "INR", 1), ("a", None, 2), (None, "USD", 3)], "ISIN string, `P - Currency` string, v int")
    assert {tuple(r) for r in C.currency_violations(df).collect()} == {("P - Currency", "USD", 1)}
    assert {r.rule: r.found for r in C.key_violations(df, "ISIN").collect()} == {"row_count": 3, "null_key": 1, "duplicate_key": 1}
    with pytest.raises(ValueError):
        I.load_base(df)
    with pytest.raises(ValueError):
        I.load_base(df.drop("ISIN"))
    good = spark.createDataFrame([("a", "INR"), ("b", None)], "ISIN string, `P - Currency` string")
    assert I.load_base(good, 1, 5).columns == ["isin", "P - Currency"]


def test_keep_first_with_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), (F.col("id") * 10).alias("v"), F.col("id").alias("at"))
    got = M.keep_first(df, "k", "at")
    assert got.count() == df.select("k").distinct().count()
    assert got.where("k = 0").first().v == 0
    # Thinned before the shuffle: an aggregate on both sides of the exchange, no window.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("partial_min_by") >= 1


def test_csv_with_repeated_headers(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('ISIN,"Price, last",Price,Price,Note\nA,1,2.5,2.5,NaN\nB,,NaN,3,"x, y"\n')
    df = I.read_csv(spark, str(path), ordinal=True)
    assert df.columns == ["ISIN", "Price, last", "Price", "Price.1", "Note", I.ORDINAL]
    rows = df.orderBy(I.ORDINAL).collect()
    assert [r["Price"] for r in rows] == [2.5, None] and rows[1]["Note"] == "x, y"
    typed = I.read_csv(spark, str(path), "ISIN string, a int, b double, c double, d string")
    assert typed.first().b == 2.5


def test_secondary_keeps_the_first_row(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("ISIN Code,v\nA,1\nB,2\nA,3\n")
    rows = {r.isin: r.v for r in I.load_secondary(I.read_csv(spark, str(path), ordinal=True)).collect()}
    assert rows == {"A": 1, "B": 2}


def test_json_payload(spark, tmp_path):
    path = tmp_path / "p.json"
    records = [{"isin ": " A ", "ql1": "5", "Note": "x"}, {"isin ": "A", "ql1": "6"}, {"isin ": " ", "ql1": "7"}, {"isin ": "B", "ql1": "bad"}]
    path.write_text(json.dumps(records))
    df = I.read_json_payload(spark, str(path), ordinal=True)
    assert set(df.columns) == {"ISIN", "QL1", "NOTE", I.ORDINAL}
    I.validate_payload(df, "quarterly", "Q")
    rows = {r.isin: (r.QL1, r.QL48) for r in I.prepare_payload(df).collect()}
    assert rows == {"A": (5.0, None), "B": (None, None)}
    for bad, freq in ((df.drop("ISIN"), "Q"), (df, "FY"), (df.limit(0), "Q")):
        with pytest.raises(ValueError):
            I.validate_payload(bad, "x", freq)


def test_load_periods(spark):
    cols = ", ".join(f"QL{i} double" for i in range(1, 49))
    df = spark.createDataFrame([("A", *[1.0] * 48, 0), ("A", *[2.0] * 48, 1)], f"ISIN string, {cols}, {I.ORDINAL} int")
    got = I.load_periods(df, "Q").collect()
    assert len(got) == 1 and got[0].QL7 == 1.0
    with pytest.raises(ValueError):
        I.load_periods(df.drop("QL9"), "Q")


def test_assemble_keeps_base_rows_and_marks_clashes(spark):
    base = spark.createDataFrame([("A", 1), ("B", 2)], "isin string, v int")
    other = spark.createDataFrame([("A", 9, 5), ("C", 9, 6)], "isin string, v int, w int")
    out = M.assemble(base, [other]).orderBy("isin").collect()
    assert [tuple(r) for r in out] == [("A", 1, 9, 5), ("B", 2, None, None)]


def test_coverage_and_parity(spark):
    base = spark.createDataFrame([("A",), ("B",), (None,)], "isin string")
    feed = spark.createDataFrame([("A",), ("A",), ("Z",)], "isin string")
    r = M.source_coverage(base, {"s": feed}).first()
    assert (r.matched, r["of"], round(r.pct, 2)) == (1, 3, 33.33)
    f = M.feed_coverage(base, feed).first()
    assert (f["size"], f.matched, f.unmatched, f.feed_companies) == (3, 1, 2, 2)
    assert M.unmatched(base, feed, ["isin"]).count() == 2
    a = spark.createDataFrame([("A", True), ("B", None), ("C", True)], "isin string, pat_both_at_ath boolean")
    b = spark.createDataFrame([("A", False), ("B", False), ("D", True)], "isin string, pat_both_at_ath boolean")
    assert [x.isin for x in M.parity(a, b).collect()] == ["A"]
    c = M.parity_counts(a, b).first()
    assert (c.rows_a, c.rows_b, c.shared, c.mismatched) == (3, 3, 2, 1)


def test_verdict_states(spark):
    rows = spark.createDataFrame([("s1", "A"), ("s2", "B"), ("s3", None), ("s4", "X")], "symbol string, isin string")
    table = spark.createDataFrame([("A", True), ("B", None)], "isin string, pat_both_at_ath boolean")
    got = {r.symbol: r.profit_state for r in M.verdict_state(rows, table).collect()}
    assert got == {"s1": "at_ath", "s2": "not_at_ath", "s3": "no_data", "s4": "no_data"}


def test_two_sources(spark):
    rows = [(float(i), float(i) * 1.1) for i in range(1, 21)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "roce double, roce_screener double")
    r = M.disagreeing_pairs(df).first()
    assert r.n_overlap == 20 and r.correlation == pytest.approx(1.0) and r.resolution == "both retained"
    assert r.median_abs_diff_pct == pytest.approx((1 - 1 / 1.1) * 100)
    assert M.disagreeing_pairs(df.limit(9)).count() == 0
    assert len(K.CONFLICT_PAIRS) == 4


def test_files_with_headers_of_their_own(spark, tmp_path):
    """Swapped and missing columns, a byte-order mark, quotes, a repeated header, blank and bad lines."""
    (tmp_path / "a.csv").write_text('\ufeffkey,price,name\n1,2.5,"x, ""y"""\n2,n/a,b\n\n3,,c\n4,1\n')
    (tmp_path / "b.csv").write_text("name,key,price\nd,5,7\ne,6,8,9\n")
    (tmp_path / "c.csv").write_text("key,other,other\n7,o,p\n")
    (tmp_path / "d.csv").write_text("key,price,name\n")
    (tmp_path / "e.csv").write_text("")
    rows, rejects = I.read_csv_files(spark, str(tmp_path), {"key": "int", "price": "double"}, ordinal=True)
    got = {r.key: (r.price, r.name, r.other, r["other.1"]) for r in rows.collect()}
    assert got == {1: (2.5, 'x, "y"', None, None), 3: (None, "c", None, None), 5: (7.0, "d", None, None), 7: (None, None, "o", "p")}
    assert rows.columns[-1] == I.ORDINAL
    bad = sorted((r.file[-5:], r.line, r.reason, r.record) for r in rejects.collect())
    assert bad == [
        ("a.csv", 3, "price: not a double", "2,n/a,b"), ("a.csv", 6, "not the 3 values of the header", "4,1"), ("b.csv", 3, "not the 3 values of the header", "e,6,8,9"),
    ]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n" + "".join(f"{i},{'x' if i % 100 == 7 else i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows, rejects = I.read_csv_files(spark, str(tmp_path / "t.csv"), {"k": "int", "v": "int"})
        assert rows.rdd.getNumPartitions() > 3
        assert sorted((r.line, r.record) for r in rejects.collect()) == [(i + 2, f"{i},x") for i in range(7, 3000, 100)]
        assert rows.count() == 2970
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
