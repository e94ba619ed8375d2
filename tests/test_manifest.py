"""Manifests: atomic publication, crashes, other writers, schema evolution, safe deletion, rebuild."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators import quality as Q
from panelyard.plans import build as B
from panelyard.sources import manifest as M
from panelyard.sources import snapshots as S
from panelyard.sources import tables
from test_snapshots import at, profit, raw_base, raw_secondary

DAYS = [f"2026-08-{d}" for d in range(10, 20)]


def tiny(first, second, profit_q, profit_y):
    return B.Curated(first.join(second, "isin", "left"), profit_q, profit_y, first.select("isin").limit(0))


def given(spark, by=0.0, extra=True):
    base = spark.createDataFrame([("A", 1.0 + by), ("B", 2.0 + by)], "isin string, price double")
    out = {"tradingview": (f"tv{by}.csv", base)}
    if extra:
        other = spark.createDataFrame([("A", 5)], "isin string, lines int")
        out.update(screener=("s.csv", other), profit_q=("q.csv", other.withColumnRenamed("lines", "q")), profit_y=("y.csv", other.withColumnRenamed("lines", "y")))
    return out


def commit(spark, store, day, files, **kwargs):
    return B.commit(spark, store, files, at(), day, date=day, low=None, high=None, build_fn=tiny, **kwargs)


def state(spark, store):
    number, entries = M.load(spark, store)
    prices = sorted((str(r[0]), r[1], r[2]) for r in M.read(spark, store, "companies").select(S.DATE, "isin", "price").collect())
    return number, entries, prices, S.read_provenance(spark, store).count()


def test_a_crash_anywhere_leaves_readers_on_the_old_day(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    commit(spark, store, DAYS[0], given(spark))
    before = state(spark, store)
    stage, write_once = M.stage, tables.write_once
    calls = {"n": 0, "fail_at": 0}

    def failing(real):
        def call(*args, **kwargs):
            calls["n"] += 1
            if calls["n"] == calls["fail_at"]:
                raise OSError("the executor is gone")
            return real(*args, **kwargs)
        return call

    monkeypatch.setattr(M, "stage", failing(stage))
    monkeypatch.setattr(tables, "write_once", failing(write_once))
    failures = 0
    for fail_at in range(1, 20):
        calls.update(n=0, fail_at=fail_at)
        try:
            commit(spark, store, DAYS[1], given(spark, 1.0, extra=False))
            break
        except OSError:
            failures += 1
            assert state(spark, store) == before
    assert failures == 8  # one archive, six tables, the manifest
    assert M.days(spark, store, "companies") == DAYS[:2]
    # what the crashed writers left can be removed, nothing that is read
    after = state(spark, store)
    left = M.removable(spark, store, S.KINDS, keep=1, min_age_hours=0).collect()
    assert left and M.removable(spark, store, S.KINDS, keep=1, min_age_hours=1).isEmpty()
    assert sorted(M.remove(spark, store, S.KINDS, keep=1, min_age_hours=0)) == sorted(r.folder for r in left)
    assert state(spark, store) == after and M.removable(spark, store, S.KINDS, keep=1, min_age_hours=0).isEmpty()


def entry(spark, store, kind, day, rows=(("a", 1),), schema="k string, v int"):
    return M.stage(spark.createDataFrame(list(rows), schema).withColumn(S.DATE, F.lit(day).cast("date")), store, kind, [day])


def test_other_writers(spark, tmp_path):
    store = str(tmp_path)
    one = entry(spark, store, "t", DAYS[0])
    assert M.publish(spark, store, one, seen=-1) == 0
    assert M.publish(spark, store, entry(spark, store, "t", DAYS[1]), seen=-1) == 1  # another day: both stay
    assert M.days(spark, store, "t") == DAYS[:2]
    for kwargs in ({"added": entry(spark, store, "t", DAYS[0])}, {"removed": [("t", DAYS[0])]}, {"added": entry(spark, store, "t", DAYS[5]), "needed": [("t", DAYS[0])]}, {"alone": True}):
        with pytest.raises(M.SnapshotError, match="another writer"):
            M.publish(spark, store, seen=-1, **kwargs)
    assert M.numbers(spark, store) == [0, 1]
    # a number that is taken is refused, and its content stays
    text = tables.read_text(spark, M.path_of(store, 1))
    assert not tables.write_once(spark, M.path_of(store, 1), "x") and tables.read_text(spark, M.path_of(store, 1)) == text
    assert [n for n in tables.file_names(spark, f"{store}/{M.FOLDER}") if not n.endswith(".crc")] == ["m000000000.json", "m000000001.json"]
    # an earlier manifest can still be read
    assert M.read(spark, store, "t", number=0).count() == 1 and M.read(spark, store, "t").count() == 2


def test_columns_are_united_and_widened(spark, tmp_path):
    store = str(tmp_path)
    made = [
        *entry(spark, store, "t", DAYS[0], [("a", 1)], "k string, v int"),
        *entry(spark, store, "t", DAYS[1], [("b", 2.5, [1])], "k string, v double, l array<int>"),
        *entry(spark, store, "t", DAYS[2], [("c", 3)], "k string, v bigint"),
        *entry(spark, store, "t", DAYS[3], [], "k string, w string"),
    ]
    M.publish(spark, store, made)
    df = M.read(spark, store, "t")
    assert [f"{n} {t}" for n, t in df.dtypes] == ["k string", "v double", "l array<int>", "w string", "snapshot_date date"]
    assert sorted(tuple(r)[:3] for r in df.collect()) == [("a", 1.0, None), ("b", 2.5, [1]), ("c", 3.0, None)]
    # a day of its own keeps its own type, and only its files are opened
    one = M.read(spark, store, "t", [DAYS[0]])
    assert dict(one.dtypes)["v"] == "int" and one.columns == ["k", "v", "snapshot_date"]
    assert len(one.inputFiles()) == 1 and DAYS[0] in one.inputFiles()[0]
    assert M.read(spark, store, "t", [DAYS[3]]).collect() == []
    with pytest.raises(M.SnapshotError):
        M.read(spark, store, "t", [DAYS[4]])
    with pytest.raises(M.SnapshotError, match="no type holds"):
        M.wider(T.StringType(), T.IntegerType())
    assert M.wider(T.LongType(), T.FloatType()) == T.DoubleType() and M.wider(T.DecimalType(10, 2), T.DecimalType(8, 4)) == T.DecimalType(12, 4)


def test_plain_tables_need_no_merged_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_partition(spark.createDataFrame([(1, 2)], "a int, b int"), path, DAYS[0])
    S.write_partition(spark.createDataFrame([(1.5, "x")], "a double, c string"), path, DAYS[1])
    df = S.read_table(spark, path)
    assert sorted(tuple(r)[:3] for r in df.collect()) == [(1.0, 2, None), (1.5, None, "x")]
    assert S.read_table(spark, path, [DAYS[1]]).inputFiles() and all(DAYS[1] in f for f in S.read_table(spark, path, [DAYS[1]]).inputFiles())


def test_archives_that_other_days_use_stay(spark, tmp_path):
    store = str(tmp_path)
    commit(spark, store, DAYS[0], given(spark))
    commit(spark, store, DAYS[1], given(spark, 1.0, extra=False))
    commit(spark, store, DAYS[2], given(spark, 2.0, extra=False))
    assert S.delete(spark, store, DAYS[0], keep_archive=False) == DAYS[1:3]
    archives = lambda: {e.key for e in M.load(spark, store)[1] if e.kind.startswith("archive/")}
    used = {(S.archive_kind(s), DAYS[0]) for s in ("screener", "profit_q", "profit_y")}
    assert archives() == used | {("archive/tradingview", d) for d in DAYS[1:3]}
    assert B.rebuild_all(spark, store, at(), None, None, build_fn=tiny_days) == DAYS[1:3]
    # once nothing is left that was built from them, they go
    commit(spark, store, DAYS[3], given(spark, 3.0))
    for d in DAYS[1:3]:
        S.delete(spark, store, d, keep_archive=False)
    assert archives() == {(S.archive_kind(s), DAYS[3]) for s in ("tradingview", "screener", "profit_q", "profit_y")}
    assert not M.removable(spark, store, S.KINDS, keep=1, min_age_hours=0).isEmpty()


def test_reachable_archives_follow_chains(spark):
    rows = [("s", DAYS[2], DAYS[1]), ("s", DAYS[1], DAYS[0]), ("s", DAYS[0], DAYS[0]), ("t", DAYS[2], DAYS[2])]
    frame = spark.createDataFrame(rows, f"source string, {S.DATE} string, from_snapshot string")
    assert S.reachable_archives(frame, [DAYS[2]]) == {("s", DAYS[1]), ("s", DAYS[0]), ("t", DAYS[2])}


def tiny_days(first, second, profit_q, profit_y, present):
    return B.Curated(first.join(second, [S.DATE, "isin"], "left"), profit_q, profit_y, first.select(S.DATE, "isin").limit(0))


def test_rebuild_is_refused_without_an_archive(spark, tmp_path):
    store = str(tmp_path)
    commit(spark, store, DAYS[0], given(spark))
    M.publish(spark, store, removed=[("archive/screener", DAYS[0])])
    with pytest.raises(S.SnapshotError, match="archive of screener is gone"):
        B.rebuild_all(spark, store, at(), None, None, build_fn=tiny_days)


def test_ten_days_built_at_once_are_as_built_alone(spark):
    """Days differ in rows, values, tags, dead columns, and in headers that only some have."""
    bases, seconds = {}, {}
    for i, d in enumerate(DAYS):
        b = raw_base(spark, float(i), 20 + i)
        if i % 3 == 1:
            b = b.withColumn("Index", F.concat_ws(",", "Index", F.lit(f"Fresh {i}")))
        if i % 4 == 2:
            b = b.drop("Price to earnings ratio").withColumn("Beta, 1 year", F.when(F.col("isin") > "IN004", 1.5))
        if i == 7:
            b = b.drop("Index", "Exponential moving average, 50, 1 day").withColumn("Odd", F.lit(3))
        bases[d] = b
        seconds[d] = raw_secondary(spark).withColumn("Odd", F.lit(i)) if i % 2 else raw_secondary(spark, 12)
    q, y = profit(spark)
    dated = lambda frames: S.union_by_name([f.withColumn(S.DATE, F.lit(d).cast("date")) for d, f in frames.items()])
    present = {"tradingview": {d: b.columns for d, b in bases.items()}, "screener": {d: f.columns for d, f in seconds.items()}}
    at_once = B.build_days(dated(bases), dated(seconds), dated({d: q for d in DAYS}), dated({d: y for d in DAYS}), present)
    companies, ledger = at_once.companies.cache(), at_once.ledger.cache()
    for d in (DAYS[0], DAYS[1], DAYS[2], DAYS[7]):
        alone = B.build(bases[d], seconds[d], q, y)
        mine = F.col(S.DATE) == F.lit(d).cast("date")
        assert sorted(at_once.columns[d]) == sorted(alone.companies.columns)
        names = sorted(alone.companies.columns)
        found = companies.where(mine).select(*names).orderBy("isin").collect()
        assert [tuple(r) for r in found] == [tuple(r) for r in alone.companies.select(*names).orderBy("isin").collect()]
        assert sorted(map(tuple, ledger.where(mine).drop(S.DATE).collect())) == sorted(map(tuple, alone.ledger.collect()))
        both = zip(sorted((c.where(mine).drop(S.DATE).first() for c in at_once.checks if not c.where(mine).isEmpty()), key=str), sorted((c.first() for c in alone.checks), key=str), strict=True)
        assert all(tuple(a) == tuple(b) for a, b in both)
    companies.unpersist()
    ledger.unpersist()


def test_gates(spark):
    rows = [(DAYS[0], f"K{i}", "Large" if i < 4 else "Mid") for i in range(10)] + [(DAYS[1], "A", "Unclassified"), (DAYS[1], "A", "Large"), (DAYS[1], None, "Mid")]
    df = spark.createDataFrame(rows, "snapshot_date string, isin string, cap_tier string")
    found = {(r.snapshot_date, r.rule): (r.found, r.low, r.high, r.violated) for r in Q.gates(df, S.DATE, low=5, high=10, tiers={"Large": 2, "Mid": 6}, nominal=8, slack=1).collect()}
    assert found[DAYS[0], "row_count"] == (10, 5, 10, False) and found[DAYS[1], "row_count"] == (3, 5, 10, True)
    assert found[DAYS[0], "tier Large"] == (4, 1, 3, True) and found[DAYS[0], "tier Mid"] == (6, 5, 7, False)
    assert found[DAYS[1], "tier Mid"] == (1, 0, 7, False)  # five rows short of the nominal size
    assert found[DAYS[1], "duplicate_key"] == (1, None, 0, True) and found[DAYS[1], "null_key"] == (1, None, 0, True)
    assert found[DAYS[1], "tier Unclassified"] == (1, None, 1, False)


def test_a_violation_stops_the_publish_and_is_kept(spark, tmp_path):
    store = str(tmp_path)
    commit(spark, store, DAYS[0], given(spark))
    before = M.days(spark, store, "companies"), state(spark, store)[2]
    tagged = lambda *frames: B.Curated(tiny(*frames).companies.withColumn("cap_tier", F.lit("Large")), *frames[2:], frames[0].limit(0))
    for kwargs, rule in (({"low": 3, "high": 9, "build_fn": tagged}, "row_count"), ({"low": None, "high": None, "tiers": {"Large": 2, "Mid": 900}, "build_fn": tagged}, "tier Mid")):
        with pytest.raises(S.SnapshotError, match=rule):
            B.commit(spark, store, given(spark, 1.0, extra=False), at(), DAYS[1], date=DAYS[1], **kwargs)
        assert (M.days(spark, store, "companies"), state(spark, store)[2]) == before
        assert rule in {r.rule for r in M.read(spark, store, "rejected").where("violated").collect()}
    held = M.read(spark, store, "checks").collect()
    assert {r.rule for r in held} == {"row_count", "null_key", "duplicate_key"} and not any(r.violated for r in held)


def test_given_frames_are_made_once(spark, tmp_path):
    """A commit hashes, builds from and archives what it is given, but computes it once."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    files = given(spark)
    name, df = files["tradingview"]
    files["tradingview"] = (name, df.mapInArrow(counted, df.schema))
    commit(spark, str(tmp_path / "store"), DAYS[0], files)
    assert made.value == df.count()
