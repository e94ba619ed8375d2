"""From raw inputs to a curated snapshot, and committing it to the store."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions import tags
from panelyard.operators import clean, derive, matching, order_stats, periods, quality
from panelyard.session import cut_lineage
from panelyard.sources import manifest as M
from panelyard.sources import snapshots as S
from panelyard.sources.manifest import DATE

MAX_TAG_COLUMNS = 500


@dataclass
class Curated:
    """A built snapshot, or several with their day in every frame. ``columns`` names the columns
    of ``companies`` that each day has, where days differ."""

    companies: DataFrame
    profit_quarterly: DataFrame
    profit_annual: DataFrame
    ledger: DataFrame
    checks: list[DataFrame] = field(default_factory=list)
    columns: dict[str, list[str]] | None = None


# source -> day -> its raw columns
Present = dict[str, dict[str, list[str]]]


def tag_vocabulary(df: DataFrame, column: str = "index_tags") -> list[str]:
    """Distinct tags, for one flag column each. A vocabulary that would not fit a schema
    is an error; such tags stay in the array column."""
    found = [r[0] for r in tags.distinct_tags(df, column).limit(MAX_TAG_COLUMNS + 1).collect()]
    if len(found) > MAX_TAG_COLUMNS:
        raise ValueError(f"more than {MAX_TAG_COLUMNS} distinct tags; keep them as an array")
    return sorted(found)


def tag_vocabularies(df: DataFrame, days: Sequence[str], column: str = "index_tags") -> dict[str, list[str]]:
    """The vocabulary of every day, from one pass; each must fit a schema."""
    pairs = df.select(F.col(DATE).cast("string").alias("day"), F.explode(tags.parse_tags(column)).alias("tag")).distinct()
    counts = {r["day"]: r["n"] for r in pairs.groupBy("day").agg(F.count("*").alias("n")).collect()}
    if max(counts.values(), default=0) > MAX_TAG_COLUMNS:
        raise ValueError(f"more than {MAX_TAG_COLUMNS} distinct tags on a day; keep them as an array")
    out: dict[str, list[str]] = {d: [] for d in days}
    for r in pairs.collect():  # MAX_TAG_COLUMNS a day at most
        out[r["day"]].append(r["tag"])
    return {d: sorted(found) for d, found in out.items()}


def profit_summary(profit_q: DataFrame, profit_y: DataFrame, key: str | list[str] = "isin") -> DataFrame:
    """Quarterly and annual summaries and record verdicts, one row per key."""
    return periods.summarise(
        periods.with_series(profit_q, "Q"), periods.with_series(profit_y, "FY"), key=key,
        ttm="TTM" if "TTM" in profit_y.columns else None,
    )


def shaped(base: DataFrame, secondary: DataFrame, summary: DataFrame, tag_names: Sequence[str], key: str | list[str] = "isin") -> DataFrame:
    """Renamed, tagged, joined and derived: the frame before its ranks. ``base`` has lost its dead
    columns."""
    df = clean.normalise_names(base, K.BASE_HEADERS)
    if "index_tags" in df.columns:
        df = tags.add_tag_columns(df, tag_names=list(tag_names)).drop("tags")
    second = clean.normalise_names(clean.drop_listed(secondary), K.SECONDARY_HEADERS)
    df = matching.assemble(df, [second, summary], key)
    return derive.add_all(df.withColumn("pat_both_at_ath", F.coalesce("pat_both_at_ath", F.lit(False))))


RANK_SCOPES = {"sector": "sector", "tier": "cap_tier"}


def build(
    base: DataFrame, secondary: DataFrame, profit_q: DataFrame, profit_y: DataFrame,
    rank_metrics: Sequence[str] | None = None, tag_columns: bool = True,
) -> Curated:
    """Clean, tag, join on the key, derive and rank. Inputs come from the loaders: the
    base with raw headers and ``isin``, the others with one row per key."""
    trimmed, ledger = clean.drop_dead_columns(base)
    named = clean.normalise_names(trimmed, K.BASE_HEADERS)
    names = tag_vocabulary(named) if tag_columns and "index_tags" in named.columns else []
    # The frame feeds the ranks, the checks and the write: materialise it once.
    df = cut_lineage(shaped(trimmed, secondary, profit_summary(profit_q, profit_y), names))
    metrics = [m for m in (rank_metrics or K.RANKED_METRICS) if m in df.columns]
    checks = []
    for reported, rebuilt in K.REBUILT_AS.items():
        if reported in base.columns and rebuilt in df.columns:
            pair = df.select("isin", rebuilt).join(base.select("isin", F.col(f"`{reported}`").cast("double").alias("__r")), "isin")
            checks.append(quality.reconstruction_check(pair, rebuilt, "__r").withColumn("field", F.lit(reported)))
    if metrics:
        df = order_stats.add_percentile_ranks(df, "isin", metrics, RANK_SCOPES)
    return Curated(df, periods.to_long(profit_q, "Q"), periods.to_long(profit_y, "FY"), ledger, checks)


def _on(days: Sequence[str]) -> Column:
    return F.col(DATE).cast("string").isin(list(days))


def _merged(df: DataFrame, kept: dict[str, list[str]], mapping: dict[str, str]) -> DataFrame:
    """Raw columns under their new names. Headers that mean the same on different days become one
    column; a column counts only on the days that keep it."""
    by_name: dict[str, list[str]] = {}
    for c in df.columns:
        if c not in (DATE, "isin") and any(c in columns for columns in kept.values()):
            by_name.setdefault(clean.normal_name(c, mapping), []).append(c)
    cells = []
    for name, raw in by_name.items():
        held = {c: [d for d, columns in kept.items() if c in columns] for c in raw}
        if len({d for days in held.values() for d in days}) < sum(map(len, held.values())):
            raise ValueError(f"name collision after normalisation: {name}")
        parts = [F.col(f"`{c}`") if len(days) == len(kept) else F.when(_on(days), F.col(f"`{c}`")) for c, days in held.items()]
        cells.append(F.coalesce(*parts).alias(name))
    return df.select(DATE, "isin", *cells)


def _empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.select(*[F.col(f"`{c}`") for c in columns]).schema)


def build_days(
    base: DataFrame, secondary: DataFrame, profit_q: DataFrame, profit_y: DataFrame, present: Present,
    rank_metrics: Sequence[str] | None = None, tag_columns: bool = True,
) -> Curated:
    """``build`` for all days at once: every frame carries ``snapshot_date``, and coverage,
    vocabulary, joins, ranks and checks are kept apart by it in one plan each, however many days
    there are. Which columns a day has follows from its own raw columns (``present``), its dropped
    ones and its tags, as if it were built alone; that is worked out on empty frames."""
    spark, key = base.sparkSession, [DATE, "isin"]
    days = sorted(present["tradingview"])
    base, secondary = cut_lineage(base), cut_lineage(secondary)
    had = spark.createDataFrame([(d, c) for d in days for c in present["tradingview"][d]], "d string, c string")
    ledger = cut_lineage(
        clean.dropped_columns(base, by=[DATE]).join(had, (F.col(DATE).cast("string") == F.col("d")) & (F.col("column") == F.col("c")), "left_semi")
    )
    gone = {(str(r[DATE]), r["column"]) for r in ledger.select(DATE, "column").collect()}  # columns times days
    kept = {d: [c for c in present["tradingview"][d] if (d, c) not in gone] for d in days}
    second_kept = {d: [c for c in present["screener"][d] if c not in K.SECONDARY_DROPPED] for d in days}
    named, second = _merged(base, kept, K.BASE_HEADERS), _merged(secondary, second_kept, K.SECONDARY_HEADERS)
    names = tag_vocabularies(named, days) if tag_columns and "index_tags" in named.columns else {d: [] for d in days}
    summary = profit_summary(profit_q, profit_y, key)

    # what each day alone would look like
    metrics_wanted, columns = rank_metrics or K.RANKED_METRICS, {}
    shapes: dict[tuple, list[str]] = {}
    for d in days:
        shape = (tuple(kept[d]), tuple(second_kept[d]), tuple(names[d]))
        if shape not in shapes:
            alone = shaped(_empty(base, kept[d]), _empty(secondary, second_kept[d]), _empty(summary, [c for c in summary.columns if c != DATE]), names[d])
            scopes = ["", *[f"_in_{s}" for s, c in RANK_SCOPES.items() if c in alone.columns]]
            shapes[shape] = [*alone.columns, *[f"pct_rank_{m}{s}" for m in metrics_wanted if m in alone.columns for s in scopes]]
        columns[d] = shapes[shape]

    df = shaped(named, second, summary, sorted({t for found in names.values() for t in found}), key)
    for c in [c for c in second.columns if c not in key and c in named.columns]:
        # on days whose base lacks it, the second source's column goes by its own name
        only = [d for d in days if c in columns[d] and f"{c}_sc" not in columns[d] and c not in {clean.normal_name(r, K.BASE_HEADERS) for r in kept[d]}]
        if only:
            df = df.withColumn(c, F.when(_on(only), F.col(f"{c}_sc")).otherwise(F.col(c)))
    df = cut_lineage(df)
    all_days = spark.createDataFrame([(d,) for d in days], f"{DATE} string").withColumn(DATE, F.col(DATE).cast("date"))
    checks = []
    for reported, rebuilt in K.REBUILT_AS.items():
        reporting = [d for d in days if reported in present["tradingview"][d] and rebuilt in columns[d]]
        if reporting:
            told = base.where(_on(reporting)).select(*key, F.col(f"`{reported}`").cast("double").alias("__r"))
            pair = df.select(*key, rebuilt).join(told, key)
            checks.append(quality.reconstruction_by(pair, DATE, all_days.where(_on(reporting)), rebuilt, "__r").withColumn("field", F.lit(reported)))
    metrics = [m for m in metrics_wanted if m in df.columns]
    if metrics:
        day = F.col(DATE).cast("string")
        within = {s: F.concat_ws("\x01", day, F.col(c)) for s, c in RANK_SCOPES.items() if c in df.columns}
        keyed = df.select(
            F.struct(*key).alias("__k"), *metrics, day.alias("__day"),
            *[F.when(F.col(RANK_SCOPES[s]).isNotNull(), cell).alias(f"__day_{s}") for s, cell in within.items()],
        )
        ranks = order_stats.percentile_ranks(keyed, "__k", metrics, {"": "__day", **{s: f"__day_{s}" for s in within}})
        df = df.join(ranks.select("__k.*", *[c for c in ranks.columns if c != "__k"]), key, "left")
    return Curated(df, periods.to_long(profit_q, "Q", key), periods.to_long(profit_y, "FY", key), ledger, checks, columns)


Loader = Callable[[str, DataFrame], DataFrame]


def preview(
    spark: SparkSession, store: str, names: Sequence[str], frames: dict[str, DataFrame], today: str,
    feed: dict[str, str] | None = None,
) -> dict:
    """What a commit of these files would do. Nothing is written."""
    try:
        recognised = S.classify(names)
    except S.SnapshotError as problem:
        return {"ok": False, "error": str(problem), "filenames": list(names)}
    date = S.resolve_date(recognised, None, today)
    provenance = S.read_provenance(spark, store)
    try:
        resolved = S.resolve_sources(provenance, recognised, date, feed)
    except S.SnapshotError as problem:
        return {"ok": False, "error": str(problem), "snapshot_date": date, "recognised": recognised}
    daily = {s: f for s, f in frames.items() if s in K.DAILY_SOURCES}
    same = S.duplicate_of(provenance, S.source_hashes(daily)).first() if daily else None
    held = M.days(spark, store, "companies")
    return {
        "ok": True, "snapshot_date": date, "already_exists": date in held,
        "duplicate_of": str(same[0]) if same else None, "recognised": recognised,
        "carried_forward": {s: i["from_snapshot"] for s, i in resolved.items() if i["carried_forward"]},
        "snapshots_held": len(held),
    }


def _publish(
    spark: SparkSession, store: str, days: Sequence[str], built: Curated, provenance: Callable[[dict], DataFrame], seen: int,
    band: dict, more: Sequence[M.Entry] = (), needed: Sequence[tuple[str, str]] = (), alone: bool = False,
) -> dict[str, M.Entry]:
    """Stage everything, check the staged companies, and move to the next manifest. Where a rule is
    violated only the checks are published, as ``rejected``, and readers stay where they were.
    Returns the companies entry of each day."""
    companies = {e.snapshot_date: e for e in M.stage(built.companies, store, "companies", days, built.columns)}
    staged = M.scan(spark, store, "companies", list(companies.values()))
    found = quality.gates(staged, DATE, tiers=band["tiers"] if "cap_tier" in staged.columns else None, low=band["low"], high=band["high"])
    empty = [d for d in days if not companies[d].rows]
    if empty:
        none = spark.createDataFrame([(d, "row_count", 0, band["low"], band["high"], bool(band["low"])) for d in empty], f"{DATE} string, rule string, found bigint, low bigint, high bigint, violated boolean")
        found = found.unionByName(none.withColumn(DATE, F.col(DATE).cast("date")))
    results = found.select(DATE, "rule", F.lit(None).cast("string").alias("status"), F.col("found").cast("double").alias("found"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "violated")
    for check in built.checks:
        dated = check if DATE in check.columns else check.withColumn(DATE, F.lit(days[0]).cast("date"))
        results = results.unionByName(dated.select(
            DATE, F.concat(F.lit("rebuilt "), "field").alias("rule"), "status", F.col("median_abs_err_pct").alias("found"), F.lit(None).cast("double").alias("low"),
            F.lit(K.RECONSTRUCTION_TOLERANCE_PCT).cast("double").alias("high"), F.lit(False).alias("violated"),
        ))
    results = cut_lineage(results)
    broken = results.where("violated").orderBy(DATE, "rule").limit(5).collect()
    if broken:
        M.publish(spark, store, M.stage(results, store, "rejected", days))
        said = "; ".join(f"{r[DATE]} {r['rule']}: {r['found']:g}, expected {'' if r['low'] is None else format(r['low'], 'g')} to {'' if r['high'] is None else format(r['high'], 'g')}" for r in broken)
        raise S.SnapshotError(f"the build breaks its rules, nothing was published ({said})")
    entries = [*companies.values(), *more]
    ledger = built.ledger if DATE in built.ledger.columns else built.ledger.withColumn(DATE, F.lit(days[0]).cast("date"))
    others = {"profit_quarterly": built.profit_quarterly, "profit_annual": built.profit_annual, "ledger": ledger, "checks": results, "provenance": provenance(companies)}
    entries += M.stage_all(store, [(k, df if DATE in df.columns else df.withColumn(DATE, F.lit(days[0]).cast("date")), days) for k, df in others.items()])
    M.publish(spark, store, entries, seen=seen, needed=needed, alone=alone)
    return companies


def _band(low: int | None, high: int | None, tiers: dict[str, int] | None) -> dict:
    """The sizes of tiers belong to the standard universe; another one brings its own."""
    standard = (low, high) == (K.UNIVERSE_MIN, K.UNIVERSE_MAX)
    return {"low": low, "high": high, "tiers": tiers or (K.TIER_EXPECTED if standard else None)}


def commit(
    spark: SparkSession, store: str, supplied: dict[str, tuple[str, DataFrame]], built_at: Column,
    today: str, date: str | None = None, replace: bool = False, allow_duplicate: bool = False,
    low: int | None = K.UNIVERSE_MIN, high: int | None = K.UNIVERSE_MAX,
    feed: dict[str, tuple[str, DataFrame]] | None = None, feed_fetched: str | None = None,
    build_fn: Callable[..., Curated] = build, tiers: dict[str, int] | None = None,
) -> dict:
    """Build one snapshot and publish it. ``supplied``: source to (file name, loaded
    frame); ``feed`` likewise for a fetched period feed, which an upload overrides.
    Companies, both series, provenance, ledger, checks and the raw inputs appear together,
    or not at all."""
    if not supplied:
        raise S.SnapshotError("no files supplied")
    given = {**(feed or {}), **supplied}
    names = {s: n for s, (n, _) in given.items()}
    snap = S.resolve_date({s: n for s, (n, _) in supplied.items()}, date, today)
    seen, _ = M.load(spark, store)
    held = M.days(spark, store, "companies")
    if snap in held and not replace:
        raise S.SnapshotError(f"snapshot {snap} already exists")
    provenance = S.read_provenance(spark, store)
    resolved = S.resolve_sources(provenance, names, snap)
    # what is given is hashed, built from and archived: it is made once
    frames = {
        s: cut_lineage(given[s][1]) if s in given else M.read(spark, store, S.archive_kind(s), [info["from_snapshot"]]).drop(DATE)
        for s, info in resolved.items()
    }
    hashes = cut_lineage(S.source_hashes(frames))
    daily = [s for s in K.DAILY_SOURCES if s in given]
    if daily and not allow_duplicate:
        same = S.duplicate_of(provenance, hashes.where(F.col("source").isin(daily))).first()
        if same and str(same[0]) != snap:
            raise S.SnapshotError(f"these inputs are identical to snapshot {same[0]}")
    built = build_fn(frames["tradingview"], frames["screener"], frames["profit_q"], frames["profit_y"])
    built.companies = built.companies.withColumn(DATE, F.lit(snap).cast("date"))
    own = [s for s in given if not resolved[s]["carried_forward"]]
    archives = M.stage_all(store, [(S.archive_kind(s), frames[s].withColumn(DATE, F.lit(snap).cast("date")), [snap]) for s in own])
    width = len(built.companies.columns) - 1

    def rows(companies: dict[str, M.Entry]) -> DataFrame:
        return S.provenance_rows(spark, resolved, hashes, snap, built_at, companies[snap].rows, width)

    carried = [(S.archive_kind(s), i["from_snapshot"]) for s, i in resolved.items() if i["carried_forward"] and s not in given]
    n = _publish(spark, store, [snap], built, rows, seen, _band(low, high, tiers), archives, carried)[snap].rows
    return {
        "snapshot_date": snap, "universe": n, "columns": width,
        "replaced": snap in held, "sources": resolved, "notes": S.notes(resolved, feed_stale=bool(feed) and feed_fetched != today, has_feed=bool(feed)),
    }


def rebuild_all(
    spark: SparkSession, store: str, built_at: Column, low: int | None = K.UNIVERSE_MIN,
    high: int | None = K.UNIVERSE_MAX, build_fn: Callable[..., Curated] = build_days, tiers: dict[str, int] | None = None,
) -> list[str]:
    """Rebuild every held snapshot from its archived inputs: one scan per source over all
    archives, one build keyed by day, one manifest. An archive that is gone is an error."""
    seen, entries = M.load(spark, store)
    by_key = {e.key: e for e in entries}
    held = sorted(e.snapshot_date for e in entries if e.kind == "companies")
    if not held:
        raise S.SnapshotError("no snapshots to rebuild")
    provenance = cut_lineage(S.read_provenance(spark, store).where(_on(held)))
    origin = {(r["source"], str(r[DATE])): str(r["from_snapshot"]) for r in provenance.select("source", DATE, "from_snapshot").collect()}  # four a day
    lost = sorted((d, s) for d in held for s in K.SOURCE_NAMES if (s, d) not in origin or (S.archive_kind(s), origin[s, d]) not in by_key)
    if lost:
        raise S.SnapshotError(f"cannot rebuild {lost[0][0]}: the archive of {lost[0][1]} is gone")
    frames, present = {}, {}
    for s in K.SOURCE_NAMES:
        archived = M.read(spark, store, S.archive_kind(s), sorted({origin[s, d] for d in held}))
        uses = spark.createDataFrame([(origin[s, d], d) for d in held], "o string, d string").select(F.col("o").cast("date").alias(DATE), F.col("d").cast("date").alias("__day"))
        # one row per day held
        frames[s] = archived.join(F.broadcast(uses), DATE).drop(DATE).withColumnRenamed("__day", DATE)
        present[s] = {d: by_key[S.archive_kind(s), origin[s, d]].columns.names for d in held}
    built = build_fn(*[frames[s] for s in K.SOURCE_NAMES], present)
    widths = {d: len(built.columns[d]) if built.columns else len(built.companies.columns) - 1 for d in held}

    def rows(companies: dict[str, M.Entry]) -> DataFrame:
        sizes = spark.createDataFrame([(d, companies[d].rows, widths[d]) for d in held], "d string, universe bigint, columns int")
        return (
            provenance.drop("universe", "columns").withColumn("built_at", built_at.cast("timestamp"))
            .join(F.broadcast(sizes.withColumn("d", F.col("d").cast("date"))), F.col(DATE) == F.col("d")).drop("d")
        )

    _publish(spark, store, held, built, rows, seen, _band(low, high, tiers), alone=True)
    return held
