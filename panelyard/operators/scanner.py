"""Record-high scan over daily bars with stored triggers and an event log.

Every step is a function of (state, input) giving (new state, events), so it can be run
again without harm: a split already accounted for or a high already promoted changes
nothing. ``as_of`` is always passed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions import exprs as X
from panelyard.operators import prices
from panelyard.operators.matching import verdict_state

STATE = "symbol string, ath_price double, ath_date date, today_ath double, last_split_check date, last_updated timestamp"
EVENTS = (
    "symbol string, event_date date, old_price double, new_price double, old_date date, "
    "new_date date, source string, note string, created_at timestamp"
)
EVENT_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def _events(
    df: DataFrame, source: str, as_of: Column, event_date: Column, old_price: Column,
    new_price: Column, old_date: Column, new_date: Column, note: Column | None = None,
) -> DataFrame:
    return df.select(
        "symbol", event_date.cast("date").alias("event_date"), old_price.cast("double").alias("old_price"),
        new_price.cast("double").alias("new_price"), old_date.cast("date").alias("old_date"),
        new_date.cast("date").alias("new_date"), F.lit(source).alias("source"),
        (F.lit(None) if note is None else note).cast("string").alias("note"),
        as_of.cast("timestamp").alias("created_at"),
    )


def clear_today(state: DataFrame) -> DataFrame:
    return state.withColumn("today_ath", F.lit(None).cast("double"))


def seed_missing(
    state: DataFrame, universe: DataFrame, bars: DataFrame | None, as_of: Column, stored: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Lifetime highs for scanned symbols without a trigger, from the full series or from highs that
    are kept up to date (``stored``, see ``high_months``). They hold every split up to the last bar,
    so that date marks them as accounted for."""
    known = state.where("ath_price IS NOT NULL").select("symbol")
    missing = universe.select("symbol").join(known, "symbol", "left_anti")
    highs = (stored if bars is None else prices.lifetime_highs(bars.join(missing, "symbol", "left_semi"))).join(missing, "symbol", "left_semi")
    fresh = highs.select(
        "symbol", F.col("ath_price").alias("p"), F.col("ath_date").alias("d"), F.col("last_bar").alias("b")
    )
    is_new = F.col("p").isNotNull()
    merged = state.join(fresh, "symbol", "full_outer").select(
        "symbol",
        F.coalesce("p", "ath_price").alias("ath_price"),
        F.when(is_new, F.col("d")).otherwise(F.col("ath_date")).alias("ath_date"),
        "today_ath",
        F.when(is_new, F.col("b")).otherwise(F.col("last_split_check")).alias("last_split_check"),
        F.when(is_new, as_of.cast("timestamp")).otherwise(F.col("last_updated")).alias("last_updated"),
    )
    none = F.lit(None)
    return merged, _events(fresh, "seed", as_of, F.col("d"), none, F.col("p"), none, F.col("d"))


def repair_splits(state: DataFrame, window_bars: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Rescale a trigger by the splits of the lookback window, but only where the latest
    of them is newer than the last split accounted for. The window shows the same split
    on several days; the mark never moves back."""
    joined = state.join(prices.window_splits(window_bars), "symbol", "left")
    checked = F.col("last_split_check")
    due = X.flag(
        F.col("ratio").isNotNull() & F.col("ath_price").isNotNull()
        & (checked.isNull() | (F.col("split_date") > checked))
    )
    repaired = X.safe_div("ath_price", "ratio")
    new_state = joined.select(
        "symbol",
        F.when(due, repaired).otherwise(F.col("ath_price")).alias("ath_price"),
        "ath_date", "today_ath",
        F.when(due, F.greatest(checked, F.col("split_date"))).otherwise(checked).alias("last_split_check"),
        F.when(due, as_of.cast("timestamp")).otherwise(F.col("last_updated")).alias("last_updated"),
    )
    events = _events(
        joined.where(due), "split", as_of, F.col("split_date"), F.col("ath_price"), repaired,
        F.col("ath_date"), F.col("split_date"),
        F.concat(F.lit("split ratio "), F.col("ratio").cast("string")),
    )
    return new_state, events


def _priced(universe: DataFrame, window_bars: DataFrame) -> DataFrame:
    return universe.join(prices.last_prices(window_bars), "symbol", "left").withColumn(
        "usable", X.flag(F.col("today_high").isNotNull() & (F.col("closes") >= 2))
    )


def find_hits(universe: DataFrame, state: DataFrame, window_bars: DataFrame) -> DataFrame:
    """Scanned symbols whose last high reached the (repaired) trigger, to the cent."""
    triggers = state.where("ath_price IS NOT NULL").select("symbol", F.col("ath_price").alias("trigger"))
    rows = _priced(universe, window_bars).where("usable").join(triggers, "symbol")
    # Half-even, as a split leaves exact half cents.
    reached = F.bround("today_high", 2) >= F.bround("trigger", 2)
    return rows.where(reached).select(
        *universe.columns, "today_high", "today_close", "prev_close", "trigger"
    )


def failed_symbols(universe: DataFrame, window_bars: DataFrame) -> DataFrame:
    """Scanned symbols with no high or fewer than two closes in the window."""
    return _priced(universe, window_bars).where("NOT usable").select("symbol")


def analyse(
    hits: DataFrame, year_bars: DataFrame, benchmark: DataFrame, verdicts: DataFrame,
    result_dates: DataFrame, as_of: Column, sessions: int = K.RS_SESSIONS,
) -> DataFrame:
    """Result row of every hit. Only the hits' own bars reach the relative strength."""
    own = year_bars.join(hits.select("symbol"), "symbol", "left_semi")
    rs = prices.relative_strength(own, benchmark, sessions)
    fetched_at = verdicts.agg(F.max("fetched_at")).scalar()
    joined = (
        verdict_state(hits, verdicts)
        .join(rs, "symbol", "left")
        .join(result_dates.select("symbol", "result_date"), "symbol", "left")
        .withColumn("fetched_at", fetched_at)
    )
    return joined.select(
        "symbol",
        F.col("today_high").alias("new_ath_price"),
        F.col("trigger").alias("trigger_price"),
        X.green_candle("today_close", "prev_close").alias("green_candle"),
        X.closed_above("today_close", "trigger").alias("close_gt_ath"),
        F.coalesce("ath_outperformance", F.lit("N/A")).alias("ath_outperformance"),
        "current_rs", "ath_rs", "profit_state",
        X.profit_is_stale("result_date", "fetched_at", as_of).alias("profit_stale"),
        "result_date",
        F.lit(None).cast("double").alias("stop_loss"),
    )


def mark_today(state: DataFrame, results: DataFrame) -> DataFrame:
    """Keep today's high next to the trigger; the trigger itself never moves in a scan."""
    seen = results.select("symbol", F.col("new_ath_price").alias("__t"))
    return state.join(seen, "symbol", "left").withColumn(
        "today_ath", F.coalesce("__t", "today_ath")
    ).select(*STATE_COLUMNS)


def promote(state: DataFrame, selected: DataFrame, event_date: Column, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Today's high becomes the trigger of the selected symbols where it is higher;
    then today's highs are cleared for everyone. A second run changes nothing."""
    marked = state.join(selected.select("symbol").distinct().withColumn("__s", F.lit(True)), "symbol", "left")
    due = X.flag(F.col("__s") & (F.col("today_ath") > F.coalesce("ath_price", F.lit(0.0))))
    new_state = marked.select(
        "symbol",
        F.when(due, F.col("today_ath")).otherwise(F.col("ath_price")).alias("ath_price"),
        F.when(due, event_date.cast("date")).otherwise(F.col("ath_date")).alias("ath_date"),
        F.lit(None).cast("double").alias("today_ath"),
        "last_split_check",
        F.when(due, as_of.cast("timestamp")).otherwise(F.col("last_updated")).alias("last_updated"),
    )
    events = _events(
        marked.where(due), "sync", as_of, event_date, F.col("ath_price"), F.col("today_ath"),
        F.col("ath_date"), event_date,
    )
    return new_state, events


def manual_edit(state: DataFrame, edits: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Set triggers by hand (``edits``: symbol, price, date). Marks every split up to
    ``as_of`` as accounted for."""
    change = edits.select("symbol", F.col("price").cast("double").alias("p"), F.col("date").cast("date").alias("d"))
    joined = state.join(change, "symbol", "full_outer")
    edited = F.col("p").isNotNull()
    new_state = joined.select(
        "symbol",
        F.coalesce("p", "ath_price").alias("ath_price"),
        F.when(edited, F.col("d")).otherwise(F.col("ath_date")).alias("ath_date"),
        "today_ath",
        F.when(edited, F.to_date(as_of)).otherwise(F.col("last_split_check")).alias("last_split_check"),
        F.when(edited, as_of.cast("timestamp")).otherwise(F.col("last_updated")).alias("last_updated"),
    )
    events = _events(
        joined.where(edited), "manual", as_of, F.col("d"), F.col("ath_price"), F.col("p"),
        F.col("ath_date"), F.col("d"),
    )
    return new_state, events


def reset(state: DataFrame, events: DataFrame, wipe_events: bool = False) -> tuple[DataFrame, DataFrame]:
    """Empty the triggers; the event log stays unless asked."""
    return state.limit(0), events.limit(0) if wipe_events else events


def repeated_splits(events: DataFrame, at_least: int = 2) -> DataFrame:
    """Symbols repaired more than once, the mark of a split applied twice."""
    return (
        events.where("source = 'split'").groupBy("symbol").agg(F.count("*").alias("split_events"))
        .where(F.col("split_events") >= at_least).orderBy(F.col("split_events").desc(), "symbol")
    )


def symbol_events(events: DataFrame, symbol: str, limit: int = 50) -> DataFrame:
    return (
        events.where(F.col("symbol") == symbol)
        .orderBy(F.col("created_at").desc(), F.col("event_date").desc(), "source")
        .limit(limit)
        .select(F.col("event_date").alias("date"), "old_price", "new_price", "source", "note", "created_at")
    )


def sync_status(results: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """How many result rows were promoted today, and whether all were. Read from the
    event log: equal prices alone also occur right after a seed."""
    today = events.where((F.col("source") == "sync") & (F.to_date("created_at") == F.to_date(as_of)))
    synced = today.select("symbol").distinct().withColumn("__s", F.lit(1))
    return results.select("symbol").join(synced, "symbol", "left").agg(
        F.count("*").alias("rows"), F.count("__s").alias("synced_today")
    ).withColumn("post_sync", (F.col("rows") > 0) & (F.col("rows") == F.col("synced_today")))
