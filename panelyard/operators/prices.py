"""Daily bars: split adjustment, lifetime highs, last closes, relative strength.

A bar frame is (symbol, date, high, close, split_ratio) with one bar per symbol and
day, so a symbol's window holds at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard import constants as K
from panelyard.functions.exprs import number, safe_div

FIELDS = {"High": "high", "Close": "close", "Stock Splits": "split_ratio"}


def bars_from_wide(wide: DataFrame, sep: str = "|", date: str = "date", symbol: str | None = None) -> DataFrame:
    """Wide price columns to bars. Column names are ``field|ticker`` or
    ``ticker|field``; with ``symbol`` given, flat ``field`` columns of that one symbol.
    A field missing for a ticker is null there; a ticker with no field has no rows."""
    cells: dict[str, dict[str, str]] = {}
    for column in wide.columns:
        parts = column.split(sep)
        if len(parts) == 2:
            field, name = parts if parts[0] in FIELDS else parts[::-1]
            if field in FIELDS:
                cells.setdefault(name, {})[field] = column
        elif symbol and column in FIELDS:
            cells.setdefault(symbol, {})[column] = column
    rows = [
        F.struct(
            F.lit(name).alias("symbol"),
            *[
                (number(fields[f]) if f in fields else F.lit(None).cast("double")).alias(out)
                for f, out in FIELDS.items()
            ],
        )
        for name, fields in cells.items()
    ]
    long = wide.select(F.col(date).cast("date").alias("date"), F.inline(F.array(*rows)))
    return long.where("high IS NOT NULL OR close IS NOT NULL OR split_ratio IS NOT NULL").select(
        "symbol", "date", "high", "close", "split_ratio"
    )


def with_split_factor(bars: DataFrame) -> DataFrame:
    """Product of the split ratios strictly after each bar; zero or null is no split.

    Walked newest first: a frame from the start grows by one row per step, whereas a
    frame to the end would be recomputed for every bar."""
    newest_first = W.partitionBy("symbol").orderBy(F.col("date").desc()).rowsBetween(W.unboundedPreceding, -1)
    ratio = F.coalesce(F.nullif("split_ratio", F.lit(0.0)), F.lit(1.0))
    return bars.withColumn("split_factor", F.coalesce(F.product(ratio).over(newest_first), F.lit(1.0)))


def adjusted_highs(bars: DataFrame) -> DataFrame:
    return with_split_factor(bars).withColumn("adj_high", safe_div("high", "split_factor"))


def lifetime_highs(bars: DataFrame) -> DataFrame:
    """Split-adjusted lifetime high of each symbol, its first date, and the last bar."""
    adjusted = adjusted_highs(bars).groupBy("symbol").agg(
        # Ties go to the earliest date: larger value first, then smaller date.
        F.min(F.when(F.col("adj_high").isNotNull(), F.struct((-F.col("adj_high")).alias("v"), F.col("date").alias("d")))).alias("top"),
        F.max("date").alias("last_bar"),
    )
    return adjusted.where("top IS NOT NULL").select(
        "symbol", (-F.col("top.v")).alias("ath_price"), F.col("top.d").alias("ath_date"), "last_bar"
    )


def window_splits(bars: DataFrame) -> DataFrame:
    """Product of the splits in a lookback window and the latest split date."""
    hit = F.col("split_ratio") > 0
    return bars.where(hit).groupBy("symbol").agg(
        F.product("split_ratio").alias("ratio"), F.max("date").alias("split_date")
    )


def last_prices(bars: DataFrame) -> DataFrame:
    """Last non-null high, last two non-null closes and how many closes there are."""
    has_close = F.col("close").isNotNull()
    newest = F.max(F.when(has_close, F.struct("date", "close")))
    newest_first = W.partitionBy("symbol").orderBy(has_close.desc(), F.col("date").desc())
    ranked = bars.withColumn("rn", F.row_number().over(newest_first))
    return ranked.groupBy("symbol").agg(
        F.max(F.when(F.col("high").isNotNull(), F.struct("date", "high")))["high"].alias("today_high"),
        newest["close"].alias("today_close"),
        F.max(F.when((F.col("rn") == 2) & has_close, F.col("close"))).alias("prev_close"),
        F.count("close").alias("closes"),
    )


def relative_strength(
    bars: DataFrame, benchmark: DataFrame, sessions: int = K.RS_SESSIONS,
    tolerance: float = K.RS_TOLERANCE,
) -> DataFrame:
    """Strength against a benchmark, rebased to 100 at the first of the last ``sessions``
    common days. ``Y`` within the tolerance of the window's peak; too little history or
    no anchor is ``N/A``.

    ``benchmark`` (date, close) is joined as Spark sees fit by its size.
    """
    bench = benchmark.groupBy("date").agg(F.max("close").alias("bench"))
    common = (
        bars.where("close IS NOT NULL")
        .join(bench.where("bench IS NOT NULL"), "date")
        .select("symbol", "date", safe_div("close", "bench").alias("ratio"))
    )
    newest_first = W.partitionBy("symbol").orderBy(F.col("date").desc())
    tail = common.withColumn("rn", F.row_number().over(newest_first)).where(F.col("rn") <= sessions)
    summary = tail.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("rn") == sessions, F.col("ratio"))).alias("anchor"),
        F.max(F.when(F.col("rn") == 1, F.col("ratio"))).alias("last"),
        F.max("ratio").alias("top"),
    )
    usable = (F.col("n") == sessions) & F.col("anchor").isNotNull() & (F.col("anchor") != 0)
    current = F.when(usable, safe_div("last", "anchor") * 100)
    # A negative anchor cannot occur with prices, so the largest ratio is the peak.
    peak = F.when(usable, safe_div("top", "anchor") * 100)
    verdict = F.when(~usable, "N/A").when(current >= peak * tolerance, "Y").otherwise("N")
    return summary.select(
        "symbol", verdict.alias("ath_outperformance"), F.bround(current, 2).alias("current_rs"),
        F.bround(peak, 2).alias("ath_rs"),
    )


def daily_mean(bars: DataFrame) -> DataFrame:
    """Equal-weight benchmark: mean close per day, summed exactly as decimals."""
    total = F.sum(F.col("close").cast("decimal(28,10)")).cast("double")
    return bars.where("close IS NOT NULL").groupBy("date").agg(
        F.try_divide(total, F.count("close")).alias("close")
    )
