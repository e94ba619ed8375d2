"""Lifetime highs that are kept up to date month by month.

For each symbol and month: the product of its splits, the bar whose high is the highest when it is
divided by the splits after it within the month, and the last bar. Such rows compose: the earlier
one's high is divided by the later one's splits as well, and the higher of the two stays (ties:
the earlier date). So a new day changes the row of its month only, and lifetime highs follow from
a row per symbol and month. Products are taken month by month, so for ratios other than powers of
two a high may differ from ``prices.lifetime_highs`` in its last digit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard.functions.exprs import safe_div
from panelyard.sources import manifest as M

KIND = "high_months"
COLUMNS = "symbol string, month date, ratio double, high double, inner_ratio double, ath_date date, last_bar date"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _top(adjusted: Column, date: Column, *carried: Column) -> Column:
    """The highest first, then the earliest, then what is carried along; null without a high."""
    return F.min(F.when(adjusted.isNotNull(), F.struct((-adjusted).alias("v"), date.alias("d"), *carried)))


def months(bars: DataFrame) -> DataFrame:
    """One row per symbol and month; a window holds the days of one month."""
    month = F.trunc("date", "month")
    newest_first = W.partitionBy("symbol", "month").orderBy(F.col("date").desc()).rowsBetween(W.unboundedPreceding, -1)
    ratio = F.coalesce(F.nullif("split_ratio", F.lit(0.0)), F.lit(1.0))
    within = bars.withColumn("month", month).withColumn("r", ratio).withColumn("inner_ratio", F.coalesce(F.product("r").over(newest_first), F.lit(1.0)))
    top = _top(safe_div("high", "inner_ratio"), F.col("date"), F.col("high"), F.col("inner_ratio"))
    found = within.groupBy("symbol", "month").agg(F.product("r").alias("ratio"), top.alias("t"), F.max("date").alias("last_bar"))
    return found.select("symbol", "month", "ratio", "t.high", "t.inner_ratio", F.col("t.d").alias("ath_date"), "last_bar")


def compose(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Rows of the same months, all bars of ``later`` being after those of ``earlier``."""
    a = earlier.select("symbol", "month", F.struct(*NAMES[2:]).alias("a"))
    b = later.select("symbol", "month", F.struct(*NAMES[2:]).alias("b"))
    after = F.coalesce(F.col("b.ratio"), F.lit(1.0))
    old, new = safe_div(F.col("a.high"), F.col("a.inner_ratio") * after), safe_div(F.col("b.high"), F.col("b.inner_ratio"))
    first = F.coalesce(old >= new, old.isNotNull())
    chosen = lambda x, y: F.when(first, x).otherwise(y)
    return a.join(b, ["symbol", "month"], "full_outer").select(
        "symbol", "month", (F.coalesce(F.col("a.ratio"), F.lit(1.0)) * after).alias("ratio"), chosen(F.col("a.high"), F.col("b.high")).alias("high"),
        chosen(F.col("a.inner_ratio") * after, F.col("b.inner_ratio")).alias("inner_ratio"), chosen(F.col("a.ath_date"), F.col("b.ath_date")).alias("ath_date"),
        F.coalesce("b.last_bar", "a.last_bar").alias("last_bar"),
    )


def lifetime_highs(rows: DataFrame) -> DataFrame:
    """As ``prices.lifetime_highs``, from the monthly rows; a window holds a symbol's months."""
    newest_first = W.partitionBy("symbol").orderBy(F.col("month").desc()).rowsBetween(W.unboundedPreceding, -1)
    later = rows.withColumn("after", F.coalesce(F.product("ratio").over(newest_first), F.lit(1.0)))
    top = _top(safe_div("high", F.col("inner_ratio") * F.col("after")), F.col("ath_date"))
    found = later.groupBy("symbol").agg(top.alias("t"), F.max("last_bar").alias("last_bar")).where("t IS NOT NULL")
    return found.select("symbol", (-F.col("t.v")).alias("ath_price"), F.col("t.d").alias("ath_date"), "last_bar")


# ------------------------------------------------------------------ stored
def _dated(rows: DataFrame) -> DataFrame:
    return rows.select(*NAMES, F.col("month").alias(M.DATE))


def _months_of(bars: DataFrame) -> list[str]:
    """The months that bars lie in, as text; a number of months reaches the driver."""
    return [str(r[0]) for r in bars.select(F.trunc("date", "month").alias("m")).distinct().orderBy("m").collect()]


def replace(spark: SparkSession, store: str, bars: DataFrame) -> list[str]:
    """Rows of all months of ``bars`` (whole months), made anew: the first load, or a correction."""
    held, _ = M.load(spark, store)
    named = _months_of(bars)
    M.publish(spark, store, M.stage(_dated(months(bars)), store, KIND, named), seen=held)
    return named


def append(spark: SparkSession, store: str, bars: DataFrame) -> list[str]:
    """Bars of the days after those that are held, composed onto the rows of their months; no other
    month is read. A bar that is not after its symbol's last one is refused: its month has to be
    made anew by ``replace``. Returns the months that changed."""
    seen, entries = M.load(spark, store)
    named = _months_of(bars)
    if not named:
        return []
    known = [e for e in entries if e.kind == KIND and e.snapshot_date in named]
    held = M.scan(spark, store, KIND, known).select(*NAMES) if known else spark.createDataFrame([], COLUMNS)
    late = bars.join(held.select("symbol", "last_bar"), "symbol").where("date <= last_bar").select("symbol", "date").limit(1).collect()
    if late:
        raise M.SnapshotError(f"the bar of {late[0]['symbol']} on {late[0]['date']} is not new; make its month anew")
    M.publish(spark, store, M.stage(_dated(compose(held, months(bars))), store, KIND, named), seen=seen)
    return named


def read(spark: SparkSession, store: str) -> DataFrame:
    return M.read(spark, store, KIND).select(*NAMES)


def composed(parts: list[DataFrame]) -> DataFrame:
    """Monthly rows of consecutive stretches of bars, oldest first."""
    return reduce(compose, parts)


