"""Exact medians, quantiles and percentile ranks that hold when one group is huge.

Values are counted per (metric, group, value) with a map-side combine. The counts are sorted by
range partitioning and written once: their ranges are the buckets, and the sums of counts per
bucket and group give every bucket its first rank. Only the buckets that hold a wanted rank are
ordered, so no task sees a whole group, and a value shared by very many rows is one count.

The number of buckets follows the size of the counts (adaptive execution merges small ones).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard.functions.exprs import number
from panelyard.session import cut_lineage

SALTS = 32
OFTEN = 200  # a value held by more than this fraction of all ranked cells is joined by broadcast

# output name -> (value, probability)
Quantiles = dict[str, tuple[Column, float]]


def _in_buckets(counts: DataFrame, order: list[str], buckets: int | None) -> DataFrame:
    """``counts`` sorted into ranges, with the number of its range in ``b``. They are stored, so
    that all readers see the same ranges and nothing before them runs again."""
    ranged = counts.repartitionByRange(*([buckets] if buckets else []), *order)
    return cut_lineage(ranged.withColumn("b", F.spark_partition_id()))


def _join_same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys, keeping one copy of them."""
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys],
                     *[c for c in b.columns if c not in keys])
    cond = reduce(lambda x, y: x & y, [a[k].eqNullSafe(right[f"__{k}"]) for k in keys])
    return a.join(right, cond, how).drop(*[f"__{k}" for k in keys])


def _bucket_bases(counts: DataFrame, group: list[str]) -> DataFrame:
    """Per bucket: rows before it (``base``), rows in it (``held``), rows of the group.
    A group has a row per bucket here, so the window stays small."""
    held = counts.groupBy(*group, "b").agg(F.sum("c").alias("held"))
    ordered = W.partitionBy(*group).orderBy("b")
    return held.withColumns(
        {
            "base": F.sum("held").over(ordered) - F.col("held"),
            "n": F.sum("held").over(W.partitionBy(*group)),
        }
    )


def _bucketed(df: DataFrame, by: list[str], wanted: Quantiles, buckets: int | None) -> DataFrame:
    distinct: dict[int, Column] = {id(value): value for value, _ in wanted.values()}
    ids = {one: i for i, one in enumerate(distinct)}
    # Group columns under names of their own, apart from those used here.
    keys = [f"__k{i}" for i in range(len(by))]
    cells = F.array(*[F.struct(F.lit(i).alias("m"), number(v).alias("v")) for i, v in enumerate(distinct.values())])
    group = [*keys, "m"]
    counts = (
        df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.inline(cells))
        .where(F.col("v").isNotNull())
        .groupBy(*group, "v")
        .agg(F.count("*").alias("c"))
    )
    counts = _in_buckets(counts, [*group, "v"], buckets)
    bases = _bucket_bases(counts, group)

    # SQL text, as a frame of many metrics would else cost the driver a call per term.
    def ranks(p: float) -> tuple[str, str]:
        return f"floor({float(p)!r}D * (n - 1))", f"ceil({float(p)!r}D * (n - 1))"

    def in_bucket(value: Column, p: float) -> str:
        inside = " OR ".join(f"{rank} >= base AND {rank} < base + held" for rank in ranks(p))
        return f"m = {ids[id(value)]} AND ({inside})"

    keep = " OR ".join(sorted({f"({in_bucket(v, p)})" for v, p in wanted.values()}))
    placed = _join_same(counts, bases.where(keep), [*group, "b"]).withColumn(
        "end",
        F.col("base") + F.sum("c").over(W.partitionBy(*group, "b").orderBy("v")),
    )

    def value_at(m: int, rank: str) -> str:
        return f"max(CASE WHEN m = {m} AND {rank} >= end - c AND {rank} < end THEN v END)"

    aggs = []
    for out, (value, p) in wanted.items():
        m = ids[id(value)]
        lo, hi = ranks(p)
        at = f"{float(p)!r}D * (max(CASE WHEN m = {m} THEN n END) - 1)"
        low, high = value_at(m, lo), value_at(m, hi)
        aggs.append(F.expr(f"{low} + ({high} - {low}) * ({at} - floor({at}))").alias(out))
    found = placed.groupBy(*keys).agg(*aggs)
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *wanted)


def aggregate(
    df: DataFrame,
    by: list[str],
    plain: dict[str, Column],
    quantiles: Quantiles,
    buckets: int | None = None,
    bounded: bool = False,
) -> DataFrame:
    """``plain`` aggregates plus exact interpolated ``quantiles`` per group.

    ``buckets`` sets the number of ranges; by default the size of the counts does.
    ``bounded`` says that the rows are few by nature, as one row per column of a schema.
    """
    if bounded:
        # One value map per Column object, however many quantiles it serves.
        shared: dict[int, tuple[Column, list[tuple[str, float]]]] = {}
        for out, (value, p) in quantiles.items():
            shared.setdefault(id(value), (value, []))[1].append((out, p))
        exact = [
            F.percentile(number(v), F.array(*[F.lit(float(p)) for _, p in wanted])).alias(f"__q{i}")
            for i, (v, wanted) in enumerate(shared.values())
        ]
        picked = [
            F.col(f"__q{i}")[j].alias(out)
            for i, (_, wanted) in enumerate(shared.values()) for j, (out, _) in enumerate(wanted)
        ]
        return df.groupBy(*by).agg(*[c.alias(o) for o, c in plain.items()], *exact).select(*by, *plain, *picked)
    base = df.groupBy(*by).agg(*[c.alias(o) for o, c in (plain or {"__n": F.count("*")}).items()])
    keys = by
    if not by:
        # All rows are one group; the plain part keeps its row when there are none.
        keys = ["__all"]
        df, base = df.withColumn("__all", F.lit(0)), base.withColumn("__all", F.lit(0))
    found = _bucketed(df, keys, quantiles, buckets)
    return _join_same(base, found, keys, "left").select(*by, *plain, *quantiles)


def median(value: Column | str) -> tuple[Column, float]:
    return (F.col(value) if isinstance(value, str) else value, 0.5)


def percentile_ranks(
    df: DataFrame,
    key: str,
    metrics: list[str],
    scopes: dict[str, str | None],
    buckets: int | None = None,
) -> DataFrame:
    """One row per key with ``pct_rank_<metric>[_in_<scope>]``: average rank over the
    non-null count, times 100. ``scopes`` maps a suffix ("" = all rows) to its column.
    """
    labels = list(scopes)
    wide = df.select(
        F.col(key).alias("__key"),
        *[number(m).alias(f"v{i}") for i, m in enumerate(metrics)],
        *[
            (F.lit("") if col is None else F.col(col).cast("string")).alias(f"g{j}")
            for j, col in enumerate(scopes.values())
        ],
    )
    cells = ", ".join(
        f"named_struct('m', {i * len(labels) + j}, 'g', g{j}, 'v', v{i})" for i in range(len(metrics)) for j in range(len(labels))
    )
    long = wide.selectExpr("__key", f"inline(array({cells}))").where("v IS NOT NULL AND g IS NOT NULL")
    group = ["m", "g"]
    outs = [
        F.expr(f"max(CASE WHEN m = {i * len(labels) + j} THEN pct END)").alias(
            f"pct_rank_{metric}" + (f"_in_{label}" if label else "")
        )
        for i, metric in enumerate(metrics)
        for j, label in enumerate(labels)
    ]
    counts = _in_buckets(long.groupBy(*group, "v").agg(F.count("*").alias("c")), [*group, "v"], buckets)
    upto = F.sum("c").over(W.partitionBy(*group, "b").orderBy("v"))
    ranked = counts.join(_bucket_bases(counts, group), [*group, "b"]).withColumn("upto", upto).select(
        *group, "v", "c",
        (
            (F.col("base") + F.col("upto") - F.col("c") + (F.col("c") + 1) / 2)
            / F.col("n") * 100
        ).alias("pct"),
    )
    # Values shared by very many rows: fewer than OFTEN of them, so their ranks are broadcast, and
    # their rows are spread over salts of which the other join knows none.
    cells_ranked = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    often = F.col("c") * OFTEN > F.lit(cells_ranked)
    hot = ranked.where(often).select(*group, "v", F.col("pct").alias("pct_often"))
    spread = F.when(F.col("pct_often").isNotNull(), F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    placed = (
        long.join(F.broadcast(hot), [*group, "v"], "left").withColumn("salt", spread)
        .join(ranked.where(~often).select(*group, "v", "pct", F.lit(0).alias("salt")), [*group, "v", "salt"], "left")
        .withColumn("pct", F.coalesce("pct_often", "pct"))
    )
    return placed.groupBy(F.col("__key").alias(key)).agg(*outs)


def add_percentile_ranks(
    df: DataFrame, key: str, metrics: list[str], groups: dict[str, str],
    buckets: int | None = None,
) -> DataFrame:
    """Rank columns over the universe and within each group, joined to every row."""
    present = [m for m in metrics if m in df.columns]
    scopes: dict[str, str | None] = {"": None, **{k: v for k, v in groups.items() if v in df.columns}}
    return df.join(percentile_ranks(df, key, present, scopes, buckets), key, "left")
