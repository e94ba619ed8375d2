"""Scalar expressions with the null rules the metrics need.

Every data-column division is ``try_divide`` (null instead of an ANSI error) and every
flag is total: a comparison with a null is False, never null.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelyard import constants as K


def _col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """NaN and infinities become null, so that SQL null rules apply."""
    d = _col(c).cast("double")
    # NaN sorts above infinity, so one comparison excludes both.
    return F.when(F.abs(d) < float("inf"), d)


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """``a / b``; null when the denominator is zero or the result is not finite."""
    return number(F.try_divide(_col(a).cast("double"), _col(b).cast("double")))


def pct_from(x: Column | str, ref: Column | str) -> Column:
    return (safe_div(x, ref) - 1) * 100


def signed_change(a: Column | str, base: Column | str) -> Column:
    """Change measured against the absolute base."""
    return (safe_div(a, F.abs(_col(base))) - 1) * 100


def cagr(latest: Column | str, earliest: Column | str, years: float) -> Column:
    """Compound growth in percent; defined only between two positive ends."""
    a, b = _col(latest), _col(earliest)
    return F.when((a > 0) & (b > 0), (F.pow(safe_div(a, b), F.lit(1.0 / years)) - 1) * 100)


def zero_as_null(c: Column | str) -> Column:
    return F.nullif(number(c), F.lit(0.0))


def range_position(v: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Place of ``v`` between ``lo`` and ``hi``, 0 to 100, clamped; null for no range."""
    v, lo, hi = _col(v), _col(lo), _col(hi)
    at = F.try_divide((v - lo) * 100, hi - lo)
    # greatest/least skip nulls, so the guard has to cover every input.
    return F.when(at.isNotNull() & (hi > lo), F.greatest(F.lit(0.0), F.least(F.lit(100.0), at)))


def to_snake(name: str) -> str:
    text = name.strip().lower().replace("%", " pct ").replace("&", " and ")
    return re.sub(r"[^0-9a-z]+", "_", text).strip("_")


def to_snake_col(c: Column | str) -> Column:
    text = F.lower(F.trim(_col(c)))
    text = F.replace(F.replace(text, F.lit("%"), F.lit(" pct ")), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(text, "[^0-9a-z]+", "_"), "^_+|_+$", "")


def normal_symbol(c: Column | str) -> Column:
    """Trimmed, upper case, ``_`` as ``-``; blank is null."""
    text = F.upper(F.trim(_col(c).cast("string")))
    return F.nullif(F.replace(text, F.lit("_"), F.lit("-")), F.lit(""))


def exchange(c: Column | str) -> Column:
    mentions = F.upper(_col(c).cast("string")).contains("BSE")
    return F.when(mentions, F.lit("BSE")).otherwise(F.lit("NSE"))


def ticker(symbol: Column | str, venue: Column | str) -> Column:
    suffix = reduce(
        lambda acc, kv: acc.when(_col(venue) == kv[0], F.lit(kv[1])),
        K.TICKER_SUFFIX.items(),
        F.when(F.lit(False), F.lit("")),
    ).otherwise(F.lit(K.TICKER_SUFFIX["NSE"]))
    return F.concat(_col(symbol), suffix)


def lenient_number(c: Column | str) -> Column:
    """Text that is no number becomes null."""
    return number(_col(c).try_cast("double"))


def date_in_name(c: Column | str) -> Column:
    """First ``20YY MM DD`` run in a file name, with ``-``, ``_`` or nothing between."""
    base = F.element_at(F.split(_col(c), "[/\\\\]"), -1)
    pattern = r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})"
    iso = F.concat_ws("-", *[F.regexp_extract(base, pattern, i) for i in (1, 2, 3)])
    return F.when(base.rlike(pattern), iso.try_cast("date"))


def green_candle(close: Column | str, previous: Column | str) -> Column:
    c, p = _col(close), _col(previous)
    return (
        F.when(c.isNull() | p.isNull(), "N/A").when(c >= p, "Y").otherwise("N")
    )


def closed_above(close: Column | str, trigger: Column | str) -> Column:
    c, t = _col(close), _col(trigger)
    return F.when(c.isNull() | t.isNull(), "N/A").when(c > t, "Y").otherwise("N")


def needs_check(
    seen: Column, result_date: Column | str, checked_at: Column | str, as_of: Column,
    ttl_hours: int = 24,
) -> Column:
    """Never checked, stored date already past, or no date and the last check too old."""
    due, checked = _col(result_date), _col(checked_at)
    age_limit = as_of - F.expr(f"INTERVAL {ttl_hours} HOURS")
    return (
        F.when(~flag(seen), True)
        .when(due.isNotNull(), due < F.to_date(as_of))
        .otherwise(checked.isNull() | (checked < age_limit))
    )


def profit_is_stale(result_date: Column | str, fetched_at: Column | str, as_of: Column) -> Column:
    due = _col(result_date)
    return flag((due <= F.to_date(as_of)) & (due >= F.to_date(_col(fetched_at))))


def feed_age_hours(fetched_at: Column | str, as_of: Column) -> Column:
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(
        _col(fetched_at).cast("timestamp")
    )
    return seconds / F.lit(3600.0)


def feed_is_stale(fetched_at: Column | str, as_of: Column) -> Column:
    return F.coalesce(F.to_date(_col(fetched_at)) != F.to_date(as_of), F.lit(True))


# A page as pieces, each starting with the opening or closing tag of a text element.
_PIECES = r"split({html}, '(?i)(?=</?(?:p|div|span|li)[\\s>/])')"
_PLAIN = r"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' '), '\\s+', ' '))"
_OPENS = "x RLIKE '(?i)^<(p|div|span|li)[\\\\s>/]'"
_CLOSES = "x RLIKE '(?i)^</(p|div|span|li)[\\\\s>/]'"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _announcement(html: str) -> str:
    """Text of the innermost element that holds the phrase: from the piece with the
    phrase back to the nearest element still open there, then forward to its end. Of
    several, the one with the shortest text, as the innermost has."""
    pieces = _PIECES.format(html=html)
    back = (
        "aggregate(reverse(slice(ps, 1, k)), named_struct('closed', 0, 'i', k, 'j', 0), (s, x) -> CASE "
        "WHEN s.j > 0 THEN s "
        f"WHEN {_OPENS} AND s.closed = 0 THEN named_struct('closed', 0, 'i', s.i, 'j', s.i) "
        f"WHEN {_OPENS} THEN named_struct('closed', s.closed - 1, 'i', s.i - 1, 'j', 0) "
        f"WHEN {_CLOSES} THEN named_struct('closed', s.closed + 1, 'i', s.i - 1, 'j', 0) "
        "ELSE named_struct('closed', s.closed, 'i', s.i - 1, 'j', 0) END, s -> s.j)"
    )
    forward = (
        "aggregate(slice(ps, j, size(ps)), named_struct('open', 0, 'out', '', 'over', false), (s, x) -> CASE "
        "WHEN s.over THEN s "
        f"WHEN {_OPENS} THEN named_struct('open', s.open + 1, 'out', s.out || ' ' || x, 'over', false) "
        f"WHEN {_CLOSES} AND s.open = 1 THEN named_struct('open', 0, 'out', s.out, 'over', true) "
        f"ELSE named_struct('open', s.open - CAST({_CLOSES} AS INT), 'out', s.out || ' ' || x, 'over', false) END, s -> s.out)"
    )
    holds = f"filter(sequence(1, size(ps)), i -> lower({_PLAIN.format(x='ps[i - 1]')}) LIKE '%{K.RESULT_PHRASE}%')"
    starts = f"filter(transform({holds}, k -> {back}), j -> j > 0)"
    texts = f"transform({starts}, j -> {_PLAIN.format(x=forward)})"
    shortest = f"array_min(transform({texts}, t -> named_struct('n', length(t), 't', t))).t"
    plain_page = f"lower({_PLAIN.format(x=html)})"
    return f"CASE WHEN {plain_page} LIKE '%{K.RESULT_PHRASE}%' THEN {_bound(pieces, 'ps', shortest)} END"


def result_date(html: str, as_of: Column) -> Column:
    """The announced result date in a column of pages, or null. The page is searched
    once and each step is bound to a name, so nothing is computed twice."""
    tail = r"CASE WHEN t LIKE '%:%' THEN trim(regexp_extract(t, '(?s)^[^:]*:(.*)$', 1)) ELSE t END"
    found = (
        r"initcap(lower(coalesce(nullif(regexp_extract(a, '\\d{1,2}[\\s\\-/][A-Za-z]+[\\s\\-/]\\d{4}', 0), ''), "
        r"nullif(regexp_extract(a, '\\d{4}-\\d{2}-\\d{2}', 0), ''), "
        r"nullif(regexp_extract(a, '\\d{1,2}-\\d{1,2}-\\d{4}', 0), ''))))"
    )
    formats = ("d MMMM yyyy", "d MMM yyyy", "d-M-yyyy", "yyyy-MM-dd")
    parsed = ", ".join(f"to_date(try_to_timestamp(d, '{f}'))" for f in formats)
    parts = (
        "named_struct('day', " + _bound(found, "d", f"coalesce({parsed})") + ", "
        "'ahead', CASE WHEN lower(a) LIKE '%tomorrow%' THEN 1 WHEN lower(a) LIKE '%today%' THEN 0 END)"
    )
    said = F.expr(_bound(_announcement(html), "t", _bound(tail, "a", parts)))
    today = F.to_date(as_of)
    pick = F.transform(
        F.array(said), lambda r: F.when(r["ahead"].isNotNull(), F.date_add(today, r["ahead"])).otherwise(r["day"])
    )
    return pick[0]


def tier_order(tier: Column | str) -> Column:
    """Sort key Large, Mid, Small, everything else."""
    t = _col(tier)
    return F.when(t == "Large", 1).when(t == "Mid", 2).when(t == "Small", 3).otherwise(4)


def share(cond: Column) -> Column:
    """Percentage of all rows meeting ``cond``; null counts as not met."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100


def count_where(cond: Column) -> Column:
    """Rows meeting ``cond`` as a count; null counts as not met."""
    return F.count(F.when(cond, 1))
