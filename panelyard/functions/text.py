"""SQL text of the null-safe arithmetic, for wide projections: one parse per column
instead of a call into the JVM per operation."""

from __future__ import annotations


def finite(x: str) -> str:
    """NaN and infinities become null."""
    return f"(CASE WHEN abs(CAST({x} AS DOUBLE)) < DOUBLE('Infinity') THEN CAST({x} AS DOUBLE) END)"


def nonzero(x: str) -> str:
    """As ``finite``, with zero as null too."""
    return f"nullif({finite(x)}, 0D)"


def ratio(a: str, b: str) -> str:
    """Null for a zero denominator and for a result that is not finite."""
    return finite(f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))")


def away(x: str, ref: str) -> str:
    """Distance from a reference in percent."""
    return f"({ratio(x, ref)} - 1) * 100"


def change(a: str, base: str) -> str:
    """Change against the absolute base in percent."""
    return f"({ratio(a, f'abs({base})')} - 1) * 100"


def growth(latest: str, earliest: str, years: float) -> str:
    """Compound growth in percent, only between two positive ends."""
    both = f"{latest} > 0 AND {earliest} > 0"
    return f"CASE WHEN {both} THEN (power({ratio(latest, earliest)}, 1D / {years}D) - 1) * 100 END"


def total(condition: str) -> str:
    """A condition that is never null."""
    return f"coalesce({condition}, false)"
