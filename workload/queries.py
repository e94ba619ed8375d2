"""All registered queries."""

from __future__ import annotations

from workload import cross_section, over_time, profit, scanning, stored  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
