"""Cross-sectional, period-history and price-bar analytics as Spark DataFrame operators."""

__all__ = ["constants", "session", "functions", "sources", "operators", "plans", "streaming"]
