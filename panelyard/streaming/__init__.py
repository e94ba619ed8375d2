"""Incremental arrival of daily bars."""
