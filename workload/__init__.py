"""Frames, queries and their SQL counterparts over the benchmark tables."""
