"""Readers, input checks, partitioned snapshots and table sinks."""
