"""Structured Streaming forms of the load (incremental upsert, interval gate)."""
