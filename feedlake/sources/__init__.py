"""Readers and writers: landed hit pages and the versioned Parquet store."""
