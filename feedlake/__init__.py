"""feedlake — a Spark-native toolkit for record feeds.

Land pages of nested JSON records, normalise them with native column
expressions, validate them into accepted and quarantined rows, merge
overlapping slices by last-write-wins, upsert into a Parquet store, and
answer search, paging, lookup, facet and report queries — all as
DataFrame plans, so the work scales with the cluster and not the driver.

Layout:
  functions/  Column -> Column helpers (text, urls, dates, json, links)
  operators/  DataFrame -> DataFrame jobs (normalise, validate, dedupe,
              upsert, search, report, links, runs)
  sources/    readers and writers (hit pages, the Parquet store)
  streaming/  Structured Streaming forms (incremental upsert, gate)
  plans/      bindings of the jobs to tables, plus their SQL oracles
"""

from feedlake.session import build_session, checkpoint_root  # noqa: F401

__all__ = ["build_session", "checkpoint_root"]
