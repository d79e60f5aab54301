"""Job registry: name -> (spark job, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

JOBS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def job(name: str, oracle: str | None = None):
    def deco(fn):
        JOBS[name] = (fn, oracle)
        return fn
    return deco


def registry() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    # importing the binding modules fills JOBS
    from feedlake.plans import (  # noqa: F401
        report_jobs, record_jobs, search_jobs, text_jobs, merge_jobs, run_jobs, stream_jobs)
    return dict(JOBS)
