"""What a load writes about itself: run events and progress snapshots, two small
append-only Parquet tables beside the store.

``logged_run`` writes a run's start and its end (``operators.runs.fold_runs`` folds
them); a run that fails is logged with its error, one whose driver is lost stays
``running`` and shows up as stale. A snapshot holds the counts of one micro-batch under
a folder of that batch, so a replay overwrites its own; running totals are
derived when they are read. The payload is never copied."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.operators.runs import STATUS_COMPLETED, STATUS_FAILED, STATUS_RUNNING
from feedlake.schemas import RUN_EVENT

RUNS, PROGRESS = "runs", "progress"
SNAPSHOT = T.StructType([
    T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("accepted", T.LongType()), T.StructField("rejected", T.LongType())])
ERROR_LENGTH = 1000


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Run:
    """A run in progress; ``total`` is what its end reports."""

    def __init__(self, job_id: str) -> None:
        self.job_id, self.total = job_id, 0


def _one_row(spark: SparkSession, values: tuple, schema: T.StructType) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, schema.fields)])


def _log(spark: SparkSession, root: str, event: tuple) -> None:
    _one_row(spark, event, RUN_EVENT).write.mode("append").parquet(os.path.join(root, RUNS))


@contextmanager
def logged_run(spark: SparkSession, root: str, job_id: str | None = None) -> Iterator[Run]:
    run = Run(job_id or uuid.uuid4().hex)
    _log(spark, root, (run.job_id, 0, _now(), None, STATUS_RUNNING, None, None))
    try:
        yield run
    except BaseException as e:
        _log(spark, root, (run.job_id, 1, None, _now(), STATUS_FAILED, None, f"{type(e).__name__}: {e}"[:ERROR_LENGTH]))
        raise
    _log(spark, root, (run.job_id, 1, None, _now(), STATUS_COMPLETED, run.total, None))


def read_run_events(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, os.path.join(root, RUNS), RUN_EVENT)


def save_progress(spark: SparkSession, root: str, stream: str, batch: int, accepted: int, rejected: int) -> None:
    row = (stream, batch, _now(), accepted, rejected)
    (_one_row(spark, row, SNAPSHOT).write.mode("overwrite")
     .parquet(os.path.join(root, PROGRESS, f"of={stream}", f"at={batch}")))


def read_progress(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, ts, processed_count, current_index, accepted, rejected) per micro-batch:
    ``processed_count`` the rows accepted and ``current_index`` the rows seen so far."""
    rows = _read(spark, os.path.join(root, PROGRESS), SNAPSHOT)
    so_far = Window.partitionBy("stream").orderBy("batch")
    return rows.select(F.concat_ws("-", "stream", "batch").alias("batch_id"), "ts",
                       F.sum("accepted").over(so_far).alias("processed_count"),
                       F.sum(F.col("accepted") + F.col("rejected")).over(so_far).alias("current_index"),
                       "accepted", "rejected")
