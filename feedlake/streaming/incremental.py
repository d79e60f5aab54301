"""Incremental load as a Structured Streaming query.

landed page files --readStream(json, maxFilesPerTrigger)--> hits
  --> normalise --> validate --> foreachBatch(upsert into the bucket store,
  quarantine per batch)

The stream's ``checkpointLocation`` makes a restart continue after the last
committed micro-batch (only new files are read), and the store's commit
markers make a replayed micro-batch a no-op, so the sink is idempotent.
Driven with ``trigger(availableNow=True)`` it is an incremental batch job.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlake.load import bad_reasons, normalised_pages
from feedlake.operators.normalize import drop_raw
from feedlake.operators.report import observed_load
from feedlake.operators.validate import any_failure, reasons_column, record_rules
from feedlake.schemas import CORRUPT, RECORD, SLICED_PAGE
from feedlake.sources import runlog, store
from feedlake.sources.pages import HIT_ORDER, with_page_place

QUARANTINE = "_quarantine"


def page_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1,
                multiline: bool = False) -> DataFrame:
    reader = (spark.readStream.schema(SLICED_PAGE)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT)
              .option("multiLine", str(multiline).lower()))
    return with_page_place(reader.json(source_dir))


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)


def upsert_micro_batch(spark: SparkSession, store_root: str, detail_base: str, load_time,
                       n_buckets: int = store.DEFAULT_BUCKETS, rules=None, stream_id: str = "stream"):
    """The ``foreachBatch`` function: normalise, validate, upsert, quarantine.

    Within a micro-batch the last copy of a key wins by (batchId, place as in
    ``load``); across micro-batches the later batch wins. Bad pages, bad hits
    and rejected records go to the quarantine of this stream and batch. The counts of the
    batch are observed while it is written and saved as a progress snapshot.
    """
    def run(batch_df: DataFrame, batch_id: int) -> None:
        use = rules or record_rules()
        records = normalised_pages(batch_df, detail_base).withColumn("_bad", F.col("bad").isNotNull() | any_failure(use))
        records, counts = observed_load(records, ~F.col("_bad"))
        records = records.persist()  # read the micro-batch's files once for both sides
        try:
            acc = drop_raw(records.filter(~F.col("_bad"))).withColumn("_batch", F.coalesce(F.col("batch_id"), F.lit("")))
            payload = [c for c in RECORD.fieldNames() if c not in ("created_at", "updated_at")]
            batch = acc.select(*payload, "_batch", *HIT_ORDER)
            store.upsert_store(spark, store_root, batch, "cve_id", ["_batch", *HIT_ORDER], load_time,
                               empty_records(spark), n_buckets, batch_id=batch_id, source=stream_id)
            reasons = F.array_join(F.when(F.col("bad").isNotNull(), bad_reasons()).otherwise(reasons_column(use)), ",")
            (records.filter("_bad").select("cve_id", "page_file", "hit_pos", reasons.alias("reasons"), "bad_text")
             .write.mode("overwrite").parquet(os.path.join(store_root, QUARANTINE, f"stream={stream_id}", f"batch={batch_id}")))
            runlog.save_progress(spark, store_root, stream_id, batch_id, counts.get["accepted"], counts.get["rejected"])
        finally:
            records.unpersist()
    return run


def stream_name(checkpoint_dir: str) -> str:
    return hashlib.md5(checkpoint_dir.rstrip("/").encode()).hexdigest()[:12]


def accepted_so_far(spark: SparkSession, store_root: str, checkpoint_dir: str) -> int:
    mine = runlog.read_progress(spark, store_root).filter(F.col("batch_id").startswith(stream_name(checkpoint_dir)))
    return mine.agg(F.coalesce(F.sum("accepted"), F.lit(0))).first()[0]


def incremental_upsert(spark: SparkSession, source_dir: str, store_root: str, checkpoint_dir: str,
                       detail_base: str, load_time, max_files_per_trigger: int = 1,
                       n_buckets: int = store.DEFAULT_BUCKETS, multiline: bool = False, rules=None,
                       wait: bool = True, job_id: str | None = None):
    """Start (and by default wait for) an ``availableNow`` incremental load. A
    stream is known to the store by its checkpoint folder. With ``job_id`` the run is waited
    for and logged: its start, its end with the rows accepted by it, or its error."""
    if job_id is not None:
        with runlog.logged_run(spark, store_root, job_id) as run:
            before = accepted_so_far(spark, store_root, checkpoint_dir)
            q = incremental_upsert(spark, source_dir, store_root, checkpoint_dir, detail_base, load_time,
                                   max_files_per_trigger, n_buckets, multiline, rules)
            run.total = accepted_so_far(spark, store_root, checkpoint_dir) - before
        return q
    stream_id = stream_name(checkpoint_dir)
    q = (page_stream(spark, source_dir, max_files_per_trigger, multiline)
         .writeStream
         .foreachBatch(upsert_micro_batch(spark, store_root, detail_base, load_time, n_buckets, rules, stream_id))
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True)
         .start())
    if wait:
        q.awaitTermination()
    return q


def dedupe_within_watermark(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Drop repeats of a key seen within the watermark delay (keeps the
    *first* copy). Rows later than the watermark are dropped, first copies too:
    ``late_rows`` counts them. Only a pre-filter: last-write-wins comes from the upsert."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators dropped as later than the watermark, over the
    progress it keeps (``spark.sql.streaming.numRecentProgressUpdates``)."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def read_records(spark: SparkSession, store_root: str) -> DataFrame | None:
    df = store.read_store(spark, store_root)
    return None if df is None else drop_raw(df)
