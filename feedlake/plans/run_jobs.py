"""Run history, progress and gate jobs over events.

Run events: job = 'job-<user_id>', a signup starts a run (running), a
purchase completes it (total = the value, truncated), an error fails it
(error message from props.k); clicks and views are heartbeats that carry no
status. seq = event_id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import runs as RU
from feedlake.plans.catalog import job
from feedlake.plans.tables import props_k, table

TS_FMT, TS_SQL = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"
NOW = "2024-02-01 00:00:00"
GATE_MINUTES = 360


def run_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    ts = F.col("ts").cast("timestamp")
    return ev.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.when(et == "signup", ts).alias("started_at"),
        F.when(et.isin("purchase", "error"), ts).alias("completed_at"),
        F.when(et == "signup", "running").when(et == "purchase", "completed").when(et == "error", "failed").alias("status"),
        F.when(et == "purchase", F.col("value").cast("bigint")).alias("total"),
        F.when(et == "error", F.concat(F.lit("error k="), props_k().cast("string"))).alias("error_message"),
    )


_RUN_EVENTS_SQL = """
WITH e AS (
  SELECT 'job-' || cast(user_id AS VARCHAR) AS job_id, event_id AS seq,
         CASE WHEN event_type = 'signup' THEN ts END AS started_at,
         CASE WHEN event_type IN ('purchase', 'error') THEN ts END AS completed_at,
         CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'completed'
                         WHEN 'error' THEN 'failed' END AS status,
         CASE WHEN event_type = 'purchase' THEN cast(trunc(value) AS BIGINT) END AS total,
         CASE WHEN event_type = 'error' THEN 'error k=' || cast(cast(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) END AS error_message
  FROM events),
 f AS (
  SELECT job_id, min(started_at) AS started_at, max(completed_at) AS completed_at,
         coalesce(arg_max(status, seq) FILTER (WHERE status IS NOT NULL), 'running') AS status,
         arg_max(total, seq) FILTER (WHERE total IS NOT NULL) AS total,
         arg_max(error_message, seq) FILTER (WHERE error_message IS NOT NULL) AS error_message,
         count(*) AS n_events
  FROM e WHERE job_id IS NOT NULL GROUP BY job_id)"""


def _runs_out(df):
    return df.select("job_id", F.date_format("started_at", TS_FMT).alias("started_at"),
                     F.date_format("completed_at", TS_FMT).alias("completed_at"), "status",
                     F.coalesce("total", F.lit(0)).alias("total"),
                     F.coalesce("error_message", F.lit("")).alias("error_message"), "n_events")


_RUNS_OUT_SQL = (f"job_id, strftime(started_at, '{TS_SQL}') AS started_at, strftime(completed_at, '{TS_SQL}') AS completed_at, "
                 "status, coalesce(total, 0) AS total, coalesce(error_message, '') AS error_message, n_events")


@job("fold_runs", _RUN_EVENTS_SQL + f" SELECT {_RUNS_OUT_SQL} FROM f")
def fold_runs(spark, sf_dir):
    return _runs_out(RU.fold_runs(run_events(spark, sf_dir)))


@job("stale_runs", _RUN_EVENTS_SQL + f"""
 SELECT job_id, status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AS stale_running FROM f""")
def stale_runs(spark, sf_dir):
    folded = RU.fold_runs(run_events(spark, sf_dir), stale_after_hours=48, now=NOW)
    return folded.select("job_id", F.coalesce("stale_running", F.lit(False)).alias("stale_running"))


@job("run_summary", _RUN_EVENTS_SQL + """
 SELECT job_id, (epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0 AS duration_s,
        CASE WHEN coalesce(total, 0) > 0 THEN (epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0 / total
             ELSE 0.0 END AS seconds_per_item
 FROM f""")
def run_summary(spark, sf_dir):
    s = RU.run_summary(RU.fold_runs(run_events(spark, sf_dir)))
    return s.select("job_id", "duration_s", "seconds_per_item")


@job("recent_runs", _RUN_EVENTS_SQL + f" SELECT {_RUNS_OUT_SQL} FROM f ORDER BY f.started_at DESC NULLS LAST, job_id ASC LIMIT 20")
def recent_runs(spark, sf_dir):
    return _runs_out(RU.recent_runs(RU.fold_runs(run_events(spark, sf_dir)), 20))


def progress(spark, sf_dir):
    """events as progress snapshots: batch = user, current index = event id,
    processed count = the event value truncated."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("batch-"), F.col("user_id").cast("string")).alias("batch_id"),
                     F.col("ts").cast("timestamp").alias("ts"),
                     F.col("value").cast("bigint").alias("processed_count"),
                     F.col("event_id").alias("current_index"))


@job("latest_checkpoint", f"""
SELECT 'batch-' || cast(arg_max(user_id, (ts, event_id)) AS VARCHAR) AS batch_id,
       strftime(max(ts), '{TS_SQL}') AS ts,
       arg_max(cast(trunc(value) AS BIGINT), (ts, event_id)) AS processed_count,
       arg_max(event_id, (ts, event_id)) AS current_index
FROM events""")
def latest_checkpoint(spark, sf_dir):
    latest = RU.latest_checkpoint(progress(spark, sf_dir), ("ts", "current_index"))
    return latest.select("batch_id", F.date_format("ts", TS_FMT).alias("ts"), "processed_count", "current_index")


@job("latest_checkpoint_per_batch", f"""
SELECT 'batch-' || cast(user_id AS VARCHAR) AS batch_id,
       strftime(max(ts), '{TS_SQL}') AS ts,
       arg_max(cast(trunc(value) AS BIGINT), (ts, event_id)) AS processed_count,
       arg_max(event_id, (ts, event_id)) AS current_index
FROM events GROUP BY user_id""")
def latest_checkpoint_per_batch(spark, sf_dir):
    latest = RU.latest_checkpoint(progress(spark, sf_dir), ("ts", "current_index"), by="batch_id")
    return latest.select("batch_id", F.date_format("ts", TS_FMT).alias("ts"), "processed_count", "current_index")


_GATE_US = GATE_MINUTES * 60_000_000


_GATE_SQL = f"""
WITH RECURSIVE e AS (
  SELECT event_id, user_id, ts, epoch_us(ts) AS t, event_type = 'signup' AS forced,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
 g AS (
  SELECT user_id, rn, event_id, t, true AS admitted, cast(0 AS BIGINT) AS minutes_left, t AS last_t
  FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.t,
         e.forced OR e.t - g.last_t >= {_GATE_US} AS admitted,
         CASE WHEN e.forced OR e.t - g.last_t >= {_GATE_US} THEN 0
              ELSE ({_GATE_US} - (e.t - g.last_t) + 59999999) // 60000000 END AS minutes_left,
         CASE WHEN e.forced OR e.t - g.last_t >= {_GATE_US} THEN e.t ELSE g.last_t END AS last_t
  FROM g JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1)
SELECT event_id, user_id, admitted, cast(minutes_left AS BIGINT) AS minutes_left FROM g"""


@job("min_interval_gate", _GATE_SQL)
def min_interval_gate(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("forced", F.col("event_type") == "signup")
    gated = RU.min_interval_gate(ev, key="user_id", ts="ts", interval_minutes=GATE_MINUTES,
                                 order_cols=("event_id",), forced="forced", keep=("event_id",))
    return gated.select("event_id", "user_id", "admitted", "minutes_left")


@job("min_interval_gate_parallel", _GATE_SQL)
def min_interval_gate_parallel(spark, sf_dir):
    """The same gate with every key sent down the hot-key path (pointer
    doubling over as-of successors), as a key holding a third of all rows
    would be; buckets of ~16 rows so each key spans many buckets."""
    ev = table(spark, sf_dir, "events").withColumn("forced", F.col("event_type") == "signup")
    gated = RU.min_interval_gate(ev, key="user_id", ts="ts", interval_minutes=GATE_MINUTES,
                                 order_cols=("event_id",), forced="forced", keep=("event_id",),
                                 hot_key_rows=1, rows_per_bucket=16)
    return gated.select("event_id", "user_id", "admitted", "minutes_left")


@job("min_interval_gate_stream", _GATE_SQL)
def min_interval_gate_stream(spark, sf_dir):
    """The gate as a Structured Streaming query (``applyInPandasWithState``).

    events are landed as Parquet in four sequential weekly writes, each
    hash-partitioned by user so that a user's rows of a week sit in one file;
    the stream reads a file per core in a micro-batch (file order follows the
    writes) and appends the gate's output to a Parquet sink.
    """
    import os

    from feedlake.session import scratch_path
    from feedlake.streaming.gate import gate_stream

    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "signup").alias("forced"))
    root = scratch_path(spark, "gate-stream")
    src, out = os.path.join(root, "landing"), os.path.join(root, "out")
    bounds = ["2024-01-08", "2024-01-15", "2024-01-22"]
    files = spark.sparkContext.defaultParallelism  # of a write, and of a micro-batch
    lo = None
    for k, hi in enumerate(bounds + [None]):
        part = ev
        if lo is not None:
            part = part.filter(F.col("ts") >= F.lit(lo).cast("timestamp_ntz"))
        if hi is not None:
            part = part.filter(F.col("ts") < F.lit(hi).cast("timestamp_ntz"))
        part.repartition(files, "user_id").write.mode("overwrite").parquet(os.path.join(src, f"week={k}"))
        lo = hi
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", files)
              .parquet(os.path.join(src, "week=*")))
    q = (gate_stream(stream, "user_id", "ts", GATE_MINUTES, keep=("event_id",), forced="forced", order_cols=("event_id",))
         .writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(root, "checkpoint"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "admitted", "minutes_left")


@job("min_interval_gate_out_of_order", _GATE_SQL)
def min_interval_gate_out_of_order(spark, sf_dir):
    """The gate over a stream whose rows arrive up to six hours late (``transformWithState`` with timers).

    events are landed in two writes cut by the time of arrival, each spread over files at random; the delay
    covers both writes' files in any order. A last row of its own key, a month later, moves the watermark past all
    others and itself stays waiting.
    """
    import os

    from feedlake.session import scratch_path
    from feedlake.streaming.ordered_gate import ordered_gate_stream, state_session

    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "signup").alias("forced"))
    root = scratch_path(spark, "gate-out-of-order")
    src, out = os.path.join(root, "landing"), os.path.join(root, "out")
    arrival = F.col("ts") + F.make_dt_interval(F.lit(0), F.pmod(F.xxhash64("event_id"), F.lit(6)).cast("int"))
    early = arrival < F.lit("2024-01-15").cast("timestamp_ntz")
    spread = F.xxhash64(F.lit(7), "event_id")
    files = spark.sparkContext.defaultParallelism  # of a write, and of a micro-batch
    ev.filter(early).repartition(files, spread).write.parquet(os.path.join(src, "arrived=0"))
    ev.filter(~F.coalesce(early, F.lit(False))).repartition(files, spread).write.parquet(os.path.join(src, "arrived=1"))
    last = ev.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast(ev.schema["event_id"].dataType).alias("event_id"), F.lit(-1).cast(ev.schema["user_id"].dataType).alias("user_id"),
        (F.col("ts") + F.make_dt_interval(F.lit(60))).alias("ts"), F.lit(False).alias("forced"))
    last.write.parquet(os.path.join(src, "arrived=2"))
    stream = (state_session(spark, files).readStream.schema(ev.schema).option("maxFilesPerTrigger", files)
              .parquet(os.path.join(src, "arrived=*")))
    gated = ordered_gate_stream(stream, "user_id", "ts", GATE_MINUTES, "30 days", keep=("event_id",), forced="forced",
                                order_cols=("event_id",))
    q = (gated.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(root, "checkpoint"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(gated.schema).parquet(out).select("event_id", "user_id", "admitted", "minutes_left")


HOT_GATE_MINUTES = 10
_HOT_US = HOT_GATE_MINUTES * 60_000_000


@job("min_interval_gate_hot_keys", f"""
WITH RECURSIVE e AS (
  SELECT event_id, event_type, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events),
 g AS (
  SELECT event_type, rn, event_id, true AS admitted, cast(0 AS BIGINT) AS minutes_left, t AS last_t
  FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_type, e.rn, e.event_id,
         e.t - g.last_t >= {_HOT_US} AS admitted,
         CASE WHEN e.t - g.last_t >= {_HOT_US} THEN 0
              ELSE ({_HOT_US} - (e.t - g.last_t) + 59999999) // 60000000 END AS minutes_left,
         CASE WHEN e.t - g.last_t >= {_HOT_US} THEN e.t ELSE g.last_t END AS last_t
  FROM g JOIN e ON e.event_type = g.event_type AND e.rn = g.rn + 1)
SELECT event_id, event_type, admitted, cast(minutes_left AS BIGINT) AS minutes_left FROM g""")
def min_interval_gate_hot_keys(spark, sf_dir):
    """A gate keyed by event type: five keys, each about a fifth of all rows
    (hot keys). Keys with >= 1000 executions take the parallel path, cut into
    time buckets of ~500 rows; no key is processed by a single task."""
    ev = table(spark, sf_dir, "events")
    gated = RU.min_interval_gate(ev, key="event_type", ts="ts", interval_minutes=HOT_GATE_MINUTES,
                                 order_cols=("event_id",), keep=("event_id",),
                                 hot_key_rows=1000, rows_per_bucket=500)
    return gated.select("event_id", "event_type", "admitted", "minutes_left")
