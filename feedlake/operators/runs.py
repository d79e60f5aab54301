"""Run history, progress snapshots and the minimum-interval gate.

Runs are an append-only event log folded per job id (narrow ``max_by``
aggregates, partial on the map side). The gate is inherently sequential per
key (only *admitted* executions move the clock), so it is the one place that
runs Python: rows are hash-partitioned by key, sorted inside partitions, and
streamed through ``mapInPandas`` in Arrow batches while the (key, last
admitted time) pair is carried from batch to batch — no key is ever
materialised as a whole group in memory.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Run statuses and default list lengths.
STATUS_RUNNING, STATUS_COMPLETED, STATUS_FAILED = "running", "completed", "failed"
RECENT_RUNS_DEFAULT = 20
# Codes of a status under a sequence number: any other, then the three by name.
CODES = range(4)


def fold_runs(events: DataFrame, job: str = "job_id", seq: str = "seq",
              started: str = "started_at", completed: str = "completed_at",
              status: str = "status", total: str = "total", error: str = "error_message",
              stale_after_hours: float | None = None, now=None) -> DataFrame:
    """One row per job from its start/update events.

    started = earliest start, completed = latest completion, status / total /
    error = the value of the latest event (by ``seq``) that carries one; of events
    equal in ``seq`` the greatest.

    The events are folded by one hash aggregate over fixed-width values: the latest
    status is a code packed under its sequence number, totals and messages are
    known by their sequence number and then fetched from the events that carry one.
    ``stale_running`` flags jobs still ``running`` after ``stale_after_hours``
    relative to ``now``. Events without a job id are not folded (see
    ``run_event_quarantine``).
    """
    known = [STATUS_COMPLETED, STATUS_FAILED, STATUS_RUNNING]  # codes 1 to 3 in ascending order; 0 is any other
    st, at = F.col(status), F.col(seq).cast("bigint")
    code = F.coalesce(F.array_position(F.lit(known), st), F.lit(0))
    packed = F.when(st.isNotNull(), at.cast("decimal(20,0)") * len(CODES) + code.cast("decimal(2,0)"))
    mine = events.filter(F.col(job).isNotNull())
    latest = (mine.groupBy(F.col(job).alias("job_id"))
              .agg(F.min(started).alias("started_at"), F.max(completed).alias("completed_at"), F.max(packed).alias("_status"),
                   F.max(F.when(F.col(total).isNotNull(), at)).alias("_total"),
                   F.max(F.when(F.col(error).isNotNull(), at)).alias("_error"), F.count(F.lit(1)).alias("n_events")))
    last_code = F.pmod("_status", F.lit(len(CODES))).cast("int")
    latest = latest.withColumns({"_code": last_code, "_status": ((F.col("_status") - last_code) / len(CODES)).cast("bigint")})
    carriers = mine.filter(F.col(total).isNotNull() | F.col(error).isNotNull() | (st.isNotNull() & (code == 0))).select(
        F.col(job).alias("_job"), at.alias("_at"), F.col(total).alias("_t"), F.col(error).alias("_e"),
        F.when(code == 0, st).alias("_s"))
    asked = (F.col("job_id") == F.col("_job")) & ((F.col("_at") == F.col("_total")) | (F.col("_at") == F.col("_error"))
                                                  | (F.col("_at") == F.col("_status")))
    met = latest.join(carriers, asked, "left").groupBy("job_id", "started_at", "completed_at", "_code", "n_events").agg(
        F.max(F.when(F.col("_at") == F.col("_total"), F.col("_t"))).alias("total"),
        F.array_max(F.collect_set(F.when(F.col("_at") == F.col("_error"), F.col("_e")))).alias("error_message"),
        F.array_max(F.collect_set(F.when(F.col("_at") == F.col("_status"), F.col("_s")))).alias("_other"))
    named = F.when(F.col("_code").isNull(), F.lit(STATUS_RUNNING)).when(F.col("_code") == 0, F.col("_other")).otherwise(
        F.element_at(F.lit(known), F.greatest("_code", F.lit(1))))
    folded = met.select(F.col("job_id").alias(job), "started_at", "completed_at", named.alias("status"), "total",
                        "error_message", "n_events")
    if stale_after_hours is not None and now is not None:
        limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(stale_after_hours * 3600)} SECONDS")
        folded = folded.withColumn("stale_running", (F.col("status") == STATUS_RUNNING)
                                   & (F.col("started_at") < limit))
    return folded


def run_event_quarantine(events: DataFrame, job: str = "job_id") -> DataFrame:
    return events.filter(F.col(job).isNull()).withColumn("reason", F.lit("missing:job_id"))


def run_summary(runs: DataFrame, started: str = "started_at", completed: str = "completed_at",
                total: str = "total") -> DataFrame:
    """Duration in seconds and mean seconds per item (0 when nothing processed)."""
    dur = (F.unix_micros(F.col(completed).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / F.lit(1_000_000.0)
    per_item = F.when(F.coalesce(F.col(total), F.lit(0)) > 0, dur / F.col(total)).otherwise(F.lit(0.0))
    return runs.withColumn("duration_s", dur).withColumn("seconds_per_item", per_item)


def recent_runs(runs: DataFrame, n: int = RECENT_RUNS_DEFAULT, started: str = "started_at",
                job: str = "job_id") -> DataFrame:
    """Latest ``n`` runs, newest first, job id on ties (TakeOrderedAndProject)."""
    return runs.orderBy(F.col(started).desc_nulls_last(), F.col(job).asc()).limit(n)


def latest_checkpoint(progress: DataFrame, order_cols=("ts",), by: str | None = None) -> DataFrame:
    """Latest progress snapshot overall, or per ``by`` key, via ``max_by`` of
    one struct (a single aggregate; partial on the map side)."""
    cols = [c for c in progress.columns if c != by]
    order = F.struct(*[F.col(c) for c in order_cols])
    agg = F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_latest")
    grouped = progress.groupBy(by).agg(agg) if by else progress.agg(agg)
    keep = [by] if by else []
    return grouped.select(*keep, "_latest.*")


# ---- minimum-interval gate ---------------------------------------------------

GATE_SCHEMA = "admitted boolean, minutes_left long"
NEVER = -(1 << 62)
# Keys with at least this many executions take the parallel path.
HOT_KEY_ROWS = 5_000_000


def _gate_batches(key: str, ts: str, forced: str | None, interval_us: int, out_cols: list[str]):
    def run(batches):
        cur_key, last = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[key].to_numpy()
            tsv = pdf[ts].to_numpy()
            forced_v = pdf[forced].fillna(False).to_numpy(dtype=bool) if forced else None
            n = len(pdf)
            admitted = np.zeros(n, dtype=bool)
            left = np.zeros(n, dtype=np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [n]])
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                if cur_key is None or keys[a] != cur_key:
                    cur_key, last = keys[a], None
                t = tsv[a:b].astype(np.int64)
                must = np.flatnonzero(forced_v[a:b]) if forced_v is not None else np.zeros(0, np.int64)
                seen = np.full(b - a, NEVER if last is None else last)
                # from admitted to admitted: the first row an interval later, or forced
                at = 0 if last is None else int(np.searchsorted(t, last + interval_us))
                at = min([at, *must[:1].tolist()])
                while at < b - a:
                    admitted[a + at], last = True, int(t[at])
                    after = must[np.searchsorted(must, at + 1):][:1].tolist()
                    step = max(at + 1, int(np.searchsorted(t, last + interval_us)))
                    step = min([step, *after])
                    seen[at:step] = last  # what refuses the rows up to the next admitted one
                    at = step
                rem = interval_us - (t - seen)
                left[a:b] = np.where(admitted[a:b], 0, -((-rem) // 60_000_000))
            out = pdf[out_cols].copy()
            out["admitted"] = admitted
            out["minutes_left"] = left
            yield out
    return run


def gate_quarantine(events: DataFrame, key: str, ts: str) -> DataFrame:
    """The rows that the gate (batch or stream) cannot judge, with a reason."""
    reason = F.when(F.col(key).isNull(), F.lit(f"missing:{key}")).otherwise(F.lit(f"missing:{ts}"))
    return events.filter(F.col(key).isNull() | F.col(ts).isNull()).withColumn("reason", reason)


def min_interval_gate(events: DataFrame, key: str, ts: str, interval_minutes: float,
                      order_cols=(), forced: str | None = None, keep=(),
                      hot_key_rows: int | None = HOT_KEY_ROWS, rows_per_bucket: int | None = None) -> DataFrame:
    """Admit an execution iff no earlier *admitted* one of the same key lies
    within the interval (elapsed >= interval admits); refused ones get the
    minutes left (ceil). ``forced`` executions are always admitted and move
    the clock. Output: keep columns, key, ts, admitted, minutes_left.

    Keys with fewer than ``hot_key_rows`` rows stream through one task each,
    in order, in Arrow batches (bounded memory). Keys at or above it take the
    exact parallel path of ``gate_parallel`` (pointer doubling). The hot keys
    are found with one partial aggregate and stay a table. Rows without a key
    or a time cannot be judged: ``gate_quarantine`` has them.
    """
    from feedlake.operators import gate_parallel as GP
    from feedlake.session import checkpoint_root

    interval_us = int(round(interval_minutes * 60_000_000))
    keep = [c for c in keep if c not in (key, ts)]
    out_cols = list(dict.fromkeys([*keep, key, ts]))
    ts_us = "_ts_us"
    cols = [*out_cols, F.unix_micros(F.col(ts).cast("timestamp")).alias(ts_us)]
    extra = [c for c in ([forced] if forced else []) + list(order_cols) if c not in out_cols]
    known = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    narrow = known.select(*cols, *[F.col(c) for c in dict.fromkeys(extra)])
    schema_fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields
                     if f.name in out_cols]
    schema = ", ".join(schema_fields + [GATE_SCHEMA])

    def sequential(df: DataFrame) -> DataFrame:
        ordered = (df.repartition(F.col(key))
                   .sortWithinPartitions(F.col(key), F.col(ts_us), *[F.col(c) for c in order_cols]))
        return ordered.mapInPandas(_gate_batches(key, ts_us, forced, interval_us, out_cols), schema)

    if hot_key_rows is None:
        return sequential(narrow)  # parallel path disabled
    checkpoint_root(events.sparkSession)
    hot_df = narrow.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_key_rows).select(key).checkpoint()
    if hot_df.isEmpty():
        return sequential(narrow)
    cold = narrow.join(hot_df, key, "left_anti")
    # number the rows in (key, time, order) order by ranges of rows, whatever the caller's columns hold;
    # the checkpoint fixes the numbers
    by = [F.col(key), F.col(ts_us), *[F.col(c) for c in order_cols]]
    hot_rows = (narrow.join(hot_df, key).repartitionByRange(*by).sortWithinPartitions(*by)
                .withColumn("_i", F.monotonically_increasing_id()).checkpoint())
    gated = GP.gate_parallel(hot_rows.select(key, F.col(ts_us).alias("t"), F.col("_i").alias("i"),
                                             *([forced] if forced else [])),
                             key, interval_us, forced, rows_per_bucket or GP.ROWS_PER_BUCKET)
    par = (hot_rows.join(gated.withColumnRenamed("i", "_i"), [key, "_i"])
           .select(*out_cols, "admitted", "minutes_left"))
    return sequential(cold).unionByName(par)
