"""The minimum-interval gate over a stream whose rows arrive out of order.

Keys are dealt over a fixed number of buckets by hash, as in ``gate``.
``transformWithState`` keeps, per bucket, the rows that the watermark has not
passed yet (list state, an Arrow table of many rows an element) and the time of
the last admitted execution of its keys (value state). One event-time timer per
bucket stands at its earliest waiting row; when the watermark passes it, all rows
up to the watermark are judged by key in event-time order and the timer moves to
the next waiting row. So the verdicts equal those of the batch gate over the same
rows, whatever the order of arrival inside the delay; rows later than the delay
are dropped before the operator and counted (``incremental.late_rows``).

Rows stay in the state until the watermark passes them: a bucket's state is its
rows of one delay. A last admitted time goes one interval after it. The operator
needs the RocksDB state store: read the stream with the session that
``state_session`` gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from feedlake.streaming.gate import BUCKETS, TIMES, judge, key_bucket, key_value, pack, pack_last, unpack, unpack_last

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of an element of the list state.
CHUNK_ROWS = 10_000


def state_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of the same cluster whose queries use the RocksDB state store; ``spark`` keeps its settings.
    ``state_partitions`` is fixed by a stream's first start; None takes the default of the cluster."""
    ours = spark.newSession()
    ours.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    ours.conf.set(PROVIDER, ROCKSDB)
    if state_partitions:
        ours.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return ours


class _OrderedGate(StatefulProcessor):
    """State of a bucket: waiting rows (key, payload as JSON, time, forced, order columns), last admitted times, timer."""

    def __init__(self, interval_us: int, row_schema: StructType, order: list[str]):
        self.interval_us, self.row_schema, self.order = interval_us, row_schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.last = handle.getValueState("last", "last binary")
        self.timer = handle.getValueState("timer", "ms long")
        self.schema = to_arrow_schema(self.row_schema)

    def _chunks(self, table: pa.Table) -> list[tuple]:
        return [(pack(table.slice(lo, CHUNK_ROWS)),) for lo in range(0, len(table), CHUNK_ROWS)]

    def _set_timer(self, at_ms: int) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if old == at_ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)
        self.timer.update((at_ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = [self.timer.get()[0]] if self.timer.exists() else []
        for pdf in rows:
            if len(pdf):  # a column of numbers with NULLs comes as floats: the schema makes them whole again
                self.waiting.appendList(self._chunks(pa.Table.from_pandas(pdf[self.schema.names], self.schema, preserve_index=False)))
                due.append(-(-int(pdf["ts_us"].min()) // 1000))
        if due:
            self._set_timer(min(due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        rows = pa.concat_tables([self.schema.empty_table(), *(unpack(chunk) for chunk, in self.waiting.get())])
        passed = pc.less_equal(rows["ts_us"], passed_us)
        due = rows.filter(passed).to_pandas().sort_values(["row_key", "ts_us", *self.order], kind="stable", na_position="first")
        last = unpack_last(self.last.get()[0]) if self.last.exists() else {}
        if len(due):
            admitted, left = judge(due["row_key"].tolist(), due["ts_us"].tolist(), due["forced"].tolist(), last, self.interval_us)
            yield pd.DataFrame({"row_json": due["row_json"].to_numpy(), "ts_us": due["ts_us"].to_numpy(),
                                "admitted": admitted, "minutes_left": left})
        wait = rows.filter(pc.invert(passed))
        if not len(wait):
            self.waiting.clear()
        elif len(due):
            self.waiting.put(self._chunks(wait))
        # after the others, whatever comes later is an interval away
        last = {k: t for k, t in last.items() if t + self.interval_us > passed_us}
        if last:
            self.last.update((pack_last(last),))
        else:
            self.last.clear()
        if len(wait):
            self._set_timer(-(-pc.min(wait["ts_us"]).as_py() // 1000))
        elif last:
            self._set_timer(-(-(max(last.values()) + self.interval_us) // 1000))

    def close(self) -> None:
        pass


def ordered_gate_stream(events: DataFrame, key: str, ts: str, interval_minutes: float, delay: str, keep=(),
                        forced: str | None = None, order_cols=(), buckets: int = BUCKETS) -> DataFrame:
    """``operators.runs.min_interval_gate`` over a stream (append mode): each row is judged once the watermark
    (``delay`` behind the latest time) has passed it. ``events`` is read with a ``state_session``.

    Rows without a key or a time cannot be judged (``gate_quarantine``); rows of one time are ordered by
    ``order_cols`` (numbers or text, NULLs first). Output: keep columns, key, ts, admitted, minutes_left.
    """
    kept = [c for c in dict.fromkeys([*keep, key]) if c != ts]
    known = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    forced_col = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    # names without a leading underscore: rows reach the processor as named tuples
    order = [f"order{i}" for i in range(len(order_cols))]
    rows = known.select(
        key_bucket(known, key, buckets).alias("bucket"), key_value(known, key).alias("row_key"), F.col(ts).cast("timestamp").alias("event_time"), F.to_json(F.struct(*kept), TIMES).alias("row_json"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"), forced_col.alias("forced"),
        *[F.col(c).alias(o) for c, o in zip(order_cols, order)]).withWatermark("event_time", delay)
    state = StructType([f for f in rows.schema.fields if f.name not in ("bucket", "event_time")])
    gated = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_OrderedGate(int(round(interval_minutes * 60_000_000)), state, order),
        outputStructType="row_json string, ts_us long, admitted boolean, minutes_left long",
        outputMode="Append", timeMode="EventTime")
    fields = StructType([events.schema[c] for c in kept])
    out = gated.withColumn("row_json", F.from_json("row_json", fields, TIMES))
    return out.select(*[F.col("row_json")[c].alias(c) for c in kept],
                      F.timestamp_micros("ts_us").cast(events.schema[ts].dataType).alias(ts), "admitted", "minutes_left")
