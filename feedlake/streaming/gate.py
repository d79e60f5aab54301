"""The minimum-interval gate over a stream (``applyInPandasWithState``).

Keys are dealt over a fixed number of buckets by hash, and a bucket is the group
of the stateful operator: its state is a table of the last admitted execution
(epoch microseconds) of each of its keys, and Python is called once per bucket
and micro-batch, however many keys there are. Rows of a key inside a micro-batch
are handled in event-time order; a row that arrives after a later admitted one is
judged against the current clock (it never re-admits earlier history). With a
watermark a key leaves the table once the watermark passes ``last admitted +
interval`` — any later on-time row would be admitted anyway — so state stays
bounded by the keys active within one interval. A bucket's rows of one
micro-batch are handled by one task, so the trigger size (``maxFilesPerTrigger``)
bounds the work per batch, that of a hot key too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, FloatType, IntegralType, StringType

#: Buckets of keys; the number is fixed by a stream's first start, as its state is kept by bucket.
BUCKETS = 512
STATE_SCHEMA = "last binary"
TIMES = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def key_value(df: DataFrame, key: str) -> Column:
    """The key as a number or text of its own, equal where ``groupBy`` finds keys equal."""
    kind, col = df.schema[key].dataType, F.col(key)
    if isinstance(kind, IntegralType):
        return col.cast("long")
    if isinstance(kind, StringType):
        return col
    if isinstance(kind, (DoubleType, FloatType)):
        col = col + F.lit(0.0).cast(kind)  # -0.0 and 0.0 are one key
    return F.to_json(F.struct(col.alias("k")), TIMES)


def key_bucket(df: DataFrame, key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key_value(df, key)), F.lit(buckets)).cast("int")


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def pack_last(last: dict) -> bytes:
    return pack(pa.table({"key": list(last), "us": pa.array(last.values(), pa.int64())}))


def unpack_last(blob: bytes) -> dict:
    table = unpack(blob)
    return dict(zip(table["key"].to_pylist(), table["us"].to_pylist()))


def judge(keys: list, times: list[int], forced: list[bool], last: dict, interval_us: int) -> tuple[list[bool], list[int]]:
    """(admitted, minutes left) of rows in the order of key and time. ``last``, the last
    admitted time of each key, is brought up to date."""
    admitted, left = [], []
    key, at = object(), None
    for k, t, f in zip(keys, times, forced):
        if k != key:
            if at is not None:
                last[key] = at
            key, at = k, last.get(k)
        if f or at is None or t - at >= interval_us:
            admitted.append(True)
            left.append(0)
            at = t
        else:
            admitted.append(False)
            left.append(-((-(interval_us - (t - at))) // 60_000_000))
    if at is not None:
        last[key] = at
    return admitted, left


def _gate_fn(interval_us: int, order: list[str], drop: list[str], use_timeout: bool):
    def fn(bucket, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = unpack_last(state.get[0]) if state.exists else {}
        chunks = [pdf for pdf in pdfs if len(pdf)]
        if chunks:  # the whole micro-batch in order, however Arrow cut it
            pdf = pd.concat(chunks, ignore_index=True).sort_values(["_key", "_ts_us", *order], kind="stable")
            admitted, left = judge(pdf["_key"].tolist(), pdf["_ts_us"].tolist(), pdf["_forced"].tolist(), last, interval_us)
            out = pdf.drop(columns=drop)
            out["admitted"] = admitted
            out["minutes_left"] = left
            yield out
        expires_ms = {k: t // 1000 + interval_us // 1000 for k, t in last.items()} if use_timeout else {}
        if use_timeout:  # of the keys that go, any later on-time row is admitted anyway
            passed = state.getCurrentWatermarkMs()
            last = {k: t for k, t in last.items() if expires_ms[k] > passed}
        if last:
            state.update((pack_last(last),))
            if use_timeout:
                state.setTimeoutTimestamp(max(expires_ms[k] for k in last))
        elif state.exists:
            state.remove()
    return fn


def gate_stream(events: DataFrame, key: str, ts: str, interval_minutes: float, keep=(),
                forced: str | None = None, watermark: str | None = None, order_cols=(), buckets: int = BUCKETS) -> DataFrame:
    """Streaming form of ``operators.runs.min_interval_gate`` (append mode);
    rows without a key or time are left out, as there (``gate_quarantine``)."""
    interval_us = int(round(interval_minutes * 60_000_000))
    if watermark:
        events = events.withWatermark(ts, watermark)
    cols = list(dict.fromkeys([*keep, key, ts]))
    extra = [c for c in dict.fromkeys(order_cols) if c not in cols]
    events = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    forced_col = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    narrow = events.select(*cols, *extra, F.unix_micros(F.col(ts).cast("timestamp")).alias("_ts_us"), forced_col.alias("_forced"),
                           key_value(events, key).alias("_key"), key_bucket(events, key, buckets).alias("_bucket"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name in cols]
    out_schema = ", ".join(fields + ["admitted boolean", "minutes_left long"])
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    drop = ["_ts_us", "_forced", "_key", "_bucket", *extra]
    return narrow.groupBy("_bucket").applyInPandasWithState(
        _gate_fn(interval_us, list(order_cols), drop, bool(watermark)), out_schema, STATE_SCHEMA, "append", timeout)
