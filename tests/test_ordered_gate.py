"""The gate over a stream that arrives out of order, against the batch gate."""

import datetime as dt
import os
import random

from feedlake.operators.runs import min_interval_gate
from feedlake.streaming.incremental import late_rows
from feedlake.streaming.ordered_gate import PROVIDER, ordered_gate_stream, state_session

T = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, i long, forced boolean, note string"


def _run(spark, files, tmp_path, delay, name):
    """Lands one file after the other, a micro-batch each; returns the verdicts and the rows dropped as late."""
    src, out = str(tmp_path / f"{name}-src"), str(tmp_path / f"{name}-out")
    os.makedirs(src)
    stream = state_session(spark, 2).readStream.schema(SCHEMA).parquet(src + "/*")
    gated = ordered_gate_stream(stream, "key", "ts", 60, delay, keep=("i", "note"), forced="forced", order_cols=("i",))
    late = 0
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/f{n}")
        q = (gated.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-ck"))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        late += late_rows(q)
    return {(r.key, r.i): r for r in spark.read.parquet(out).collect()}, late


def test_shuffled_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), T + dt.timedelta(minutes=rng.randrange(600), microseconds=rng.randrange(10**6)), i,
             rng.random() < 0.1 or None, rng.choice([None, "x\"y", "é"])) for i in range(160)]
    rows += [("a", T, 900, None, None), ("a", T, 901, None, None)]  # equal times: by order column
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(90)))  # up to 90 minutes out of order
    end = [("end", T + dt.timedelta(days=3), 999, None, None)]
    got, late = _run(spark, [rows[:90], rows[90:], end], tmp_path, "100 minutes", "shuffled")
    batch = min_interval_gate(spark.createDataFrame(rows, SCHEMA), "key", "ts", 60, order_cols=("i",), forced="forced",
                              keep=("i", "note"))
    want = {(r.key, r.i): r for r in batch.collect()}
    assert late == 0 and len(want) == 162
    assert {k: (v.ts, v.note, v.admitted, v.minutes_left) for k, v in got.items()} == {
        k: (v.ts, v.note, v.admitted, v.minutes_left) for k, v in want.items()}


def test_rows_later_than_the_delay_are_counted(spark, tmp_path):
    before = spark.conf.get(PROVIDER, None)
    at = lambda m, i: ("a", T + dt.timedelta(minutes=m), i, None, None)
    files = [[at(0, 0), at(300, 1)], [at(100, 2), at(295, 3), (None, T, 4, None, None)], [at(2000, 5)]]
    got, late = _run(spark, files, tmp_path, "10 minutes", "late")
    assert late == 1  # minute 100 came after the watermark had passed minute 290
    assert {k[1]: v.admitted for k, v in got.items()} == {0: True, 3: True, 1: False}
    assert spark.conf.get(PROVIDER, None) == before


def test_state_is_kept_by_bucket_of_keys(spark, tmp_path):
    rng = random.Random(11)
    rows = [(f"k{rng.randrange(60)}", T + dt.timedelta(seconds=rng.randrange(40_000)), i, rng.random() < 0.1, None)
            for i in range(1500)]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    stream = state_session(spark, 2).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    gated = ordered_gate_stream(stream, "key", "ts", 60, "5 hours", keep=("i",), forced="forced", order_cols=("i",), buckets=3)
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(240)))
    end = [("end", T + dt.timedelta(days=3), 9999, None, None)]
    for n, part in enumerate([rows[:500], rows[500:1000], rows[1000:], end]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{src}/f{n}")
    q = (gated.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    # of 60 keys: a few elements of rows, a table of last times and a timer for each of 3 buckets
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 3 * 10
    batch = min_interval_gate(spark.createDataFrame(rows, SCHEMA), "key", "ts", 60, order_cols=("i",), forced="forced", keep=("i",))
    verdict = lambda r: (r.key, r.i, r.ts, r.admitted, r.minutes_left)
    assert late_rows(q) == 0
    assert sorted(map(verdict, spark.read.parquet(out).collect())) == sorted(map(verdict, batch.collect()))
