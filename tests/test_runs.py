import datetime as dt

from feedlake.operators import runs as RU
from feedlake.schemas import RUN_EVENT, PROGRESS

T = dt.datetime(2024, 1, 1)


def test_fold_runs(spark):
    ev = spark.createDataFrame([
        ("job-1", 1, T, None, "running", None, None),
        ("job-1", 2, None, T + dt.timedelta(minutes=5), "completed", 50, None),
        (None, 3, T, None, "running", None, None),
    ], RUN_EVENT)
    out = RU.fold_runs(ev).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.job_id, r.status, r.total) == ("job-1", "completed", 50)
    assert RU.run_event_quarantine(ev).count() == 1
    s = RU.run_summary(RU.fold_runs(ev)).collect()[0]
    assert s.duration_s == 300.0 and s.seconds_per_item == 6.0


def test_recent_runs(spark):
    ev = spark.createDataFrame([(f"job-{i}", i, T + dt.timedelta(hours=i), None, "running", None, None)
                                for i in range(5)], RUN_EVENT)
    got = [r.job_id for r in RU.recent_runs(RU.fold_runs(ev), 3).collect()]
    assert got == ["job-4", "job-3", "job-2"]


def test_latest_checkpoint(spark):
    p = spark.createDataFrame([("b", T, 1, 5), ("b", T + dt.timedelta(seconds=1), 2, 15)], PROGRESS)
    r = RU.latest_checkpoint(p).collect()[0]
    assert (r.current_index, r.processed_count) == (15, 2)


def _gate(spark, minutes, forced=None):
    rows = [("k", T + dt.timedelta(minutes=m), i, (forced or [False] * len(minutes))[i])
            for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, i int, forced boolean")
    out = RU.min_interval_gate(df, "key", "ts", 60, order_cols=("i",), forced="forced", keep=("i",))
    return [(r.admitted, r.minutes_left) for r in out.orderBy("i").collect()]


def test_gate_sequential(spark):
    assert _gate(spark, [0, 40, 60, 90, 125]) == [(True, 0), (False, 20), (True, 0), (False, 30), (True, 0)]


def test_gate_boundaries(spark):
    assert _gate(spark, [0, 0]) == [(True, 0), (False, 60)]
    assert _gate(spark, [0, 120]) == [(True, 0), (True, 0)]
    # a forced run is admitted and moves the clock
    assert _gate(spark, [0, 30, 70], [False, True, False]) == [(True, 0), (True, 0), (False, 20)]


def _gate_par(spark, minutes, forced=None):
    rows = [("k", T + dt.timedelta(minutes=m), i, (forced or [False] * len(minutes))[i])
            for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, i long, forced boolean")
    out = RU.min_interval_gate(df, "key", "ts", 60, order_cols=("i",), forced="forced", keep=("i",),
                               hot_key_rows=1, rows_per_bucket=2)
    return [(r.admitted, r.minutes_left) for r in out.orderBy("i").collect()]


def test_gate_parallel_literals(spark):
    assert _gate_par(spark, [0, 40, 60, 90, 125]) == [(True, 0), (False, 20), (True, 0), (False, 30), (True, 0)]
    assert _gate_par(spark, [0, 30, 70], [False, True, False]) == [(True, 0), (True, 0), (False, 20)]


def test_gate_parallel_matches_sequential(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for k in range(3):
        t = 0.0
        for i in range(200):
            t += rnd.choice([0, 0.5, 3, 10, 25, 61, 130])
            rows.append((f"k{k}", T + dt.timedelta(minutes=t), k * 1000 + i, rnd.random() < 0.05))
    df = spark.createDataFrame(rows, "key string, ts timestamp, i long, forced boolean")
    args = dict(order_cols=("i",), forced="forced", keep=("i",))
    seq = {(r.key, r.i): (r.admitted, r.minutes_left) for r in RU.min_interval_gate(df, "key", "ts", 60, **args).collect()}
    par = {(r.key, r.i): (r.admitted, r.minutes_left)
           for r in RU.min_interval_gate(df, "key", "ts", 60, hot_key_rows=150, rows_per_bucket=5, **args).collect()}
    assert seq == par and len(seq) == 600


def test_gate_repeats_text_ids_nulls_and_chunks(spark, tmp_path):
    import random

    from feedlake.operators.runs import gate_quarantine, min_interval_gate
    from feedlake.streaming.gate import gate_stream
    base = dt.datetime(2024, 1, 1)
    rows = [("k", base + dt.timedelta(minutes=m), f"id{m % 7}") for m in range(100)] + [("k", base, "id0"), ("j", base, "x")]
    rows += [(None, base, "a"), (None, base, "b"), ("k", None, "c")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, ts timestamp, id string")
    gate = lambda hot: sorted(map(tuple, min_interval_gate(
        df, "key", "ts", 15, order_cols=("id",), keep=("id",), hot_key_rows=hot, rows_per_bucket=8).collect()))
    want = gate(None)
    assert gate(1) == want and len(want) == 102 and gate_quarantine(df, "key", "ts").count() == 3
    assert [r[2].minute + 60 * r[2].hour for r in sorted(want, key=lambda r: r[2]) if r[3] and r[1] == "k"] == [0, 15, 30, 45, 60, 75, 90]
    src = str(tmp_path / "events")
    df.coalesce(1).write.parquet(src)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        q = (gate_stream(spark.readStream.schema(df.schema).parquet(src), "key", "ts", 15, keep=("id",), order_cols=("id",))
             .writeStream.format("memory").queryName("gate_chunks").outputMode("append").start())
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, spark.table("gate_chunks").collect())) == want


def test_bucket_stream_hands_over_whole_buckets():
    import pandas as pd
    from feedlake.operators.gate_parallel import _bucket_stream
    rows = pd.DataFrame({"k": ["a"] * 9 + ["b"] * 4, "c": [0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 3, 3], "i": range(13)})
    whole = rows.groupby(["k", "c"], sort=False)["i"].apply(list).tolist()
    for size in range(1, 15):
        handed = list(_bucket_stream(lambda pdf: pdf, "k")(rows.iloc[a:a + size] for a in range(0, 13, size)))
        assert pd.concat(handed)["i"].tolist() == list(range(13))
        ends = {g[-1] for g in whole}
        assert all(h["i"].iloc[-1] in ends for h in handed)


def test_fold_takes_the_latest_event_that_carries_a_value(spark):
    import random
    from feedlake.operators.runs import fold_runs
    rng = random.Random(4)
    rows = []
    for job in range(30):
        for seq in rng.sample(range(-50, 50), rng.randint(1, 12)):
            rows.append((f"j{job}", seq * 10 ** 17, rng.choice([None, "running", "completed", "failed", "paused"]),
                         rng.choice([None, rng.randint(-5, 5)]), rng.choice([None, f"e{seq}"])))
    schema = "job_id string, seq long, status string, total long, error_message string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "CAST(NULL AS timestamp) AS started_at", "CAST(NULL AS timestamp) AS completed_at")
    got = {r.job_id: (r.status, r.total, r.error_message, r.n_events) for r in fold_runs(df).collect()}
    want = {}
    for job in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: r[1])
        last = lambda i: next((r[i] for r in reversed(mine) if r[i] is not None), None)
        want[job] = (last(2) or "running", last(3), last(4), len(mine))
    assert got == want


def test_buckets_by_rank_are_even(spark):
    """One early outlier and a burst: ranges of rows are even, results as in the plain gate."""
    from feedlake.operators import gate_parallel as GP
    rows = [("k", 0, 0, False)] + [("k", 10 ** 15 + 7 * i, i, i % 997 == 0) for i in range(1, 20000)]
    df = spark.createDataFrame(rows, "key string, t long, i long, forced boolean")
    sizes = [r["count"] for r in GP._ranges(df, 20000, 2500, "key", "t", "i").groupBy("b").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * min(sizes)
    got = {r.i: (r.admitted, r.minutes_left) for r in GP.gate_parallel(df, "key", 70_000, "forced", 2500).collect()}
    last, want = None, {}
    for _, t, i, forced in rows:
        if forced or last is None or t - last >= 70_000:
            last, want[i] = t, (True, 0)
        else:
            want[i] = (False, -((t - last - 70_000) // 60_000_000))
    assert got == want
