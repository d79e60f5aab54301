import datetime as dt
import json
import os

from pyspark.sql import functions as F

from feedlake.operators.runs import min_interval_gate
from feedlake.streaming.gate import gate_stream
from feedlake.streaming.incremental import incremental_upsert, read_records

T = dt.datetime(2024, 1, 1)


def test_gate_stream_matches_batch(spark, tmp_path):
    minutes = {"a": [0, 40, 60, 90, 125], "b": [0, 10, 200]}
    rows = [(k, T + dt.timedelta(minutes=m), i) for k, ms in minutes.items() for i, m in enumerate(ms)]
    src = str(tmp_path / "events")
    spark.createDataFrame(rows, "key string, ts timestamp, i int").write.parquet(src)
    schema = "key string, ts timestamp, i int"
    stream = spark.readStream.schema(schema).parquet(src)
    q = (gate_stream(stream, "key", "ts", 60, keep=("i",)).writeStream.format("memory")
         .queryName("gate_out").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.i): (r.admitted, r.minutes_left) for r in spark.sql("SELECT * FROM gate_out").collect()}
    batch = min_interval_gate(spark.read.parquet(src), "key", "ts", 60, order_cols=("i",), keep=("i",))
    want = {(r.key, r.i): (r.admitted, r.minutes_left) for r in batch.collect()}
    assert got == want
    assert want[("a", 1)] == (False, 20) and want[("b", 2)] == (True, 0)


def test_gate_state_is_kept_by_bucket_of_keys(spark, tmp_path):
    import random
    rng = random.Random(3)
    schema = "key double, ts timestamp, i long, must boolean"
    keys = [float(k) for k in range(80)] + [float("nan"), 0.0, -0.0, None]
    rows = [(rng.choice(keys), T + dt.timedelta(seconds=rng.randrange(60_000)), i, rng.choice([True, None, *[False] * 8])) for i in range(3000)]
    rows.sort(key=lambda r: (r[1], r[2]))
    want, last = [], {}
    for k, t, i, must in rows:  # NaN is one key, 0.0 and -0.0 are another
        k = "nan" if k != k else k
        if k is not None:
            wait = dt.timedelta(hours=1) - (t - last[k]) if k in last and not must else dt.timedelta(0)
            if wait <= dt.timedelta(0):
                last[k], wait = t, dt.timedelta(0)
            want.append((i, not wait, -((-wait) // dt.timedelta(minutes=1))))
    src, out = str(tmp_path / "events"), str(tmp_path / "out")
    for n in range(3):
        spark.createDataFrame(rows[1000 * n:1000 * n + 1000], schema).coalesce(1).write.parquet(f"{src}/f{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    for name, watermark in (("plain", None), ("marked", "1 minute")):
        q = (gate_stream(stream, "key", "ts", 60, keep=("i",), forced="must", watermark=watermark, order_cols=("i",), buckets=4)
             .writeStream.format("parquet").option("path", out + name).option("checkpointLocation", str(tmp_path / name))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 4
        got = spark.read.parquet(out + name).select("i", "admitted", "minutes_left").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def _page(path, hits):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(json.dumps({"hits": hits}) + "\n")


def test_incremental_resume(spark, tmp_path):
    src, store_root, ckpt = str(tmp_path / "src"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    h = lambda k, sev, b: {"externalId": k, "severity": sev, "baseScore": "5", "batchId": b}
    _page(os.path.join(src, "p1.json"), [h("CVE-2024-1", "LOW", "b1"), h("CVE-2024-2", "HIGH", "b1"),
                                        h("bad-key", "LOW", "b1")])
    incremental_upsert(spark, src, store_root, ckpt, "https://x/", T, max_files_per_trigger=1, n_buckets=4)
    first = {r.cve_id: r.severity for r in read_records(spark, store_root).collect()}
    assert first == {"CVE-2024-1": "LOW", "CVE-2024-2": "HIGH"}
    # second run: only the new file is read; the update wins, created_at kept
    _page(os.path.join(src, "p2.json"), [h("CVE-2024-1", "CRITICAL", "b2")])
    incremental_upsert(spark, src, store_root, ckpt, "https://x/", T + dt.timedelta(days=1),
                       max_files_per_trigger=1, n_buckets=4)
    rows = {r.cve_id: r for r in read_records(spark, store_root).collect()}
    assert rows["CVE-2024-1"].severity == "CRITICAL" and rows["CVE-2024-2"].severity == "HIGH"
    assert rows["CVE-2024-1"].created_at == T and rows["CVE-2024-1"].updated_at == T + dt.timedelta(days=1)
    q = spark.read.parquet(os.path.join(store_root, "_quarantine"))
    assert [r.reasons for r in q.collect()] == ["pattern:cve_id"]
    # the streamed store equals one batch load of the same files
    from feedlake.load import load
    acc, _, _ = load(spark, src, "https://x/", multiline=False)
    batch = sorted((r.cve_id, r.severity, r.score) for r in acc.collect())
    streamed = sorted((r.cve_id, r.severity, r.score) for r in read_records(spark, store_root).collect())
    assert batch == streamed


def test_dedupe_within_watermark(spark, tmp_path):
    from feedlake.streaming.incremental import dedupe_within_watermark
    src = str(tmp_path / "ev")
    rows = [("k1", T, 1), ("k1", T + dt.timedelta(minutes=1), 2), ("k2", T, 3)]
    spark.createDataFrame(rows, "key string, ts timestamp, v int").write.parquet(src)
    stream = spark.readStream.schema("key string, ts timestamp, v int").parquet(src)
    q = (dedupe_within_watermark(stream, "key", "ts", "1 hour").writeStream.format("memory")
         .queryName("dedup_out").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = sorted((r.key, r.v) for r in spark.sql("SELECT * FROM dedup_out").collect())
    assert [k for k, _ in got] == ["k1", "k2"]


def test_progress_is_saved_with_each_micro_batch(spark, tmp_path):
    from feedlake.operators.runs import fold_runs, latest_checkpoint
    from feedlake.sources import runlog
    src, store_root, ckpt = str(tmp_path / "src"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    h = lambda k: {"externalId": k, "severity": "LOW", "baseScore": "5"}
    _page(os.path.join(src, "p1.json"), [h("CVE-2024-1"), h("CVE-2024-2"), h("bad")])
    _page(os.path.join(src, "p2.json"), [h("CVE-2024-2"), h("CVE-2024-3")])
    incremental_upsert(spark, src, store_root, ckpt, "https://x/", T, n_buckets=2, job_id="first")
    _page(os.path.join(src, "p3.json"), [h("worse"), h("CVE-2024-4")])
    incremental_upsert(spark, src, store_root, ckpt, "https://x/", T, n_buckets=2, job_id="second")
    rows = sorted(runlog.read_progress(spark, store_root).collect(), key=lambda r: r.batch_id)
    assert [(r.processed_count, r.current_index, r.rejected) for r in rows] == [(2, 3, 1), (4, 5, 0), (5, 7, 1)]
    last = latest_checkpoint(runlog.read_progress(spark, store_root), ("ts",)).first()
    assert last.processed_count == 5
    runs = {r.job_id: (r.status, r.total) for r in fold_runs(runlog.read_run_events(spark, store_root)).collect()}
    assert runs == {"first": ("completed", 4), "second": ("completed", 1)}


def test_a_failed_run_is_logged(spark, tmp_path):
    import pytest
    from feedlake.operators.runs import fold_runs
    from feedlake.sources import runlog
    root = str(tmp_path / "store")
    assert runlog.read_run_events(spark, root).count() == 0
    with pytest.raises(RuntimeError):
        with runlog.logged_run(spark, root, "j") as run:
            run.total = 3
            raise RuntimeError("no disk")
    got = fold_runs(runlog.read_run_events(spark, root)).first()
    assert (got.status, got.total, got.error_message) == ("failed", None, "RuntimeError: no disk")
    assert got.started_at <= got.completed_at


def test_late_rows_are_counted(spark, tmp_path):
    from feedlake.streaming.incremental import dedupe_within_watermark, late_rows
    src = str(tmp_path / "ev")
    for i, (key, day) in enumerate([("a", 20), ("b", 21), ("c", 1), ("b", 21)]):
        spark.createDataFrame([(key, T + dt.timedelta(days=day))], "key string, ts timestamp").coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = (dedupe_within_watermark(stream, "key", "ts", "1 day").writeStream.format("memory")
         .queryName("late_out").outputMode("append").start())
    q.processAllAvailable()
    late = late_rows(q)
    q.stop()
    assert late == 1 and sorted(r.key for r in spark.sql("SELECT key FROM late_out").collect()) == ["a", "b"]
