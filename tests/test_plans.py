"""Plan checks: the physical plans we rely on at scale."""

import __spark_entry__ as E
from feedlake.plans.catalog import registry

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(plan: str) -> int:
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + \
        plan.count("Exchange SinglePartition") + plan.count("Exchange RoundRobinPartitioning")


def test_report_one_scan_two_exchanges(spark):
    plan = _plan(spark, "analytics_report")
    assert plan.count("FileScan parquet") == 1
    assert "WindowGroupLimit" in plan
    # spread (only when the scan has too few partitions) + aggregate + ranks
    assert _exchanges(plan) <= 3
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "ExistingRDD" not in plan  # seed rows are built JVM-side (spark.range), not from Python


def test_lookup_pushes_filter(spark):
    plan = _plan(spark, "lookup_by_key")
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,42)]" in plan


def test_projection_is_pruned(spark):
    plan = _plan(spark, "search_totals")
    assert "ReadSchema: struct<p_name:string,p_brand:string,p_type:string>" in plan


def test_no_python_outside_gate(spark):
    for name in registry():
        if name in ("min_interval_gate", "min_interval_gate_parallel", "min_interval_gate_stream",
                    "min_interval_gate_hot_keys",
                    "read_hit_pages", "incremental_upsert",
                    "base_urls", "base_url_census", "base_url_census_international"):  # hosts of distinct base URLs
            continue
        plan = _plan(spark, name)
        assert "PythonUDF" not in plan and "EvalPython" not in plan, name


def test_hosts_are_encoded_after_the_count(spark):
    plan = _plan(spark, "base_url_census").split("+- ")
    at = [i for i, line in enumerate(plan) if "ArrowEvalPython" in line]
    assert len(at) == 1 and sum("HashAggregate" in line for line in plan[at[0]:]) >= 2


def test_gate_streams_sorted_partitions(spark):
    plan = _plan(spark, "min_interval_gate")
    assert "MapInPandas" in plan and "Exchange hashpartitioning(user_id" in plan


def test_dedupe_prunes_before_shuffle(spark):
    plan = _plan(spark, "dedupe_last")
    assert plan.count("WindowGroupLimit") >= 1


def test_store_upsert_reads_only_touched_buckets(spark, tmp_path):
    from pyspark.sql import functions as F
    from feedlake.sources import store
    root = str(tmp_path / "s")
    batch = spark.range(40).select(F.col("id").cast("string").alias("cve_id"), F.lit("x").alias("v"), F.lit(0).alias("seq"))
    empty = spark.createDataFrame([], "cve_id string, v string, created_at timestamp, updated_at timestamp")
    store.upsert_store(spark, root, batch, "cve_id", ["seq"], "2024-01-01 00:00:00", empty, 4)
    files = store.read_store(spark, root, buckets=[1, 3]).inputFiles()
    assert files and all("/bucket=1/" in f or "/bucket=3/" in f for f in files)
    assert len(store.read_store(spark, root).inputFiles()) > len(files)


def test_upsert_shuffles_each_side_once(spark):
    plan = _plan(spark, "upsert_by_key")
    # the batch is de-duplicated on the key and that partitioning is reused by
    # the join: one hash exchange for the batch, one for the store side
    assert plan.count("Exchange hashpartitioning(event_id") == 2
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert plan.count("WindowGroupLimit") >= 1


def test_facets_partial_aggregate_then_group_limit(spark):
    plan = _plan(spark, "facet_counts")
    assert "WindowGroupLimit" in plan
    assert "partial_count" in plan


def test_document_dedupe_shuffles_digest_not_text(spark):
    plan = _plan(spark, "dedupe_documents")
    assert "Exchange hashpartitioning(digest" in plan
    import re
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert not any(re.search(r"(?<![_\w])text#", line) for line in exchanges)


def test_keyset_page_pushes_seek_and_takes_ordered(spark):
    plan = _plan(spark, "search_page_keyset")
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT), Or(Or(LessThan(o_orderdate" in plan
    assert plan.startswith("TakeOrderedAndProject(limit=20")


def test_counts_of_a_load_need_no_scan_of_their_own(spark, tmp_path):
    from pyspark.sql import functions as F
    from feedlake.operators import report as R
    rows = spark.read.parquet(f"{SF}/events.parquet")
    ok = F.col("event_type") != "error"
    seen, counts = R.observed_load(rows, ok)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CollectMetrics" in plan
    seen.write.parquet(str(tmp_path / "out"))
    summary = R.observed_summary(spark, counts)
    assert "FileScan" not in summary._jdf.queryExecution().executedPlan().toString()
    want = R.load_summary(rows, "event_id", ok).select("total", "accepted", "rejected").first()
    assert summary.first() == want


def test_run_fold_hashes(spark):
    """The fold of run events sorts nothing: hash aggregates on both sides of the exchange."""
    from feedlake.operators.runs import fold_runs
    from feedlake.plans.run_jobs import run_events
    plan = fold_runs(run_events(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert plan.count("HashAggregate(keys=[job_id") >= 2 and "partial_max" in plan
