import datetime as dt

from pyspark.sql import functions as F

from feedlake.operators import search as S
from feedlake.operators.dedupe import dedupe_last, cap_per_group
from feedlake.operators.upsert import upsert_by_key, align_schema
from feedlake.sources import store

T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 2, 1)
REC = "cve_id string, severity string, component string, description string, created_at timestamp, updated_at timestamp"
BATCH = "cve_id string, severity string, component string, description string, seq long"


def test_upsert_last_wins(spark):
    target = spark.createDataFrame([("CVE-1", "LOW", "a", "d", T0, T0), ("CVE-2", "HIGH", "b", "d", T0, T0)], REC)
    batch = spark.createDataFrame([("CVE-1", "MEDIUM", "a", "d", 1), ("CVE-1", "CRITICAL", "a", "d", 2),
                                   ("CVE-3", "LOW", "c", "d", 1)], BATCH)
    out = {r.cve_id: r for r in upsert_by_key(target, batch, "cve_id", ["seq"], T1).collect()}
    assert out["CVE-1"].severity == "CRITICAL"
    assert out["CVE-1"].created_at == T0 and out["CVE-1"].updated_at == T1
    assert out["CVE-2"].updated_at == T0
    assert out["CVE-3"].created_at == T1
    assert len(out) == 3


def test_upsert_rerun_is_noop(spark):
    target = spark.createDataFrame([("CVE-1", "LOW", "a", "d", T0, T0)], REC)
    batch = spark.createDataFrame([("CVE-1", "LOW", "a", "d", 1)], BATCH)
    once = upsert_by_key(target, batch, "cve_id", ["seq"], T1)
    twice = upsert_by_key(once, batch, "cve_id", ["seq"], T1)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_bucket_store(spark, tmp_path):
    root = str(tmp_path / "store")
    empty = spark.createDataFrame([], REC)
    b1 = spark.createDataFrame([("CVE-1", "LOW", "a", "d", 1), ("CVE-2", "HIGH", "b", "d", 1)], BATCH)
    assert store.upsert_store(spark, root, b1, "cve_id", ["seq"], T0, empty, n_buckets=4, batch_id=0)
    b2 = spark.createDataFrame([("CVE-1", "CRITICAL", "a", "d", 1)], BATCH)
    assert store.upsert_store(spark, root, b2, "cve_id", ["seq"], T1, empty, n_buckets=4, batch_id=1)
    # a replayed batch is skipped
    assert not store.upsert_store(spark, root, b1, "cve_id", ["seq"], T1, empty, n_buckets=4, batch_id=0)
    cur = {r.cve_id: (r.severity, r.created_at, r.updated_at) for r in store.read_store(spark, root).collect()}
    assert cur == {"CVE-1": ("CRITICAL", T0, T1), "CVE-2": ("HIGH", T0, T0)}


def _records(spark):
    rows = [("CVE-2024-1", "HIGH", "openssl 1.1", "x", T0, T0),
            ("CVE-2024-2", "LOW", "nginx", "y", dt.datetime(2024, 1, 2), T0),
            ("CVE-2024-3", "HIGH", "libc", "100% bad_thing", dt.datetime(2024, 1, 3), T0)]
    return spark.createDataFrame(rows, REC)


def test_filters_and_pages(spark):
    df = _records(spark)
    assert S.search_page(df, severity="HIGH").count() == 2
    assert S.search_page(df, search="OpenSSL").count() == 1
    assert [r.cve_id for r in S.search_page(df, limit=2).collect()] == ["CVE-2024-3", "CVE-2024-2"]
    assert [r.cve_id for r in S.search_page(df, limit=2, offset=2).collect()] == ["CVE-2024-1"]
    assert S.search_page(df, search="%").count() == 1  # literal, not a wildcard
    assert S.search_page(df, search="_").count() == 1
    assert S.search_page(df, search="%", wildcards=True).count() == 3
    assert (S.clamp_limit(0), S.clamp_limit(-5), S.clamp_limit("abc"), S.clamp_offset(-1)) == (100, 1, 100, 0)
    assert S.lookup_by_key(df, "CVE-2024-9").count() == 0
    keyset = S.search_page_keyset(df, after=(dt.datetime(2024, 1, 2), "CVE-2024-2"), limit=5)
    assert [r.cve_id for r in keyset.collect()] == ["CVE-2024-1"]
    t = S.search_totals(df, severity="HIGH").collect()[0]
    assert (t.total_all, t.total_matching) == (3, 2)


def test_dedupe_and_caps(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert sorted(map(tuple, dedupe_last(df, "k", ["seq"]).collect())) == [("a", 2, "y"), ("b", 1, "z")]
    assert cap_per_group(df, "k", 1, ["seq"]).count() == 2


def test_align_schema(spark):
    df = spark.createDataFrame([("CVE-1",)], "cve_id string")
    target = spark.createDataFrame([], "cve_id string, source_feeds array<string>, n long").schema
    out = align_schema(df, target, {"n": 0})
    assert out.columns == ["cve_id", "source_feeds", "n"]
    assert out.collect()[0].n == 0
    assert align_schema(out, target).schema == out.schema


def test_dedupe_narrow_and_union_slices(spark):
    from feedlake.operators.dedupe import dedupe_last_narrow, union_slices
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, seq int, v string")
    got = sorted(map(tuple, dedupe_last_narrow(df, "k", ["v"], "seq").select("k", "v", "seq").collect()))
    assert got == [("a", "y", 3), ("b", "z", 2)]
    u = union_slices({"all": df.select("k"), "linux": df.select("k").limit(1)})
    assert sorted(r.slice for r in u.collect()) == ["all", "all", "all", "linux"]


def test_store_keeps_sources_and_bucket_count_apart(spark, tmp_path):
    import pytest
    root, empty = str(tmp_path / "store"), spark.createDataFrame([], REC)
    batch = lambda k: spark.createDataFrame([(k, "LOW", "a", "d", 1)], BATCH)
    assert store.upsert_store(spark, root, batch("CVE-1"), "cve_id", ["seq"], T0, empty, 4, batch_id=0, source="one")
    assert store.upsert_store(spark, root, batch("CVE-2"), "cve_id", ["seq"], T0, empty, 4, batch_id=0, source="two")
    assert not store.upsert_store(spark, root, batch("CVE-3"), "cve_id", ["seq"], T0, empty, 4, batch_id=0, source="two")
    with pytest.raises(ValueError):
        store.upsert_store(spark, root, batch("CVE-4"), "cve_id", ["seq"], T0, empty, 8)
    assert sorted(r.cve_id for r in store.read_store(spark, root).collect()) == ["CVE-1", "CVE-2"]
    assert store.lookup(spark, root, "cve_id", "CVE-2").count() == 1 and len(store.lookup(spark, root, "cve_id", "CVE-2").inputFiles()) == 1
    # a crash between the write and the commit: the old rows stay, and the load can run again
    real = store._commit
    try:
        store._commit = lambda *a: (_ for _ in ()).throw(OSError("lost driver"))
        with pytest.raises(OSError):
            store.upsert_store(spark, root, batch("CVE-1"), "cve_id", ["seq"], T1, empty, 4, batch_id=1, source="one")
    finally:
        store._commit = real
    assert {r.updated_at for r in store.read_store(spark, root).collect()} == {T0}
    for i in range(1, 5):
        assert store.upsert_store(spark, root, batch("CVE-1"), "cve_id", ["seq"], T1, empty, 4, batch_id=i, source="one")
    assert {r.cve_id: r.updated_at for r in store.read_store(spark, root).collect()} == {"CVE-1": T1, "CVE-2": T0}


def test_upsert_refuses_null_keys(spark):
    import pytest
    target = spark.createDataFrame([], REC)
    with pytest.raises(Exception, match="NULL cve_id"):
        upsert_by_key(target, spark.createDataFrame([(None, "LOW", "a", "d", 1)], BATCH), "cve_id", ["seq"], T1).collect()


def test_search_folds_ascii_and_keeps_backslashes(spark):
    df = spark.createDataFrame([("a", "x", "A\\b", None), ("b", "É", "d", None)], "cve_id string, component string, description string, created_at timestamp")
    find = lambda q: [r.cve_id for r in S.search_page(df, search=q, wildcards=True).collect()]
    assert find("\\b") == ["a"] and find("a\\") == ["a"] and find("é") == [] and find("A%B") == ["a"]
    assert [r.cve_id for r in S.search_page_keyset(df, after=(None, "a")).collect()] == ["b"]
    assert [r.cve_id for r in S.search_page_keyset(df, after=(T0, "z")).collect()] == ["a", "b"]


def test_a_new_column_survives(spark, tmp_path):
    """A second load that adds a column: its keys carry it, all others read NULL."""
    root, empty = str(tmp_path / "store"), spark.createDataFrame([], "k string, a string, created_at timestamp, updated_at timestamp")
    first = spark.createDataFrame([(f"k{i}", "old", 0) for i in range(40)], "k string, a string, seq int")
    assert store.upsert_store(spark, root, first, "k", ["seq"], T0, empty, 4)
    second = spark.createDataFrame([("k1", "now", "new", 1), ("k99", "now", "new", 1)], "k string, a string, b string, seq int")
    assert store.upsert_store(spark, root, second, "k", ["seq"], T1, empty, 4)
    rows = store.read_store(spark, root)
    assert set(rows.columns) == {"k", "a", "b", "created_at", "updated_at", "bucket"}
    got = {r.k: (r.a, r.b, r.created_at) for r in rows.collect()}
    assert got["k1"] == ("now", "new", T0) and got["k99"] == ("now", "new", T1)
    assert len(got) == 41 and all(v == ("old", None, T0) for k, v in got.items() if k not in ("k1", "k99"))
    # a load without the column keeps what is stored
    third = spark.createDataFrame([("k1", "then", 2)], "k string, a string, seq int")
    assert store.upsert_store(spark, root, third, "k", ["seq"], T1, empty, 4)
    assert store.lookup(spark, root, "k", "k1").select("a", "b").collect() == [("then", "new")]


def test_schema_evolution_of_nested_and_wider_columns(spark, tmp_path):
    import pytest
    root = str(tmp_path / "store")
    empty = spark.createDataFrame([], "k string, n int, s struct<x:int>, l array<struct<u:string>>, created_at timestamp, updated_at timestamp")
    one = spark.createDataFrame([("a", 1, (1,), [("p",)], 0)], "k string, n int, s struct<x:int>, l array<struct<u:string>>, seq int")
    two = spark.createDataFrame([("b", 1 << 40, ("t", 2), [("q", "z")], 0)],
                                "K string, n bigint, S struct<y:string,x:int>, l array<struct<u:string,v:string>>, seq int").withColumnRenamed("K", "k")
    assert store.upsert_store(spark, root, one, "k", ["seq"], T0, empty, 2)
    assert store.upsert_store(spark, root, two, "k", ["seq"], T1, empty, 2)
    got = {r.k: (r.n, r.s, r.l) for r in store.read_store(spark, root).collect()}
    assert got == {"a": (1, (1, None), [("p", None)]), "b": (1 << 40, (2, "t"), [("q", "z")])}
    with pytest.raises(ValueError, match="n: string does not fit"):
        store.upsert_store(spark, root, spark.createDataFrame([("c", "x", 0)], "k string, n string, seq int"), "k", ["seq"], T1, empty, 2)


def test_the_first_of_two_writers_counts(spark, tmp_path):
    import pytest
    root, empty = str(tmp_path / "store"), spark.createDataFrame([], REC)
    row = lambda sev: spark.createDataFrame([("CVE-1", sev, "a", "d", 1)], BATCH)
    real = store._commit

    def overtaken(*args):
        store._commit = real
        store.upsert_store(spark, root, row("LOW"), "cve_id", ["seq"], T0, empty, 2)
        real(*args)
    try:
        store._commit = overtaken
        with pytest.raises(RuntimeError, match="another load"):
            store.upsert_store(spark, root, row("HIGH"), "cve_id", ["seq"], T0, empty, 2)
    finally:
        store._commit = real
    assert [r.severity for r in store.read_store(spark, root).collect()] == ["LOW"]


def _scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_an_absent_key_reads_no_row_group(spark, tmp_path):
    root = str(tmp_path / "store")
    empty = spark.createDataFrame([], "k string, v string, created_at timestamp, updated_at timestamp")
    batch = spark.range(0, 4000, 2).select(F.format_string("key-%06d", "id").alias("k"), F.lit("x").alias("v"), F.lit(0).alias("seq"))
    store.upsert_store(spark, root, batch, "k", ["seq"], T0, empty, 2)
    assert _scanned(store.lookup(spark, root, "k", "key-000100")) >= 1
    absent = [_scanned(store.lookup(spark, root, "k", f"key-{i:06d}")) for i in (101, 1001, 2001, 3001)]
    assert absent.count(0) >= 3  # within the range of keys: the bloom filter decides
