"""Tables laid out in page order: deep pages by directory, searches by trigram postings."""

import datetime as dt
import random

import pytest

from feedlake.operators.search import filter_records, search_page
from feedlake.sources import ordered

T = dt.datetime(2024, 1, 1)
SCHEMA = "k string, t timestamp, sev string, a string, b string"


def _records(n=300):
    rng = random.Random(3)
    words = ["Blue", "ring", "50%_off", "héllo", "İx", "x", "", None, "tail\\end", "ring ring"]
    # a third of all rows share one time; some have none
    time = lambda i: T if i % 3 == 0 else (None if i % 17 == 0 else T + dt.timedelta(hours=rng.randrange(100)))
    return [(f"K{i:04d}", time(i), rng.choice(["HIGH", "LOW", None]), rng.choice(words), f"{rng.choice(words)} {i}")
            for i in range(n)]


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ordered") / "table")
    df = spark.createDataFrame(_records(), SCHEMA)
    ordered.write_ordered(df, path, "t", "k", facet="sev", text_cols=("a", "b"), rows_per_part=25)
    return df, path


def test_pages_equal_the_plain_page(spark, layout):
    df, path = layout
    for offset, limit in [(0, 10), (24, 3), (99, 60), (290, 50), (299, 1), (300, 5), (-4, None)]:
        want = [r.k for r in search_page(df, limit=limit, offset=offset, newest_col="t", key="k").collect()]
        assert [r.k for r in ordered.page_at(spark, path, limit, offset).collect()] == want, (offset, limit)
    for offset in (0, 40, 95, 400):
        want = [tuple(r) for r in search_page(df, severity="HIGH", limit=7, offset=offset, newest_col="t", key="k",
                                              severity_col="sev").collect()]
        assert [tuple(r) for r in ordered.page_at(spark, path, 7, offset, "HIGH").collect()] == want
    assert ordered.page_at(spark, path, 7, 0, "no such").count() == 0
    assert ordered.page_at(spark, path, 5, 10**9).count() == 0  # no sort of offset + limit rows


def _parts_read(df):
    """Folders that the scan selects while it is planned."""
    scan = df._jdf.queryExecution().sparkPlan().collectLeaves().head()
    return scan.relation().location().listFiles(scan.partitionFilters(), scan.dataFilters()).size()


def test_a_deep_page_reads_its_parts_only(spark, layout):
    _, path = layout
    assert 1 <= _parts_read(ordered.page_at(spark, path, 10, 260)) <= 3  # of about twelve parts
    sizes = [r.n for r in spark.read.parquet(f"{path}/directory").groupBy("part").sum("n").toDF("part", "n").collect()]
    assert max(sizes) <= 75 and len(sizes) >= 8  # the time that a third share is cut by key


def test_search_equals_the_full_scan(spark, layout):
    df, path = layout
    for q in ["blue", "RING", "50%_", "hél", "İx", "x", "", "l\\e", "ring r", "ring 299", "g 29", "absent text", "zz"]:
        want = sorted(r.k for r in filter_records(df, search=q, search_cols=("a", "b")).collect())
        got = sorted(r.k for r in ordered.search_ordered(spark, path, q).collect())
        assert got == want, q


def test_a_rare_text_reads_few_parts(spark, layout):
    _, path = layout
    every = spark.read.parquet(f"{path}/directory").select("part").distinct().count()
    assert ordered.parts_with(spark, path, "absent text") == []
    assert ordered.parts_with(spark, path, "x") is None  # too short for a trigram
    assert len(ordered.parts_with(spark, path, " 137")) < every / 2
    assert _parts_read(ordered.search_ordered(spark, path, " 137")) < every / 2


def test_empty_table_and_clashing_names(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    path = str(tmp_path / "empty")
    ordered.write_ordered(empty, path, "t", "k", facet="sev", text_cols=("a",))
    assert ordered.page_at(spark, path, 5, 0).count() == 0
    assert ordered.search_ordered(spark, path, "blue").count() == 0
    with pytest.raises(ValueError, match="part"):
        ordered.write_ordered(empty.withColumnRenamed("a", "Part"), str(tmp_path / "x"), "t", "k")
    names = spark.createDataFrame([("k1", T, 1, "blue", 2)], "k string, t timestamp, n int, gram string, facet int")
    ordered.write_ordered(names, str(tmp_path / "names"), "t", "k", facet="facet", text_cols=("gram",))
    assert [tuple(r) for r in ordered.page_at(spark, str(tmp_path / "names"), 5, 0, "2").collect()] == [("k1", T, 1, "blue", 2)]
    assert ordered.search_ordered(spark, str(tmp_path / "names"), "LUE").count() == 1
