
import datetime as dt

from pyspark.sql import functions as F

from feedlake.operators import report as R
from feedlake.operators import search as S
from feedlake.operators import validate as V
from feedlake.operators.dedupe import dedupe_last
from feedlake.operators.normalize import normalize_hits
from feedlake.operators.upsert import upsert_counts
from feedlake.schemas import HIT


def _hits(spark, *rows):
    full = []
    for kw in rows:
        row = {f.name: None for f in HIT.fields}
        row.update(kw)
        full.append(row)
    return normalize_hits(spark.createDataFrame(full, HIT), "https://x/")


def test_t1_t2_technologies_stay_an_array_and_are_counted(spark):
    rec = _hits(spark, {"externalId": "CVE-2025-1", "affectedTechnologies": [{"name": "Linux", "filter": "f"}]})
    assert rec.schema["technologies"].dataType.simpleString() == "array<string>"
    top = {r.term: r.n for r in R.top_terms(rec).collect()}
    assert top == {"Linux": 1}


def test_t3_date_range_is_filled(spark):
    rec = _hits(spark, {"externalId": "CVE-2025-1", "publishedAt": "1735689600000"})
    r = R.date_range(rec).collect()[0]
    assert r.earliest == r.latest == dt.date(2025, 1, 1)


def test_t5_t7_duplicates_merged_and_rejects_counted(spark):
    rec = _hits(spark, {"externalId": "CVE-2025-1", "severity": "LOW"}, {"externalId": "CVE-2025-1", "severity": "HIGH"},
                {"externalId": "nope"})
    acc, q = V.validation_split(rec.withColumn("seq", F.monotonically_increasing_id()), V.record_rules())
    assert dedupe_last(acc, "cve_id", ["seq"]).count() == 1
    assert q.count() == 1


def test_t6_distinct_rows_reported_next_to_input_rows(spark):
    target = spark.createDataFrame([("CVE-1",)], "cve_id string")
    batch = spark.createDataFrame([("CVE-1",), ("CVE-1",), ("CVE-2",)], "cve_id string")
    r = upsert_counts(target, batch, "cve_id").collect()[0]
    assert (r.input_rows, r.distinct_keys, r.inserted, r.updated) == (3, 2, 1, 1)


def test_t10_totals_respect_filters(spark):
    df = spark.createDataFrame([("HIGH", "a"), ("LOW", "b")], "severity string, cve_id string")
    r = S.search_totals(df, severity="HIGH").collect()[0]
    assert (r.total_all, r.total_matching) == (2, 1)


def test_t11_ties_on_created_break_on_key(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("CVE-2", t), ("CVE-1", t), ("CVE-3", t)], "cve_id string, created_at timestamp")
    assert [r.cve_id for r in S.search_page(df, limit=3).collect()] == ["CVE-1", "CVE-2", "CVE-3"]


def test_t12_dates_are_utc(spark):
    rec = _hits(spark, {"externalId": "CVE-2025-1", "publishedAt": "2025-01-01T23:30:00-05:00"})
    assert rec.collect()[0].published_date == dt.date(2025, 1, 2)


def test_t14_score_parser_takes_first_number(spark):
    from feedlake.functions.text import extract_score
    df = spark.createDataFrame([("CVSS:3.1/AV:N",), ("-5",)], "v string")
    assert [r[0] for r in df.select(extract_score("v")).collect()] == [3.1, 5.0]


def test_t15_empty_technologies_accepted(spark):
    rec = _hits(spark, {"externalId": "CVE-2025-1", "affectedTechnologies": []})
    acc, q = V.validation_split(rec, V.record_rules())
    assert acc.count() == 1 and q.count() == 0


def test_t16_numeric_text_is_cast_once(spark):
    rec = _hits(spark, {"externalId": "CVE-2025-1", "epssProbability": "0.5"})
    assert rec.collect()[0].epss_probability == 0.5


def test_t17_search_is_literal(spark):
    df = spark.createDataFrame([("a%b",), ("axb",)], "cve_id string")
    assert S.filter_records(df, search="%", search_cols=("cve_id",)).count() == 1
    assert S.filter_records(df, search="a_b", search_cols=("cve_id",)).count() == 0
