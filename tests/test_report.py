from pyspark.sql import functions as F

from feedlake.operators import report as R

SCHEMA = ("severity string, score double, technologies array<string>, component string, "
          "published_date date, links array<string>")


def _report(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    out = R.analytics_report(df, links="links").collect()
    return {(r.section, r.key): r for r in out}


def test_sections(spark):
    import datetime as dt
    d = dt.date
    rep = _report(spark, [
        ("HIGH", 1.0, ["Linux", "Apache"], "a", d(2024, 1, 2), ["x"]),
        ("CRITICAL", 5.0, ["Linux"], "a", d(2024, 3, 1), []),
        ("HIGH", 8.0, [], "b", None, None),
        ("", 9.5, None, "", d(2023, 12, 31), None),
    ])
    assert rep[("total", "")].n == 4
    assert rep[("severity", "HIGH")].n == 2 and rep[("severity", "CRITICAL")].n == 1
    assert ("severity", "") not in rep
    assert [rep[("score_bucket", k)].n for k in R.SCORE_LABELS] == [1, 1, 1, 1]
    assert rep[("average_score", "")].value == 5.88 and rep[("average_score", "")].text == "5.88"
    assert rep[("top_technologies", "Linux")].n == 2 and rep[("top_technologies", "Linux")].rank == 1
    assert rep[("top_components", "a")].n == 2
    assert ("top_components", "") not in rep
    assert rep[("with_links", "")].n == 1
    assert rep[("date_range", "earliest")].text == "2023-12-31"
    assert rep[("date_range", "latest")].text == "2024-03-01"


def test_buckets_zero_and_mean(spark):
    rep = _report(spark, [("LOW", 6.0, [], "x", None, None), ("LOW", 8.0, [], "x", None, None)])
    assert rep[("average_score", "")].value == 7.0
    assert rep[("score_bucket", "0-3")].n == 0 and rep[("score_bucket", "9-10")].n == 0


def test_top_ten(spark):
    rows = [("LOW", None, [f"t{i:02d}"] * (i + 1), None, None, None) for i in range(20)]
    rep = _report(spark, rows)
    tops = sorted((r.rank, k) for (s, k), r in rep.items() if s == "top_technologies")
    assert len(tops) == 10 and tops[0] == (1, "t19")


def test_empty(spark):
    rep = _report(spark, [])
    assert rep[("total", "")].n == 0
    assert rep[("average_score", "")].value == 0.0 and rep[("average_score", "")].text == "0"
    assert all(rep[("score_bucket", k)].n == 0 for k in R.SCORE_LABELS)


def test_half_up_mean(spark):
    df = spark.createDataFrame([(1.0,), (1.01,)], "score double")
    r = R.average_score(df).collect()[0]
    assert (r.avg_score, r.avg_text) == (1.01, "1.01")


def test_histogram_and_facets(spark):
    df = spark.createDataFrame([(1.0, ["a", "b"]), (3.0, ["a"]), (None, None)], "score double, tags array<string>")
    h = {r.bucket: r.n for r in R.score_histogram(df).collect()}
    assert h == {"0-3": 1, "3-7": 1, "7-9": 0, "9-10": 0}
    f = {(r.facet, r.value): r.n for r in R.facet_counts(df, {"tags": F.col("tags"), "s": F.col("score")}).collect()}
    assert f[("tags", "a")] == 2 and f[("s", "1.0")] == 1


def test_unrepresentable_scores_do_not_fail(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (1e20,), (float("inf"),)], "score double")
    r = R.average_score(df).collect()[0]
    assert (r.n_scored, r.avg_score) == (2, 2.0)
    h = {x.bucket: x.n for x in R.score_histogram(df).collect()}
    assert h["9-10"] == 2 and h["0-3"] == 1


def test_inline_records_must_be_arrays(spark):
    bodies = ['[{"severity": "HIGH"}, {"severity": null}]', ' [] ', '{"severity": "LOW"}', "[not json", "text", "", None]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    records, rejected = R.inline_records(frame, "body", "struct<severity:string>")
    assert sorted(r["severity"] or "" for r in records.collect()) == ["", "HIGH"]
    assert sorted(r["reason"] for r in rejected.collect()) == ["bad_json"] + ["not_an_array"] * 4


def test_huge_scores_fail_nothing(spark):
    data = [("LOW", v, [], "x", None, None) for v in (8e14, 8e14, 8e14, -8e14, 1e300, float("inf"), float("-inf"), float("nan"), None)]
    rep = _report(spark, data)
    assert rep[("average_score", "")].n == 4 and rep[("average_score", "")].text == "400000000000000.00"
    assert rep[("average_score", "unsummed")].n == 3
    assert sum(rep[("score_bucket", k)].n for k in R.SCORE_LABELS) == 7
    df = spark.createDataFrame(data, SCHEMA)
    assert tuple(R.average_score(df).first()) == (4, 4e14, "400000000000000.00", 3)
    many = spark.range(40).select(F.lit(9e14).alias("score"))  # the sum is beyond a bigint of units
    assert tuple(R.average_score(many).first()) == (40, 9e14, "900000000000000.00", 0)
