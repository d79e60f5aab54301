import json

from feedlake.operators import validate as V
from feedlake.operators.normalize import normalize_hits
from feedlake.schemas import HIT


def _hit(**kw):
    row = {f.name: None for f in HIT.fields}
    row.update({"externalId": "CVE-2024-123456789", "severity": "HIGH", "baseScore": "7.5"})
    row.update(kw)
    return row


def _accepted(spark, hits):
    df = normalize_hits(spark.createDataFrame(hits, HIT), "https://x/")
    reasoned = V.with_reasons(df, V.record_rules()).collect()
    return [len(r.reasons) == 0 for r in reasoned], [r.reasons for r in reasoned]


def test_accepted_cases(spark):
    ok, _ = _accepted(spark, [
        _hit(), _hit(severity="LOW"), _hit(severity="MEDIUM"), _hit(severity="CRITICAL"),
        _hit(severity=""), _hit(baseScore=None), _hit(severity=None), _hit(baseScore=None, score="foo"),
        _hit(affectedTechnologies=[]),
    ])
    assert all(ok)


def test_rejected_cases(spark):
    ok, reasons = _accepted(spark, [
        _hit(externalId="INVALID-ID"), _hit(externalId=None), _hit(baseScore="11"), _hit(baseScore="-1"),
        _hit(externalId="CVE-2024-1\n"), _hit(externalId="cve-2024-1"), _hit(severity="high"),
        _hit(epssPercentile="101"), _hit(epssProbability="1.5"),
    ])
    assert not any(ok)
    assert "missing:cve_id" in reasons[1]
    assert "domain:severity" in reasons[6]


def test_split_and_counts(spark):
    df = normalize_hits(spark.createDataFrame([_hit(), _hit(externalId="bad"), _hit(baseScore="11")], HIT), "https://x/")
    acc, q = V.validation_split(df, V.record_rules())
    assert acc.count() == 1 and q.count() == 2
    assert not [c for c in acc.columns if c.endswith("_raw")]
    reasons = {r.reason: r.n for r in V.validation_reasons(df, V.record_rules()).collect()}
    assert reasons == {"pattern:cve_id": 1, "range:score": 1, "range:base_score": 1}


def test_summary(spark):
    df = spark.createDataFrame([("CVE-2024-1",), ("nope",), (None,)], "cve_id string")
    r = V.validation_summary(df).collect()[0]
    assert (r.total, r.valid, r.invalid, r.status) == (3, 1, 2, "FAILED")
    empty = V.validation_summary(df.limit(0)).collect()[0]
    assert (empty.total, empty.status) == (0, "PASSED")


def test_technology_names(spark):
    ok, reasons = _accepted(spark, [_hit(affectedTechnologies=[("a", "f")]), _hit(affectedTechnologies=[("a", "f"), (None, "f")]),
                                    _hit(affectedTechnologies=[("", None)])])
    assert ok == [True, False, False] and reasons[1] == reasons[2] == ["bad_item:technologies"]


def test_link_entries(spark):
    cases = [([("t", "https://a.b/c")], False), (None, False), ([], False), ([("", "https://a.b")], True), ([(None, "https://a.b")], True),
             ([("t", "no uri")], True), ([("t", "/rel")], True), ([("t", None)], True), ([None], True), ([("t", "mailto:x")], False)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, links array<struct<title:string,url:string>>")
    code, fails = V.rule_links("links")
    assert code == "bad_item:links"
    assert [r[0] for r in df.orderBy("i").select(fails).collect()] == [bad for _, bad in cases]


def test_wrong_types_are_named(spark):
    wrong = {"hasFix": "yes", "hasCisaKevExploit": 1, "isHighProfileThreat": [], "exploitable": {}, "cvss2": "x", "cvss3": [1],
             "aiDescription": True, "sourceFeeds": "feed", "affectedTechnologies": {"name": "n"}, "affectedSoftware": [{"a": 1}]}
    right = {"hasFix": True, "hasCisaKevExploit": None, "cvss2": {"v": 1}, "cvss3": {}, "sourceFeeds": [{"name": "n"}], "aiDescription": None,
             "affectedTechnologies": [], "affectedSoftware": ["s"], "severity": 5}
    texts = [json.dumps(right), "{cut", None, *[json.dumps({f: v}) for f, v in wrong.items()], json.dumps(wrong)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(V.hit_type_reasons("t")).collect()]
    assert got[:3] == [[], [], []]
    assert got[3:-1] == [[f"bad_type:{f}"] for f in wrong]
    assert sorted(got[-1]) == sorted(f"bad_type:{f}" for f in wrong)
