import datetime as dt

from feedlake.operators.normalize import normalize_hits
from feedlake.schemas import HIT

BASE = "https://records.example.org/cve/"


def _hit(**kw):
    row = {f.name: None for f in HIT.fields}
    row.update(kw)
    return row


def _norm(spark, hits):
    df = spark.createDataFrame(hits, HIT)
    return normalize_hits(df, BASE).collect()


def test_score_fallbacks(spark):
    out = _norm(spark, [
        _hit(externalId="CVE-2025-0001", baseScore="9", cnaScore="7", cvssScore="5"),
        _hit(externalId="CVE-2025-0002", cnaScore="7", cvssScore="5"),
        _hit(externalId="CVE-2025-0003", cvssScore="5"),
        _hit(externalId="CVE-2025-0004", baseScore="0", cnaScore="7"),
        _hit(externalId="CVE-2025-0005", baseScore="foo", cnaScore="7"),
    ])
    assert [r.score for r in out] == [9.0, 7.0, 5.0, 0.0, None]


def test_defaults_and_key(spark):
    out = _norm(spark, [_hit(externalId="CVE-2025-0001"), _hit(externalId="", name="CVE-2025-2")])
    r = out[0]
    assert r.severity == "N/A" and r.score is None and r.published_date is None
    assert r.cvss2 is None and r.ai_description is None and r.batch_id is None
    assert r.technologies == [] and r.source_feeds == []
    assert r.detail_url.endswith("/cve-2025-0001")
    assert r.component == "N/A"
    assert not r.has_fix and not r.exploitable
    assert out[1].cve_id == "CVE-2025-2"


def test_dates(spark):
    out = _norm(spark, [
        _hit(externalId="CVE-2025-1", publishedAt="1735689600000"),
        _hit(externalId="CVE-2025-2", publishedAt="2025-01-01T23:30:00-05:00"),
        _hit(externalId="CVE-2025-3", publishedAt="garbage"),
        _hit(externalId="CVE-2025-4", publishedAt="0"),
    ])
    assert [r.published_date for r in out] == [dt.date(2025, 1, 1), dt.date(2025, 1, 2), None, None]


def test_lists(spark):
    out = _norm(spark, [
        _hit(externalId="CVE-2025-1", affectedSoftware=["a", "b", "c", "d"],
             affectedTechnologies=[{"name": "Linux", "filter": "x"}, {"name": "Apache", "filter": "y"}]),
        _hit(externalId="CVE-2025-2", affectedSoftware=[]),
    ])
    assert out[0].component == "a, b, c..."
    assert out[0].technologies == ["Linux", "Apache"]
    assert out[1].component == ""


def test_description_cleaned(spark):
    out = _norm(spark, [_hit(externalId="CVE-2025-1", description="  Test\n\tvuln  ")])
    assert out[0].description == "Test vuln"


def test_malformed_epochs_do_not_fail(spark):
    out = _norm(spark, [
        _hit(externalId="CVE-2025-1", publishedAt="99999999999999999"),
        _hit(externalId="CVE-2025-2", publishedAt="8640000000000001"),
        _hit(externalId="CVE-2025-3", publishedAt="-1"),
    ])
    assert [r.published_date for r in out] == [None, None, dt.date(1969, 12, 31)]
