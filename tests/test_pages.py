import json
import os

from feedlake.operators.dedupe import cap_total
from feedlake.sources.pages import hits_from_pages, page_quarantine, read_pages


def _write(d, name, obj):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))


def test_pages_and_slices(spark, tmp_path):
    root = str(tmp_path / "pages")
    hit = lambda k: {"externalId": k, "severity": "HIGH", "baseScore": 8.5, "publishedAt": 1735689600000}
    _write(os.path.join(root, "slice=all"), "p1.json", {"hits": [hit("CVE-2025-1")], "cursor": "c1", "nbHits": 2})
    _write(os.path.join(root, "slice=all"), "p2.json", {"hits": [hit("CVE-2025-2")], "nbHits": 2})
    _write(os.path.join(root, "slice=linux"), "p1.json", {"results": [{"hits": [hit("CVE-2025-1"), hit("CVE-2025-3")], "nbHits": 2}]})
    _write(os.path.join(root, "slice=linux"), "bad.json", "{not json")
    _write(os.path.join(root, "slice=linux"), "empty.json", {})
    pages = read_pages(spark, root)
    hits = hits_from_pages(pages)
    assert hits.count() == 4
    assert sorted(r.slice for r in hits.select("slice").distinct().collect()) == ["all", "linux"]
    q = {r.reason for r in page_quarantine(pages).collect()}
    assert q == {"malformed_page", "no_hits"}
    # score numbers land as text and parse back
    assert {r.baseScore for r in hits.collect()} == {"8.5"}
    assert cap_total(hits, 1, ["externalId"]).count() == 1


def test_load_end_to_end(spark, tmp_path):
    import datetime as dt
    from feedlake.load import load
    from feedlake.sources import store
    root = str(tmp_path / "landing")
    hit = lambda k, sev, s="5": {"externalId": k, "severity": sev, "baseScore": s}
    _write(os.path.join(root, "slice=all"), "p1.json", {"hits": [hit("CVE-2025-1", "LOW"), hit("CVE-2025-2", "HIGH"),
                                                                 hit("CVE-2025-9", "HIGH", "11")]})
    _write(os.path.join(root, "slice=linux"), "p1.json", {"hits": [hit("CVE-2025-1", "CRITICAL")]})
    _write(os.path.join(root, "slice=linux"), "bad.json", "{not json")
    st = str(tmp_path / "store")
    acc, q, rep = load(spark, root, "https://x/", store_root=st, load_time=dt.datetime(2024, 1, 1), batch_id="b1")
    got = {r.cve_id: (r.severity, r.slice) for r in acc.collect()}
    assert got == {"CVE-2025-1": ("CRITICAL", "linux"), "CVE-2025-2": ("HIGH", "all")}
    assert sorted(((r.cve_id or "", r.reasons) for r in q.collect())) == [
        ("", ["malformed_page"]), ("CVE-2025-9", ["range:score", "range:base_score"])]
    report = {r.slice: (r.rows, r.accepted, r.rejected, r.bad_pages) for r in rep.collect()}
    assert report == {"all": (3, 2, 1, 0), "linux": (1, 1, 0, 1)}
    assert {r.cve_id for r in store.read_store(spark, st).collect()} == {"CVE-2025-1", "CVE-2025-2"}


def test_a_bad_hit_costs_itself_only(spark, tmp_path):
    from feedlake.load import load
    root = str(tmp_path / "landing")
    hit = lambda k, **more: {"externalId": k, "severity": "HIGH", "baseScore": 5, **more}
    _write(root, "p1.json", {"hits": [hit("CVE-2025-1"), hit("CVE-2025-2", hasFix="yes"), hit("CVE-2025-3")]})
    _write(root, "p2.json", '{"hits": [{"externalId": "CVE-2025-4"')
    _write(root, "p3.json", {"hits": [hit("CVE-2025-5"), None, hit("CVE-2025-5")]})
    acc, q, rep = load(spark, root, "https://x/")
    assert sorted(r.cve_id for r in acc.collect()) == ["CVE-2025-1", "CVE-2025-3", "CVE-2025-5"]
    bad = sorted((r.reasons[0], (r.bad_text or "")[:40]) for r in q.collect())
    assert [b[0] for b in bad] == ["malformed_hit", "malformed_hit", "malformed_page"] and "CVE-2025-2" in bad[1][1]
    assert [(r.rows, r.accepted, r.rejected, r.bad_pages) for r in rep.collect()] == [(6, 4, 2, 1)]


def test_last_page_wins_by_number_and_line(spark, tmp_path):
    from feedlake.load import load
    root = str(tmp_path / "landing")
    for i in range(1, 11):
        _write(root, f"page-{i}.json", {"hits": [{"externalId": "CVE-2025-1", "severity": "LOW", "description": f"page {i}"}]})
    assert [r.description for r in load(spark, root, "https://x/")[0].collect()] == ["page 10"]
    lines = str(tmp_path / "lines")
    _write(lines, "part-0.json", "\n".join(json.dumps({"hits": [{"externalId": "CVE-2025-1", "severity": "LOW", "description": d}]})
                                           for d in ("z", "a", "m")))
    assert [r.description for r in load(spark, lines, "https://x/", multiline=False)[0].collect()] == ["m"]


def test_slices_of_any_name_and_pages_by_number(spark, tmp_path):
    from feedlake.load import load
    root = str(tmp_path / "landing")
    hit = lambda k, sev: {"externalId": k, "severity": sev, "baseScore": 5}
    for i, name in enumerate(["2023", "2024", "01", "2023-01-05", "1e5", "a b"]):
        _write(os.path.join(root, f"slice={name}"), "p1.json", {"hits": [hit(f"CVE-2025-{i}", "LOW")]})
    _write(os.path.join(root, "slice=2023"), "2024_page2_v1.json", {"hits": [hit("CVE-2025-77", "LOW")]})
    _write(os.path.join(root, "slice=2023"), "2024_page10_v1.json", {"hits": [hit("CVE-2025-77", "HIGH")]})
    acc, _, report = load(spark, root, "https://x/")
    got = {r.cve_id: (r.slice, r.severity) for r in acc.collect()}
    assert got.pop("CVE-2025-77") == ("2023", "HIGH")  # page 10 after page 2
    assert {v[0] for v in got.values()} == {"2023", "2024", "01", "2023-01-05", "1e5", "a b"}
    assert report.count() == 6
    only = str(tmp_path / "numbers")
    for name in ("01", "2"):
        _write(os.path.join(only, f"slice={name}"), "x.json", {"hits": [hit(f"CVE-2025-{name}", "LOW")]})
    assert {r.slice for r in load(spark, only, "https://x/", slice_order=["2", "01"])[0].collect()} == {"01", "2"}


def test_a_page_may_carry_its_number_and_a_pattern_may_find_it(spark, tmp_path):
    from feedlake.sources.pages import parsed_hits
    root = str(tmp_path / "pages")
    _write(root, "v1-of-7.json", {"hits": [{"externalId": "a"}], "page_seq": 40})
    _write(root, "v2-of-7.json", {"hits": [{"externalId": "b"}]})
    pages = read_pages(spark, root)
    number = lambda **kw: {r["h"]["externalId"]: r["page_no"] for r in parsed_hits(pages, **kw).collect()}
    assert number() == {"a": 40, "b": 0} and number(page_number=r"v(\d+)-") == {"a": 40, "b": 2}
