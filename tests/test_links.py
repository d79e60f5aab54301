from pyspark.sql import functions as F

from feedlake.functions.urls import base_url, classify_link
from feedlake.operators import links as LK

CASES = [
    ("https://nvd.nist.gov/vuln/77", "entry", "NVD"),
    ("HTTPS://NVD.NIST.GOV:443/vuln/77", "entry", "NVD"),
    ("https://github.com/acme/kit/issues/9", "issue nine", "GitHub"),
    ("https://gist.github.com/acme/1", "a gist", "GitHub"),
    ("https://vuldb.com/?entry=5", "entry five", "VulDB"),
    ("https://cve.mitre.org/entry/5", "entry five", "MITRE"),
    ("https://www.exploit-db.com/e/5", "code", "Exploit-DB"),
    ("https://exploit-db.com/e/5", "code", "Exploit-DB"),
    ("https://vendor.test/news", "June ADVISORY", "Security Advisory"),
    ("https://security.vendor.test/n", "news", "Security Advisory"),
    ("https://vendor.test/r", "hotfix 3", "Patch/Fix"),
    ("https://lab.test/c", "PoC code", "Proof of Concept"),
    ("https://lab.test/c", "a proof of concept", "Proof of Concept"),
    ("https://blog.test/w", "write-up", "Other"),
    ("https://blog.test/w", None, "Other"),
    # hosts that only look like a listed one
    ("https://trap.test\\@github.com/x", "mirror", "Other"),
    ("https://github.com@trap.test/x", "mirror", "Other"),
    ("https://a@b@github.com/x", "mirror", "GitHub"),
    ("https://trap.test/github.com/x", "mirror", "Other"),
    ("https://mygithub.com/x", "mirror", "Other"),
    ("https://github.com.trap.test/x", "mirror", "Other"),
    ("https://trap.test?github.com", "mirror", "Other"),
    ("https://trap.test#@github.com", "mirror", "Other"),
    ("https://[::1]/x", "local", "Other"),
    ("  https://github.com/x", "padded", "GitHub"),
    ("github.com/x", "no scheme", "Other"),
    ("", "", "Other"),
]


def test_classify(spark):
    df = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(CASES)], "i int, u string, t string")
    got = [r[0] for r in df.orderBy("i").select(classify_link(F.col("u"), F.col("t"))).collect()]
    assert got == [c for _, _, c in CASES]


HTML = ('<h2 class="x">Additional resources</h2><p>t</p><div class="a prose b">\n'
        '<a href="https://nvd.nist.gov/x">NVD</a><a href="/rel">rel</a>\n'
        '<a href="https://e.com/p"> Patch </a><a class="c" href="https://skip.com">skip</a></div>\n'
        '<div class="prose"><a href="https://late.com">late</a></div>')


def test_extract_section(spark):
    pages = spark.createDataFrame([(1, HTML), (2, "<p>no section</p>"), (3, None)], "page_id long, html string")
    out = [(r.title, r.url, r.type) for r in LK.extract_links(pages).orderBy("page_id", "pos").collect()]
    assert out == [("NVD", "https://nvd.nist.gov/x", "NVD"), ("Patch", "https://e.com/p", "Patch/Fix")]
    arr = {r.page_id: r.externalLinks for r in LK.links_array(pages).collect()}
    assert [l.url for l in arr[1]] == ["https://nvd.nist.gov/x", "https://e.com/p"] and arr[2] == []


def test_section_after_earlier_heading(spark):
    html = "<h2>Other</h2><div class='prose'>x</div>" + HTML
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert LK.extract_links(pages).count() == 2


def test_base_urls(spark):
    df = spark.createDataFrame([
        ("https://example.com/a", [("t", "https://nvd.nist.gov/x", "NVD"), ("g", "https://github.com/y", "GitHub")]),
        ("https://example.com/b", []),
        ("https://z-domain.com/foo", None),
        ("https://a-domain.com/bar", None),
        ("not-a-url", None),
        ("HTTPS://User@EX.com:8443/a b", None),
    ], "source_url string, links array<struct<title:string,url:string,type:string>>")
    got = [r.base_url for r in LK.base_urls(df, ("source_url",), ("links",)).collect()]
    assert got == ["https://a-domain.com", "https://ex.com", "https://example.com", "https://github.com",
                   "https://nvd.nist.gov", "https://z-domain.com"]
    census = {r.base_url: r.n for r in LK.base_url_census(df, ("source_url",), ("links",)).collect()}
    assert census["https://example.com"] == 2
    assert LK.base_urls(df.limit(0), ("source_url",)).count() == 0


def test_international_hosts_have_one_form(spark):
    urls = ["https://münchen.de/a", "https://MÜNCHEN.DE/b", "https://xn--mnchen-3ya.de", "https://straße.example/",
            "https://例え。テスト/x", "https://☃.net", "https://mu\u0308nchen.de", "https://ｅx.com", "https://[::1]/", None, "x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r.base_url: r.n for r in LK.base_url_census(df, ("u",)).collect()}
    assert got == {"https://xn--mnchen-3ya.de": 4, "https://xn--strae-oqa.example": 1, "https://xn--r8jz45g.xn--zckzah": 1,
                   "https://xn--n3h.net": 1, "https://ex.com": 1, "https://[::1]": 1}
    plain = {r.base_url for r in LK.base_url_census(df, ("u",), ascii_hosts=False).collect()}
    assert "https://münchen.de" in plain and len(plain) == 8


def test_base_url_function(spark):
    df = spark.createDataFrame([("not-a-url",), ("http://a.b/c?d",)], "u string")
    assert [r[0] for r in df.select(base_url(F.col("u"))).collect()] == [None, "http://a.b"]


def test_attach_links(spark):
    records = spark.createDataFrame(
        [(1, "https://e.com/1", ("s", None)), (2, "https://e.com/2", ("s", None)), (3, "", ("s", None)), (4, None, ("s", None))],
        "url int, detail_url string, additional_resources struct<sourceUrl:string,externalLinks:array<struct<title:string,url:string,type:string>>>")
    pages = spark.createDataFrame([("https://e.com/1", HTML, 2), ("https://e.com/1", "<p>old</p>", 1), ("", HTML, 1), (None, HTML, 1),
                                   ("https://e.com/2", None, 1)], "url string, html string, seq int")
    out = LK.attach_links(records, pages, order=["seq"])
    assert out.columns == records.columns
    got = {r.url: [x.type for x in r.additional_resources.externalLinks] for r in out.collect()}
    assert got == {1: ["NVD", "Patch/Fix"], 2: [], 3: [], 4: []}
    assert LK.attach_links(records, pages.limit(0)).count() == 4
