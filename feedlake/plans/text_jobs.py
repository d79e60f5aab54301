"""Text and link jobs over documents and pages (whole texts, whole pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.text import clean_text, extract_score
from feedlake.operators import links as LK
from feedlake.operators.normalize import normalize_hits
from feedlake.plans.catalog import job
from feedlake.plans.tables import DETAIL_BASE, SPACES_SQL, clean_sql, table
from feedlake.schemas import HIT

# The first number of a text and the anchor form (href first, text without tags).
FIRST_NUMBER = r"\d+\.?\d*"
ANCHOR = r'<a\s+href="([^"]+)"[^>]*>([^<]+)</a>'
# The oracles' own form of the parts of a URL.
URL_PARTS = r"^([a-zA-Z][-+.a-zA-Z0-9]*)://(?:[^\\/?#]*@)?([^\\/?#:@]+)"

_CLEAN = clean_sql("text")


@job("clean_text_report", f"""
SELECT source, lang, count(*) AS docs,
       count(*) FILTER (WHERE {_CLEAN} <> coalesce(text, '')) AS changed,
       cast(sum(length(coalesce(text, '')) - length({_CLEAN})) AS BIGINT) AS chars_saved
FROM documents GROUP BY source, lang""")
def clean_text_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit(""))
    cleaned = d.select("source", "lang", raw.alias("raw"), clean_text("text").alias("clean"))
    return cleaned.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(F.col("clean") != F.col("raw")).alias("changed"),
        F.sum(F.length("raw") - F.length("clean")).cast("bigint").alias("chars_saved"))


@job("score_extraction", f"""
SELECT doc_id, CASE WHEN s BETWEEN 0 AND 10 THEN s END AS score FROM (
  SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '{FIRST_NUMBER}', 0), '') AS DOUBLE) AS s FROM documents)""")
def score_extraction(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", extract_score("text").alias("score"))


# Link class rules as SQL (same order as functions.urls.DEFAULT_LINK_RULES).
_HOST = f"lower(regexp_extract(url, '{URL_PARTS}', 2))"
_TITLE = "lower(title)"
_CLASS_SQL = f"""CASE
  WHEN {_HOST} = 'nvd.nist.gov' THEN 'NVD'
  WHEN {_HOST} = 'github.com' OR ends_with({_HOST}, '.github.com') THEN 'GitHub'
  WHEN {_HOST} = 'vuldb.com' THEN 'VulDB'
  WHEN {_HOST} = 'cve.mitre.org' THEN 'MITRE'
  WHEN {_HOST} IN ('www.exploit-db.com', 'exploit-db.com') THEN 'Exploit-DB'
  WHEN starts_with({_HOST}, 'security.') OR contains({_TITLE}, 'advisory') THEN 'Security Advisory'
  WHEN contains({_TITLE}, 'patch') OR contains({_TITLE}, 'fix') THEN 'Patch/Fix'
  WHEN contains({_TITLE}, 'poc') OR contains({_TITLE}, 'proof of concept') THEN 'Proof of Concept'
  ELSE 'Other' END"""


def _jstrim(x: str) -> str:
    return f"trim({x}, {SPACES_SQL})"


_LINKS_SQL = f"""
WITH m AS (
  SELECT page_id, regexp_extract_all(html, '{ANCHOR}', 1) AS urls,
         regexp_extract_all(html, '{ANCHOR}', 2) AS titles FROM pages),
 z AS (SELECT page_id, unnest(range(1, len(urls) + 1)) AS pos, unnest(urls) AS u, unnest(titles) AS t FROM m),
 links AS (SELECT page_id, cast(pos AS BIGINT) AS pos, {_jstrim('t')} AS title, {_jstrim('u')} AS url FROM z),
 kept AS (SELECT * FROM links WHERE url <> '' AND title <> '')"""


@job("extract_links", _LINKS_SQL + f" SELECT page_id, pos, title, url, {_CLASS_SQL} AS type FROM kept")
def extract_links(spark, sf_dir):
    # the driver's pages have no titled section: whole pages, relative links kept
    return LK.extract_links(table(spark, sf_dir, "pages"), title=None, absolute_only=False)


@job("classify_links", _LINKS_SQL + f" SELECT type, count(*) AS n FROM (SELECT {_CLASS_SQL} AS type FROM kept) GROUP BY type")
def classify_links(spark, sf_dir):
    links = LK.extract_links(table(spark, sf_dir, "pages"), title=None, absolute_only=False)
    return LK.link_class_counts(links)


@job("with_links_count", _LINKS_SQL + """
 SELECT count(*) AS total, count(*) FILTER (WHERE nl > 0) AS with_links FROM (
   SELECT p.page_id, count(k.page_id) AS nl FROM pages p LEFT JOIN kept k ON p.page_id = k.page_id GROUP BY p.page_id)""")
def with_links_count(spark, sf_dir):
    arr = LK.links_array(table(spark, sf_dir, "pages"), title=None, absolute_only=False)
    return arr.agg(F.count(F.lit(1)).alias("total"),
                   F.count_if(F.size("externalLinks") > 0).alias("with_links"))


_BASE_SQL = (f"CASE WHEN regexp_matches(url, '{URL_PARTS}') THEN lower(regexp_extract(url, '{URL_PARTS}', 1)) "
             f"|| '://' || lower(regexp_extract(url, '{URL_PARTS}', 2)) END")


@job("base_urls", f"SELECT DISTINCT {_BASE_SQL} AS base_url FROM pages WHERE url IS NOT NULL AND url <> '' "
                  f"AND regexp_matches(url, '{URL_PARTS}') ORDER BY base_url")
def base_urls(spark, sf_dir):
    return LK.base_urls(table(spark, sf_dir, "pages"), url_cols=("url",))


@job("base_url_census", f"SELECT base_url, count(*) AS n FROM (SELECT {_BASE_SQL} AS base_url FROM pages "
                        f"WHERE url IS NOT NULL AND url <> '') WHERE base_url IS NOT NULL GROUP BY base_url")
def base_url_census(spark, sf_dir):
    return LK.base_url_census(table(spark, sf_dir, "pages"), url_cols=("url",))


# Spellings of international hosts and the one ASCII form of each.
_HOSTS = [("münchen.de", "xn--mnchen-3ya.de"), ("MÜNCHEN.de", "xn--mnchen-3ya.de"), ("xn--mnchen-3ya.de", "xn--mnchen-3ya.de"),
          ("straße.example", "xn--strae-oqa.example"), ("例え。jp", "xn--r8jz45g.jp")]


@job("base_url_census_international", "SELECT 'https://' || CASE page_id % 5 " + " ".join(
    f"WHEN {i} THEN '{ascii_form}'" for i, (_, ascii_form) in enumerate(_HOSTS)) + " END AS base_url, count(*) AS n FROM pages GROUP BY 1")
def base_url_census_international(spark, sf_dir):
    """Pages moved to five spellings of three international hosts: one row per host."""
    pages = table(spark, sf_dir, "pages")
    host = F.element_at(F.array(*[F.lit(h) for h, _ in _HOSTS]), (F.col("page_id") % 5 + 1).cast("int"))
    moved = pages.select(F.concat(F.lit("https://"), host, F.lit("/p/"), F.col("page_id").cast("string")).alias("url"))
    return LK.base_url_census(moved, url_cols=("url",))


_LANG = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([a-z]{2})/"
_HOST_SQL = f"lower(regexp_extract(url, '{URL_PARTS}', 2))"


@job("pages_report", _LINKS_SQL + f""",
 r AS (SELECT p.page_id, regexp_extract(p.url, '{_LANG}', 1) AS severity, {_HOST_SQL.replace("url", "p.url")} AS component,
              count(k.page_id) AS nl
       FROM pages p LEFT JOIN kept k ON p.page_id = k.page_id GROUP BY p.page_id, p.url)
SELECT 'total' AS section, '' AS key, count(*) AS n, NULL::DOUBLE AS value, NULL::VARCHAR AS text, 0::INTEGER AS rank FROM r
UNION ALL SELECT 'severity', severity, count(*), NULL, NULL, 0 FROM r WHERE severity IS NOT NULL AND severity <> '' GROUP BY severity
UNION ALL SELECT 'average_score', '', 0, 0.0, '0', 0
UNION ALL SELECT 'average_score', 'unsummed', 0, NULL, NULL, 0
UNION ALL SELECT 'with_links', '', count(*) FILTER (WHERE nl > 0), NULL, NULL, 0 FROM r
UNION ALL SELECT 'date_range', 'earliest', 0, NULL, NULL, 0
UNION ALL SELECT 'date_range', 'latest', 0, NULL, NULL, 0
UNION ALL SELECT * FROM (
  SELECT 'top_components', component, count(*) AS n, NULL, NULL,
         cast(row_number() OVER (ORDER BY count(*) DESC, component ASC) AS INTEGER) AS rk
  FROM r WHERE component IS NOT NULL AND component <> '' GROUP BY component QUALIFY rk <= 10)""")
def pages_report(spark, sf_dir):
    """The one-pass report over pages as records: severity = the language
    path segment of the URL, component = the host, links = the page's links
    (whole page, relative links kept); no score, terms or dates. Exercises
    the with-links and top-component sections on whole pages."""
    from feedlake.functions.urls import url_host
    from feedlake.operators.report import analytics_report
    p = table(spark, sf_dir, "pages")
    recs = p.select(F.regexp_extract("url", _LANG, 1).alias("severity"),
                    url_host(F.col("url")).alias("component"),
                    LK.links_column(F.col("html"), title=None, absolute_only=False).alias("links"))
    return analytics_report(recs, severity="severity", score=None, terms=None, label="component",
                            date=None, links="links")


# Links of a "resources" section: (host and path, title, class); the last two are spoofs.
SECTION_LINKS = [
    ("nvd.nist.gov/vuln", "Entry", "NVD"), ("github.com/org/tool", "Issue", "GitHub"),
    ("raw.github.com/org/tool", "File", "GitHub"), ("vuldb.com/", "Entry", "VulDB"),
    ("cve.mitre.org/id", "Entry", "MITRE"), ("www.exploit-db.com/e", "Code", "Exploit-DB"),
    ("exploit-db.com/e", "Code", "Exploit-DB"), ("security.vendor.example/n", "Notes", "Security Advisory"),
    ("vendor.example/n", "Vendor ADVISORY", "Security Advisory"), ("vendor.example/r", "Hotfix notes", "Patch/Fix"),
    ("lab.example/c", "PoC", "Proof of Concept"), ("blog.example/w", "Write-up", "Other"),
    ("evil.example\\@github.com/x", "Mirror", "Other"), ("evil.example/nvd.nist.gov/x", "Copy", "Other"),
]


def section_pages(spark, sf_dir):
    """pages as detail pages: the html after a titled section (none where page_id
    is divisible by 4) with a third of ``SECTION_LINKS`` and one relative link."""
    p = table(spark, sf_dir, "pages")
    anchors = F.array(*[F.when((F.col("page_id") + k) % 3 == 0, F.concat(
        F.lit(f'<a href="https://{place}/'), F.col("page_id").cast("string"), F.lit(f'" rel="x"> {title}\n</a>, ')))
        for k, (place, title, _) in enumerate(SECTION_LINKS)])
    section = F.concat(F.lit('<h2>Summary</h2><div class="prose"><a href="https://early.example/">early</a></div>'
                             '<h2 class="t">Additional resources</h2><p>see</p><div class="a prose b">'),
                       F.array_join(anchors, ""), F.lit('<a href="/rel">Relative patch</a></div>'
                                                        '<div class="prose"><a href="https://late.example/">late</a></div>'))
    html = F.concat(F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(section), F.coalesce("html", F.lit("")))
    key = F.concat(F.lit("CVE-2024-"), F.col("page_id").cast("string"))
    return p.select("page_id", key.alias("key"), F.concat(F.lit(DETAIL_BASE), F.lower(key)).alias("url"), html.alias("html"))


_SECTION_SQL = "WITH v(k, place, title, type) AS (VALUES " + ", ".join(
    f"({k}, '{place}', '{title}', '{cls}')" for k, (place, title, cls) in enumerate(SECTION_LINKS)) + """),
 l AS (SELECT page_id, k, title, 'https://' || place || '/' || cast(page_id AS VARCHAR) AS url, type
       FROM pages JOIN v ON (page_id + k) % 3 = 0 WHERE page_id % 4 <> 0)"""


@job("section_links", _SECTION_SQL + """
 SELECT page_id, cast(row_number() OVER (PARTITION BY page_id ORDER BY k) AS BIGINT) AS pos, title, url, type FROM l""")
def section_links(spark, sf_dir):
    """The titled section only, absolute links only, all link classes."""
    links = LK.extract_links(section_pages(spark, sf_dir))
    return links.withColumn("pos", F.col("pos").cast("bigint"))


@job("section_link_classes", _SECTION_SQL + " SELECT type, count(*) AS n FROM l GROUP BY type")
def section_link_classes(spark, sf_dir):
    return LK.link_class_counts(LK.extract_links(section_pages(spark, sf_dir)))


@job("records_with_links", _SECTION_SQL + """
 SELECT 'CVE-2024-' || cast(p.page_id AS VARCHAR) AS cve_id, count(l.k) AS n_links,
        coalesce(string_agg(l.type || ' ' || l.url, ' ' ORDER BY l.k), '') AS links
 FROM pages p LEFT JOIN l ON p.page_id = l.page_id GROUP BY p.page_id""")
def records_with_links(spark, sf_dir):
    """Records whose external links come from their detail page, joined by URL."""
    pages = section_pages(spark, sf_dir)
    hits = pages.select(*[(F.col("key") if f.name == "externalId" else F.lit(None)).cast(f.dataType).alias(f.name) for f in HIT.fields])
    recs = LK.attach_links(normalize_hits(hits, DETAIL_BASE, keep_raw=False), pages)
    links = F.col("additional_resources.externalLinks")
    return recs.select("cve_id", F.size(links).cast("bigint").alias("n_links"), F.array_join(
        F.transform(links, lambda x: F.concat_ws(" ", x["type"], x["url"])), " ").alias("links"))
