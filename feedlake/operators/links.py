"""Link extraction from HTML, link classes and base-URL census.

The HTML column is read once, reduced to ``(title, url)`` pairs with
built-in regex functions inside the scan stage, and dropped before any
exchange, so shuffles never carry page bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import js_trim
from feedlake.functions.urls import ascii_base_url, base_url, classify_link
from feedlake.operators.dedupe import dedupe_last

# The section that holds the resources (an <h2> title, then the
# first <div> whose class contains the container class, up to its first
# </div>), the default title and class, and the anchor form (href first,
# tag-free text).
SECTION_TEMPLATE = r'<h2[^>]*>{title}</h2>[\s\S]*?<div[^>]*class="[^"]*{css_class}[^"]*"[^>]*>([\s\S]*?)</div>'
SECTION_TITLE = "Additional resources"
SECTION_CLASS = "prose"
ANCHOR = r'<a\s+href="([^"]+)"[^>]*>([^<]+)</a>'
ABSOLUTE_PREFIX = "http"


def _quote(text: str) -> str:
    """Escape regex metacharacters of a literal (same syntax in Java and RE2)."""
    out = []
    for ch in text:
        out.append("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch)
    return "".join(out)


def section_pattern(title: str = SECTION_TITLE, css_class: str = SECTION_CLASS) -> str:
    return SECTION_TEMPLATE.replace("{title}", _quote(title)).replace("{css_class}", _quote(css_class))


def section_text(html: Column, title: str | None = SECTION_TITLE,
                 css_class: str = SECTION_CLASS) -> Column:
    """Inner HTML of the titled section, NULL when absent; whole page when
    ``title`` is None. The title is located with ``instr`` first so the lazy
    regex only runs from the heading on, not over the whole page from every
    ``<h2``."""
    if title is None:
        return html
    pattern = section_pattern(title, css_class)
    marker = F.instr(html, f">{title}</h2>")
    # start of the "<h2" tag that holds the first marker: text between the
    # last "<h2" before the marker and the marker has length L
    before = F.substring_index(F.substring(html, 1, marker - 1), "<h2", -1)
    start = F.greatest(marker - F.length(before) - F.lit(3), F.lit(1))
    from_heading = F.when(marker > 0, F.substr(html, start))
    return F.when(from_heading.rlike(pattern), F.regexp_extract(from_heading, pattern, 1))


def extract_links(pages: DataFrame, html: str = "html", keep=("page_id",),
                  title: str | None = SECTION_TITLE, css_class: str = SECTION_CLASS,
                  absolute_only: bool = True, rules=None) -> DataFrame:
    """One row per link: keep columns, ``pos`` (1-based), title, url, type.

    Title and url are trimmed; empty ones are skipped, and with
    ``absolute_only`` only URLs starting with ``http`` are kept.
    """
    sec = section_text(F.col(html), title, css_class)
    urls = F.regexp_extract_all(sec, F.lit(ANCHOR), 1)
    titles = F.regexp_extract_all(sec, F.lit(ANCHOR), 2)
    pairs = F.arrays_zip(urls.alias("url"), titles.alias("title"))
    exploded = (pages.select(*keep, F.posexplode_outer(pairs).alias("pos", "p"))
                     .filter(F.col("p").isNotNull())
                     .select(*keep, (F.col("pos") + 1).alias("pos"),
                             js_trim(F.col("p.title")).alias("title"),
                             js_trim(F.col("p.url")).alias("url")))
    ok = (F.col("url") != "") & (F.col("title") != "")
    if absolute_only:
        ok = ok & F.col("url").startswith(ABSOLUTE_PREFIX)
    return exploded.filter(ok).withColumn("type", classify_link(F.col("url"), F.col("title"), rules))


def links_column(html: Column, title: str | None = SECTION_TITLE, css_class: str = SECTION_CLASS,
                 absolute_only: bool = True, rules=None) -> Column:
    """``array<struct<title,url,type>>`` of a page's links, from its own row
    (a ``transform`` over the zipped matches): usable in any projection, no
    regrouping or shuffle."""
    sec = section_text(html, title, css_class)
    pairs = F.arrays_zip(F.regexp_extract_all(sec, F.lit(ANCHOR), 1).alias("url"),
                         F.regexp_extract_all(sec, F.lit(ANCHOR), 2).alias("title"))
    trimmed = F.transform(pairs, lambda p: F.struct(js_trim(p["title"]).alias("title"), js_trim(p["url"]).alias("url")))

    def keep_link(p):
        ok = (p["url"] != "") & (p["title"] != "")
        return ok & p["url"].startswith(ABSOLUTE_PREFIX) if absolute_only else ok

    kept = F.filter(trimmed, keep_link)
    typed = F.transform(kept, lambda p: F.struct(p["title"].alias("title"), p["url"].alias("url"),
                                                 classify_link(p["url"], p["title"], rules).alias("type")))
    return F.coalesce(typed, F.array().cast("array<struct<title:string,url:string,type:string>>"))


def links_array(pages: DataFrame, html: str = "html", key: str = "page_id", **kw) -> DataFrame:
    """(key, externalLinks) per page; see ``links_column``."""
    return pages.select(key, links_column(F.col(html), **kw).alias("externalLinks"))


def attach_links(records: DataFrame, pages: DataFrame, url: str = "url", html: str = "html", order=(),
                 detail_url: str = "detail_url", resources: str = "additional_resources", **kw) -> DataFrame:
    """``records`` with ``externalLinks`` of their resources filled from landed
    detail pages (``pages``: one page per URL; of several the last by ``order``,
    then by text). A record without a page, or whose page has no section, gets
    an empty list. Only (URL, links) is shuffled, never a page body."""
    found = pages.filter(F.col(url).isNotNull()).select(
        F.col(url).alias("_page_url"), links_column(F.col(html), **kw).alias("_links"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.xxhash64(html).alias("_text"))
    last = dedupe_last(found, "_page_url", [*[f"_o{i}" for i in range(len(order))], "_text"]).select("_page_url", "_links")
    links = F.coalesce("_links", F.array().cast("array<struct<title:string,url:string,type:string>>"))
    return (records.join(last, F.nullif(F.col(detail_url), F.lit("")) == F.col("_page_url"), "left")
            .withColumn(resources, F.col(resources).withField("externalLinks", links))
            .drop("_page_url", "_links"))


def link_class_counts(links: DataFrame) -> DataFrame:
    """(type, n) over extracted links."""
    return links.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def base_urls(df: DataFrame, url_cols=("source_url",), link_arrays=(), ascii_hosts: bool = True) -> DataFrame:
    """Distinct ``scheme://host`` over URL columns and link arrays, sorted.

    Partial distinct runs in each task before the shuffle; invalid URLs are
    skipped. The final ``orderBy`` is a range shuffle of the (small) distinct
    set only.
    """
    return base_url_census(df, url_cols, link_arrays, ascii_hosts).select("base_url").orderBy("base_url")


def base_url_census(df: DataFrame, url_cols=("source_url",), link_arrays=(), ascii_hosts: bool = True) -> DataFrame:
    """(base_url, n): occurrences per base URL (each distinct URL of a row once).

    With ``ascii_hosts`` the spellings of an international host are one (``xn--`` form); counts are summed
    per spelling first, so that only distinct base URLs reach the encoder. Without it no row leaves the JVM.
    """
    arrs = [F.array(F.col(c)) for c in url_cols] + [F.col(a).getField("url") for a in link_arrays]
    all_urls = F.array_distinct(F.filter(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrs]),
                                         lambda u: u.isNotNull() & (u != "")))
    counts = (df.select(F.explode(all_urls).alias("u"))
              .select(base_url(F.col("u")).alias("base_url"))
              .filter(F.col("base_url").isNotNull())
              .groupBy("base_url").agg(F.count(F.lit(1)).alias("n")))
    if not ascii_hosts:
        return counts
    return counts.select(ascii_base_url("base_url").alias("base_url"), "n").groupBy("base_url").agg(F.sum("n").alias("n"))
