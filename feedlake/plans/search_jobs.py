"""Search, paging, lookup, facet and triage jobs.

orders play the record table for paging (severity = o_orderpriority, newest
= o_orderdate, key = o_orderkey); part plays it for text search and triage.
Page sizes and cursors are the feature of these jobs, not row caps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import search as S
from feedlake.plans.catalog import job
from feedlake.plans.tables import table
from feedlake.session import scratch_path
from feedlake.sources import ordered

_ORDER_OUT = ("o_orderkey", "o_orderpriority", "o_totalprice")
_DATE_OUT_SQL = "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate"


def _orders_out(df):
    return df.select(*_ORDER_OUT, F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@job("search_page", f"""
SELECT o_orderkey, o_orderpriority, o_totalprice, {_DATE_OUT_SQL} FROM orders
WHERE o_orderpriority = '1-URGENT' ORDER BY orders.o_orderdate DESC, o_orderkey ASC LIMIT 20 OFFSET 40""")
def search_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    page = S.search_page(o, severity="1-URGENT", limit=20, offset=40, newest_col="o_orderdate",
                         key="o_orderkey", severity_col="o_orderpriority")
    return _orders_out(page)


@job("search_page_keyset", f"""
SELECT o_orderkey, o_orderpriority, o_totalprice, {_DATE_OUT_SQL} FROM orders
WHERE o_orderpriority = '1-URGENT'
  AND (orders.o_orderdate < TIMESTAMP '1998-06-01 00:00:00'
       OR (orders.o_orderdate = TIMESTAMP '1998-06-01 00:00:00' AND o_orderkey > 1000))
ORDER BY orders.o_orderdate DESC, o_orderkey ASC LIMIT 20""")
def search_page_keyset(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    page = S.search_page_keyset(o, after=("1998-06-01 00:00:00", 1000), severity="1-URGENT", limit=20,
                                newest_col="o_orderdate", key="o_orderkey", severity_col="o_orderpriority")
    return _orders_out(page)


_PART_SEARCH = ("p_name", "p_brand", "p_type")


@job("search_text", """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE contains(lower(p_name), 'blue') OR contains(lower(p_brand), 'blue') OR contains(lower(p_type), 'blue')
ORDER BY p_partkey DESC LIMIT 20""")
def search_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    page = S.search_page(p, search="blue", limit=20, newest_col="p_partkey", key="p_partkey",
                         search_cols=_PART_SEARCH)
    return page.select("p_partkey", "p_name", "p_brand", "p_type")


@job("search_totals", """
SELECT count(*) AS total_all,
       count(*) FILTER (WHERE p_type = 'ECONOMY' AND (contains(lower(p_name), 'red')
             OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red'))) AS total_matching
FROM part""")
def search_totals(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return S.search_totals(p, severity="ECONOMY", search="red", severity_col="p_type",
                           search_cols=_PART_SEARCH)


_DEEP_SQL = f"""(SELECT '{{view}}' AS view, o_orderkey, o_orderpriority, o_totalprice, {_DATE_OUT_SQL} FROM orders
 WHERE {{where}} ORDER BY orders.o_orderdate DESC NULLS LAST, o_orderkey ASC LIMIT 20 OFFSET {{offset}})"""


@job("search_page_deep", _DEEP_SQL.format(view="all", where="true", offset=1200) + " UNION ALL " + _DEEP_SQL.format(
    view="urgent", where="o_orderpriority = '1-URGENT'", offset=200))
def search_page_deep(spark, sf_dir):
    """Pages at deep offsets, found by the directory of a table laid out in page order (2,500 rows a part)."""
    path = scratch_path(spark, "orders-by-page")
    ordered.write_ordered(table(spark, sf_dir, "orders"), path, "o_orderdate", "o_orderkey", facet="o_orderpriority", rows_per_part=2500)
    pages = [_orders_out(page).select(F.lit(view).alias("view"), "*") for view, page in (
        ("all", ordered.page_at(spark, path, limit=20, offset=1200)),
        ("urgent", ordered.page_at(spark, path, limit=20, offset=200, facet_value="1-URGENT")))]
    return pages[0].unionByName(pages[1])


@job("search_text_pruned", """
SELECT q.query, p_partkey, p_name, p_brand, p_type
FROM part JOIN (VALUES ('Blue'), ('ring'), ('#1'), ('no such text')) AS q(query)
  ON contains(lower(p_name), lower(q.query)) OR contains(lower(p_brand), lower(q.query)) OR contains(lower(p_type), lower(q.query))""")
def search_text_pruned(spark, sf_dir):
    """Substring searches that read only the parts whose trigrams cover the query (parts ordered by name)."""
    path = scratch_path(spark, "parts-by-name")
    ordered.write_ordered(table(spark, sf_dir, "part"), path, "p_name", "p_partkey", text_cols=_PART_SEARCH, rows_per_part=1000)
    found = [ordered.search_ordered(spark, path, q).select(F.lit(q).alias("query"), "p_partkey", "p_name", "p_brand", "p_type")
             for q in ("Blue", "ring", "#1", "no such text")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@job("lookup_by_key", f"SELECT o_orderkey, o_orderpriority, o_totalprice, {_DATE_OUT_SQL} FROM orders WHERE o_orderkey = 42")
def lookup_by_key(spark, sf_dir):
    return _orders_out(S.lookup_by_key(table(spark, sf_dir, "orders"), 42, key="o_orderkey"))


@job("facet_filter", """
SELECT p_partkey, p_name FROM part
WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue'])""")
def facet_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return S.facet_filter(p, F.split("p_name", " "), ["red", "blue"]).select("p_partkey", "p_name")


def _triage_preds():
    return {
        "severe": S.severity_in("p_type", ["SMALL", "ECONOMY"]),
        "word_match": S.any_element_contains(F.split("p_name", " "), "ring"),
        "large": S.at_least("p_size", 40),
    }


@job("triage_filters", """
SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part
WHERE p_type IN ('SMALL', 'ECONOMY')
  AND len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'ring'))) > 0
  AND p_size >= 40
ORDER BY p_retailprice DESC, p_partkey ASC LIMIT 10""")
def triage_filters(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pr = _triage_preds()
    hit = p.filter(pr["severe"] & pr["word_match"] & pr["large"])
    return (hit.orderBy(F.col("p_retailprice").desc(), F.col("p_partkey").asc()).limit(10)
               .select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice"))


@job("triage_summary", """
SELECT count(*) AS total,
       count(*) FILTER (WHERE p_type IN ('SMALL', 'ECONOMY')) AS severe,
       count(*) FILTER (WHERE len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'ring'))) > 0) AS word_match,
       count(*) FILTER (WHERE p_size >= 40) AS large
FROM part""")
def triage_summary(spark, sf_dir):
    return S.triage_summary(table(spark, sf_dir, "part"), _triage_preds())
