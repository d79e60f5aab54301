"""De-duplication, slice merge and upsert jobs (the shuffling part of a load)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import dedupe as DD
from feedlake.operators import report as R
from feedlake.operators.upsert import upsert_by_key, upsert_counts
from feedlake.plans.catalog import job
from feedlake.plans.tables import LOAD_TIME, table

TS_FMT, TS_SQL = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"


@job("dedupe_last", """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""")
def dedupe_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    last = DD.dedupe_last(o, "o_custkey", ["o_orderdate", "o_orderkey"])
    return last.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                       "o_totalprice")


@job("dedupe_documents", """
SELECT doc_id, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def dedupe_documents(spark, sf_dir):
    # Exact copies: the shuffle carries a 256-bit digest of the whole text,
    # never the text itself; copies are pruned per task before the exchange.
    d = table(spark, sf_dir, "documents")
    keyed = d.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"),
                     F.col("text").isNull().alias("null_text"))
    return DD.dedupe_last(keyed, ["digest", "null_text"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


# Slices: the unfiltered slice "all" plus one facet slice per event type, as a
# multi-slice load produces; the facet slices are loaded after "all".
def event_slices(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    base = ev.select(F.concat(F.lit("CVE-"), F.year("ts").cast("string"), F.lit("-"),
                              F.col("event_id").cast("string")).alias("cve_id"),
                     "event_id", "ts", "event_type", "value")
    # one scan, each row emitted into its slices (no union of N plans)
    both = F.array(F.struct(F.lit("all").alias("slice"), F.lit(0).alias("slice_rank")),
                   F.struct(F.col("event_type").alias("slice"), F.lit(1).alias("slice_rank")))
    return base.select("*", F.inline(both))


_SLICES_SQL = """
WITH base AS (SELECT 'CVE-' || cast(year(ts) AS VARCHAR) || '-' || cast(event_id AS VARCHAR) AS cve_id,
                     event_id, ts, event_type, value FROM events),
 sl AS (SELECT *, 'all' AS slice, 0 AS slice_rank FROM base
        UNION ALL SELECT *, event_type AS slice, 1 AS slice_rank FROM base)"""


@job("slice_union_dedupe", _SLICES_SQL + """
SELECT cve_id, slice, value FROM (
  SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY slice_rank DESC, ts DESC) AS rn FROM sl) WHERE rn = 1""")
def slice_union_dedupe(spark, sf_dir):
    sl = event_slices(spark, sf_dir)
    return DD.dedupe_last(sl, "cve_id", ["slice_rank", "ts"]).select("cve_id", "slice", "value")


@job("capped_per_slice", _SLICES_SQL + """
SELECT slice, event_id, cast(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY slice ORDER BY ts DESC, event_id DESC) AS rn FROM sl) WHERE rn <= 100""")
def capped_per_slice(spark, sf_dir):
    sl = event_slices(spark, sf_dir)
    return DD.cap_per_group(sl, "slice", 100, ["ts", "event_id"]).select("slice", "event_id", "rank")


@job("slice_load_report", _SLICES_SQL + """,
 per AS (SELECT slice, count(*) AS rows, count(*) FILTER (WHERE value BETWEEN 0 AND 100) AS accepted,
                count(*) FILTER (WHERE NOT coalesce(value BETWEEN 0 AND 100, false)) AS rejected,
                count(DISTINCT CASE WHEN value BETWEEN 0 AND 100 THEN cve_id END) AS distinct_keys
         FROM sl GROUP BY slice)
SELECT slice, rows, accepted, rejected, distinct_keys, accepted = 0 AS failed,
       round(cast(sum(CASE WHEN accepted = 0 THEN 1 ELSE 0 END) OVER () AS DOUBLE) / count(*) OVER (), 6) AS failure_rate,
       cast(sum(CASE WHEN accepted = 0 THEN 1 ELSE 0 END) OVER () AS DOUBLE) / count(*) OVER () > 0.5 AS warn,
       sum(accepted) OVER () = 0 AS error
FROM per""")
def slice_load_report(spark, sf_dir):
    sl = event_slices(spark, sf_dir)
    acc = F.coalesce(F.col("value").between(0, 100), F.lit(False))
    return R.slice_load_report(sl, "slice", "cve_id", acc)


# Upsert: the store holds events up to Jan 20 (created = updated = ts); the
# batch re-delivers events from Jan 15 on with value+1, and events from
# Jan 25 on a second time (a later sequence) with value+2, so duplicates
# inside the batch resolve last-wins and the overlap updates in place.
def _upsert_inputs(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    target = (ev.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
                .select("event_id", "event_type", "value",
                        F.col("ts").cast("timestamp").alias("created_at"),
                        F.col("ts").cast("timestamp").alias("updated_at")))
    b1 = (ev.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
            .select("event_id", "event_type", (F.col("value") + 1).alias("value"), F.lit(1).alias("seq")))
    b2 = (ev.filter(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"))
            .select("event_id", "event_type", (F.col("value") + 2).alias("value"), F.lit(2).alias("seq")))
    return target, b1.unionByName(b2)


_UPSERT_SQL = f"""
WITH t AS (SELECT event_id, event_type, value, ts AS created_at, ts AS updated_at FROM events
           WHERE ts < TIMESTAMP '2024-01-20'),
 b AS (SELECT event_id, event_type, value + 1 AS value, 1 AS seq FROM events WHERE ts >= TIMESTAMP '2024-01-15'
       UNION ALL
       SELECT event_id, event_type, value + 2, 2 FROM events WHERE ts >= TIMESTAMP '2024-01-25'),
 bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS rn FROM b) WHERE rn = 1)
SELECT coalesce(bl.event_id, t.event_id) AS event_id,
       CASE WHEN bl.event_id IS NOT NULL THEN bl.event_type ELSE t.event_type END AS event_type,
       CASE WHEN bl.event_id IS NOT NULL THEN bl.value ELSE t.value END AS value,
       strftime(coalesce(t.created_at, TIMESTAMP '{LOAD_TIME}'), '{TS_SQL}') AS created_at,
       strftime(CASE WHEN bl.event_id IS NOT NULL THEN TIMESTAMP '{LOAD_TIME}' ELSE t.updated_at END, '{TS_SQL}') AS updated_at
FROM t FULL OUTER JOIN bl ON t.event_id = bl.event_id"""


@job("upsert_by_key", _UPSERT_SQL)
def upsert_job(spark, sf_dir):
    target, batch = _upsert_inputs(spark, sf_dir)
    merged = upsert_by_key(target, batch, "event_id", ["seq"], LOAD_TIME)
    return merged.select("event_id", "event_type", "value",
                         F.date_format("created_at", TS_FMT).alias("created_at"),
                         F.date_format("updated_at", TS_FMT).alias("updated_at"))


@job("upsert_counts", """
WITH t AS (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20'),
 b AS (SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'
       UNION ALL SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25'),
 g AS (SELECT event_id, count(*) AS n FROM b GROUP BY event_id)
SELECT cast(sum(n) AS BIGINT) AS input_rows, count(*) AS distinct_keys,
       count(*) FILTER (WHERE t.event_id IS NULL) AS inserted,
       count(*) FILTER (WHERE t.event_id IS NOT NULL) AS updated
FROM g LEFT JOIN t ON g.event_id = t.event_id""")
def upsert_counts_job(spark, sf_dir):
    target, batch = _upsert_inputs(spark, sf_dir)
    return upsert_counts(target, batch, "event_id")
