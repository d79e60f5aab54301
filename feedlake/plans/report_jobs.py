"""Report jobs (the analytics report and its single measures)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import report as R
from feedlake.plans.catalog import job
from feedlake.plans.tables import EVENT_RECORDS_SQL, event_records, props_k, table

_REC = f"WITH r AS ({EVENT_RECORDS_SQL})"

# Rounded-half-up mean in hundredths from an exact decimal sum: S*10^6 is an
# integer, so floor((2*S*10^6 + n*10^4) / (2*n*10^4)) is exact (scores >= 0).
_MEAN_CENTS = ("((2 * cast(sum(cast({v} AS DECIMAL(20,6))) * 1000000 AS HUGEINT) + count({v}) * 10000)"
               " // (2 * count({v}) * 10000))")


def _mean_sql(v: str) -> tuple[str, str]:
    cents = _MEAN_CENTS.format(v=v)
    value = f"CASE WHEN count({v}) > 0 THEN cast({cents} AS DOUBLE) / 100.0 ELSE 0.0 END"
    text = (f"CASE WHEN count({v}) > 0 THEN printf('%d.%02d', cast({cents} AS BIGINT) // 100, "
            f"cast({cents} AS BIGINT) % 100) ELSE '0' END")
    return value, text


_AVG_V, _AVG_T = _mean_sql("score")

ANALYTICS_REPORT_SQL = _REC + f""",
 s AS (SELECT * , CASE WHEN score IS NOT NULL AND NOT isnan(score) THEN score END AS sc FROM r),
 buckets(label) AS (VALUES ('0-3'), ('3-7'), ('7-9'), ('9-10')),
 scored AS (SELECT CASE WHEN sc < 3 THEN '0-3' WHEN sc < 7 THEN '3-7' WHEN sc < 9 THEN '7-9' ELSE '9-10' END AS label
            FROM s WHERE sc IS NOT NULL),
 terms AS (SELECT unnest(technologies) AS t FROM r)
SELECT 'total' AS section, '' AS key, count(*) AS n, NULL::DOUBLE AS value, NULL::VARCHAR AS text, 0::INTEGER AS rank FROM r
UNION ALL
SELECT 'severity', severity, count(*), NULL, NULL, 0 FROM r WHERE severity IS NOT NULL AND severity <> '' GROUP BY severity
UNION ALL
SELECT 'score_bucket', b.label, count(scored.label), NULL, NULL, 0 FROM buckets b LEFT JOIN scored ON b.label = scored.label GROUP BY b.label
UNION ALL
SELECT 'average_score', '', count(sc), {_AVG_V.replace('score', 'sc')}, {_AVG_T.replace('score', 'sc')}, 0 FROM s
UNION ALL
SELECT 'average_score', 'unsummed', count(*) FILTER (WHERE abs(sc) > 922337203685477), NULL, NULL, 0 FROM s
UNION ALL
SELECT 'with_links', '', 0, NULL, NULL, 0
UNION ALL
SELECT 'date_range', 'earliest', count(published_date), NULL, cast(min(published_date) AS VARCHAR), 0 FROM r
UNION ALL
SELECT 'date_range', 'latest', count(published_date), NULL, cast(max(published_date) AS VARCHAR), 0 FROM r
UNION ALL
SELECT * FROM (
  SELECT 'top_technologies', t, count(*) AS n, NULL, NULL,
         cast(row_number() OVER (ORDER BY count(*) DESC, t ASC) AS INTEGER) AS rk
  FROM terms GROUP BY t QUALIFY rk <= 10)
UNION ALL
SELECT * FROM (
  SELECT 'top_components', component, count(*) AS n, NULL, NULL,
         cast(row_number() OVER (ORDER BY count(*) DESC, component ASC) AS INTEGER) AS rk
  FROM r WHERE component IS NOT NULL AND component <> '' GROUP BY component QUALIFY rk <= 10)
"""


@job("analytics_report", ANALYTICS_REPORT_SQL)
def analytics_report(spark, sf_dir):
    return R.analytics_report(event_records(spark, sf_dir), links=None)


@job("total_count", "SELECT count(*) AS total FROM orders")
def total_count(spark, sf_dir):
    return R.total_count(table(spark, sf_dir, "orders"))


@job("severity_distribution",
     "SELECT o_orderpriority AS severity, count(*) AS n FROM orders "
     "WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> '' GROUP BY 1")
def severity_distribution(spark, sf_dir):
    return R.severity_distribution(table(spark, sf_dir, "orders"), "o_orderpriority")


# events.value is on a 0..500 scale; the bucket edges are arguments.
_EV_EDGES = (10, 50, 200)
_EV_LABELS = ("0-10", "10-50", "50-200", "200+")


@job("score_histogram", """
WITH b(bucket) AS (VALUES ('0-10'), ('10-50'), ('50-200'), ('200+')),
 s AS (SELECT CASE WHEN value < 10 THEN '0-10' WHEN value < 50 THEN '10-50'
                   WHEN value < 200 THEN '50-200' ELSE '200+' END AS bucket
       FROM events WHERE value IS NOT NULL AND NOT isnan(value))
SELECT b.bucket, count(s.bucket) AS n FROM b LEFT JOIN s ON b.bucket = s.bucket GROUP BY b.bucket""")
def score_histogram(spark, sf_dir):
    return R.score_histogram(table(spark, sf_dir, "events"), "value", _EV_EDGES, _EV_LABELS)


_AVG_V2, _AVG_T2 = _mean_sql("value")


@job("average_score", f"SELECT count(value) AS n_scored, {_AVG_V2} AS avg_score, {_AVG_T2} AS avg_text, 0 AS n_unsummed "
                      "FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def average_score(spark, sf_dir):
    return R.average_score(table(spark, sf_dir, "events"), "value")


_EXTREME_SQL = """
WITH v AS (SELECT CASE event_id % 5 WHEN 0 THEN 8e14 WHEN 1 THEN 1e300 WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN 'nan'::DOUBLE
                  ELSE value END AS v FROM events),
 u AS (SELECT v, CASE WHEN isnan(v) THEN NULL WHEN abs(v) <= 922337203685477 THEN cast(round(v * 10000) AS HUGEINT) END AS units FROM v),
 m AS (SELECT count(units) AS n_scored, count(*) FILTER (WHERE NOT isnan(v) AND units IS NULL) AS n_unsummed,
              (2 * sum(units) + count(units) * 100) // (2 * count(units) * 100) AS cents FROM u)"""


@job("average_of_extremes", _EXTREME_SQL + """
SELECT n_scored, cast(cents AS DOUBLE) / 100.0 AS avg_score,
       printf('%d.%02d', cast(cents // 100 AS BIGINT), cast(cents % 100 AS BIGINT)) AS avg_text, n_unsummed FROM m""")
def average_of_extremes(spark, sf_dir):
    """The mean over scores of 8e14, 1e300, infinity and NaN among the others: nothing
    fails, nothing overflows, what no sum can hold is counted."""
    return R.average_score(_extremes(spark, sf_dir), "v")


@job("report_of_extremes", _EXTREME_SQL + """,
 s AS (SELECT v FROM v WHERE NOT isnan(v) AND v IS NOT NULL),
 b(label) AS (VALUES ('0-3'), ('3-7'), ('7-9'), ('9-10')),
 k AS (SELECT CASE WHEN v < 3 THEN '0-3' WHEN v < 7 THEN '3-7' WHEN v < 9 THEN '7-9' ELSE '9-10' END AS label FROM s)
SELECT 'total' AS section, '' AS key, (SELECT count(*) FROM v) AS n, NULL::DOUBLE AS value, NULL::VARCHAR AS text
UNION ALL SELECT 'score_bucket', b.label, count(k.label), NULL, NULL FROM b LEFT JOIN k ON b.label = k.label GROUP BY b.label
UNION ALL SELECT 'average_score', '', n_scored, cast(cents AS DOUBLE) / 100.0,
                 printf('%d.%02d', cast(cents // 100 AS BIGINT), cast(cents % 100 AS BIGINT)) FROM m
UNION ALL SELECT 'average_score', 'unsummed', n_unsummed, NULL, NULL FROM m
UNION ALL SELECT 'with_links', '', 0, NULL, NULL
UNION ALL SELECT 'date_range', 'earliest', 0, NULL, NULL UNION ALL SELECT 'date_range', 'latest', 0, NULL, NULL""")
def report_of_extremes(spark, sf_dir):
    """The report's score sections over the same scores."""
    out = R.analytics_report(_extremes(spark, sf_dir), severity=None, score="v", terms=None, label=None, date=None, links=None)
    return out.drop("rank")


def _extremes(spark, sf_dir):
    k = F.col("event_id") % 5
    v = (F.when(k == 0, 8e14).when(k == 1, 1e300).when(k == 2, float("inf")).when(k == 3, float("nan")).otherwise(F.col("value")))
    return table(spark, sf_dir, "events").select(v.alias("v"))


@job("date_range", "SELECT cast(min(o_orderdate) AS DATE)::VARCHAR AS earliest, "
                   "cast(max(o_orderdate) AS DATE)::VARCHAR AS latest FROM orders")
def date_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.date_range(o, F.to_date("o_orderdate")).select(
        F.col("earliest").cast("string").alias("earliest"), F.col("latest").cast("string").alias("latest"))


@job("top_terms", """
SELECT term, n, cast(row_number() OVER (ORDER BY n DESC, term ASC) AS INTEGER) AS rank FROM (
  SELECT term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part)
  GROUP BY term) QUALIFY rank <= 10""")
def top_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return R.top_terms(p.select(F.split("p_name", " ").alias("words")), "words")


@job("top_labels", """
SELECT label, n, cast(row_number() OVER (ORDER BY n DESC, label ASC) AS INTEGER) AS rank FROM (
  SELECT p_brand AS label, count(*) AS n FROM part WHERE p_brand IS NOT NULL AND p_brand <> '' GROUP BY 1)
QUALIFY rank <= 10""")
def top_labels(spark, sf_dir):
    return R.top_labels(table(spark, sf_dir, "part"), "p_brand")


@job("facet_counts", """
SELECT facet, value, n, cast(row_number() OVER (PARTITION BY facet ORDER BY n DESC, value ASC) AS INTEGER) AS rank
FROM (
  SELECT facet, value, count(*) AS n FROM (
    SELECT 'event_type' AS facet, event_type AS value FROM events WHERE event_type IS NOT NULL
    UNION ALL SELECT 'k', cast(cast(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) FROM events
      WHERE json_extract(props, '$.k') IS NOT NULL
    UNION ALL SELECT 'month', strftime(ts, '%Y-%m') FROM events WHERE ts IS NOT NULL
    UNION ALL SELECT 'user', cast(user_id AS VARCHAR) FROM events WHERE user_id IS NOT NULL)
  GROUP BY facet, value)
QUALIFY rank <= 200""")
def facet_counts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return R.facet_counts(ev, {"event_type": F.col("event_type"), "k": props_k(),
                               "month": F.date_format("ts", "yyyy-MM"), "user": F.col("user_id")})


@job("load_summary", """
SELECT count(*) AS total, count(*) FILTER (WHERE value BETWEEN 0 AND 100) AS accepted,
       count(*) FILTER (WHERE NOT coalesce(value BETWEEN 0 AND 100, false)) AS rejected,
       count(DISTINCT event_id) AS distinct_keys FROM events""")
def load_summary(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    acc = F.coalesce(F.col("value").between(0, 100), F.lit(False))
    return R.load_summary(ev, "event_id", acc)


@job("inline_report", """
SELECT 'severity' AS section, upper(event_type) AS key, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 2
UNION ALL SELECT 'total', '', count(*) FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'rejected', 'not_an_array', count(*) FROM events WHERE event_type = 'error'""")
def inline_report(spark, sf_dir):
    """The report over inline JSON: events come as texts, arrays of the
    records of a 20-wide id range; error events as lone objects, which are no arrays."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.struct(F.upper("event_type").alias("severity")).alias("h"))
    arrays = (ev.filter("event_type <> 'error'").groupBy(F.floor(F.col("event_id") / 20).alias("page"))
              .agg(F.to_json(F.collect_list("h")).alias("body")).select("body"))
    alone = ev.filter("event_type = 'error'").select(F.to_json("h").alias("body"))
    records, rejected = R.inline_records(arrays.unionByName(alone), "body", "struct<severity:string>")
    return (R.severity_distribution(records).select(F.lit("severity").alias("section"), F.col("severity").alias("key"), "n")
            .unionByName(R.total_count(records).select(F.lit("total").alias("section"), F.lit("").alias("key"), F.col("total").alias("n")))
            .unionByName(rejected.groupBy(F.col("reason").alias("key")).agg(F.count(F.lit(1)).alias("n"))
                         .select(F.lit("rejected").alias("section"), "key", "n")))


@job("facet_split_counts", """
SELECT string_split(p_type || '||' || p_brand, '||')[2] AS value, count(*) AS n
FROM part GROUP BY 1""")
def facet_split_counts(spark, sf_dir):
    """Composite facet values ``icon||name`` (here type||brand) split to the
    name part and counted, as the index's facet lists are read."""
    from feedlake.functions.text import split_facet
    p = table(spark, sf_dir, "part")
    composite = F.concat(F.col("p_type"), F.lit("||"), F.col("p_brand"))
    return p.groupBy(split_facet(composite).alias("value")).agg(F.count(F.lit(1)).alias("n"))
