"""Record jobs: normalisation, JSON columns, validation, schema alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.jsoncols import encode_json
from feedlake.operators import validate as V
from feedlake.operators.normalize import normalize_hits, technologies_text
from feedlake.operators.upsert import align_schema
from feedlake.plans.catalog import job
from feedlake.plans.tables import DETAIL_BASE, clean_sql, props_k, table

TS_FMT, TS_SQL = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"


def event_hits(spark, sf_dir):
    """events as raw hits, exercising the projection's fall-backs:
    view events carry their key in ``name`` only, click events have an empty
    severity, purchase events no baseScore (so cnaScore is used), signup
    events an ISO date with a -05:00 offset (others epoch milliseconds),
    descriptions carry messy whitespace, purchases list four programs."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    key = F.concat(F.lit("CVE-"), F.year("ts").cast("string"), F.lit("-"), F.col("event_id").cast("string"))
    k = props_k()
    software = F.when(et == "purchase", F.array(et, F.concat(F.lit("u"), F.col("user_id").cast("string")),
                                                  F.concat(F.lit("k"), k.cast("string")), F.lit("extra")))
    software = software.otherwise(F.array(et, F.concat(F.lit("u"), F.col("user_id").cast("string")),
                                          F.concat(F.lit("k"), k.cast("string"))))
    return ev.select(
        F.when(et != "view", key).alias("externalId"), key.alias("name"), F.lit(None).cast("string").alias("id"),
        F.when(et == "click", F.lit("")).otherwise(F.upper(et)).alias("severity"),
        F.concat(F.lit("  "), et, F.lit("\t\n event \u00a0 "), F.col("props"), F.lit(" \r\n")).alias("description"),
        F.concat(F.lit("https://events.example.org/"), et, F.lit("/"), F.col("event_id").cast("string")).alias("sourceUrl"),
        F.lit(None).cast("string").alias("batchId"),
        F.when(et != "purchase", F.col("value").cast("string")).alias("baseScore"),
        F.col("value").cast("string").alias("cnaScore"),
        F.lit(None).cast("string").alias("cvssScore"), F.lit(None).cast("string").alias("score"),
        F.when(et == "signup", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")))
         .otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("publishedAt"),
        F.array(F.struct(et.alias("name"), F.concat(F.lit("type:"), et).alias("filter"))).alias("affectedTechnologies"),
        software.alias("affectedSoftware"),
        F.lit(None).cast("boolean").alias("hasCisaKevExploit"), (et == "purchase").alias("hasFix"),
        F.lit(None).cast("boolean").alias("isHighProfileThreat"), F.lit(None).cast("boolean").alias("exploitable"),
        k.cast("string").alias("epssPercentile"), F.lit(None).cast("string").alias("epssProbability"),
        F.lit(None).cast("map<string,string>").alias("cvss2"), F.lit(None).cast("map<string,string>").alias("cvss3"),
        F.lit(None).cast("array<struct<name:string,id:string,url:string>>").alias("sourceFeeds"),
        F.lit(None).cast("map<string,string>").alias("aiDescription"),
    )


_KEY_SQL = "'CVE-' || cast(year(ts) AS VARCHAR) || '-' || cast(event_id AS VARCHAR)"
_K_SQL = "cast(json_extract(props, '$.k') AS BIGINT)"


_clean_sql = clean_sql


NORMALIZE_SQL = f"""
SELECT {_KEY_SQL} AS cve_id,
       CASE WHEN event_type = 'click' THEN 'N/A' ELSE upper(event_type) END AS severity,
       value AS score,
       event_type AS technologies,
       CASE WHEN event_type = 'purchase'
            THEN event_type || ', u' || cast(user_id AS VARCHAR) || ', k' || cast({_K_SQL} AS VARCHAR) || '...'
            ELSE event_type || ', u' || cast(user_id AS VARCHAR) || ', k' || cast({_K_SQL} AS VARCHAR) END AS component,
       cast(CASE WHEN event_type = 'signup' THEN cast(date_trunc('second', ts) + INTERVAL 5 HOUR AS DATE)
            ELSE cast(epoch_ms(epoch_ms(ts)) AS DATE) END AS VARCHAR) AS published_date,
       '{DETAIL_BASE}' || lower({_KEY_SQL}) AS detail_url,
       {_clean_sql("'  ' || event_type || chr(9) || chr(10) || ' event ' || chr(160) || ' ' || props || ' ' || chr(13) || chr(10)")} AS description,
       'https://events.example.org/' || event_type || '/' || cast(event_id AS VARCHAR) AS source_url,
       event_type = 'purchase' AS has_fix, false AS exploitable,
       cast({_K_SQL} AS DOUBLE) AS epss_percentile
FROM events"""


@job("normalize_records", NORMALIZE_SQL)
def normalize_records(spark, sf_dir):
    rec = normalize_hits(event_hits(spark, sf_dir), DETAIL_BASE)
    return rec.select("cve_id", "severity", "score", technologies_text(F.col("technologies")).alias("technologies"),
                      "component", F.col("published_date").cast("string").alias("published_date"),
                      "detail_url", "description", "source_url", "has_fix", "exploitable", "epss_percentile")


@job("json_column_decode", f"SELECT event_id, {_K_SQL} AS k FROM events")
def json_column_decode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", props_k().alias("k"))


@job("json_column_encode",
     f"SELECT event_id, to_json({{'event_id': event_id, 'event_type': event_type, 'k': {_K_SQL}}}) AS doc FROM events")
def json_column_encode(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", encode_json(F.struct("event_id", "event_type", props_k().alias("k"))).alias("doc"))


# ---- validation ------------------------------------------------------------
# Validation view of events: error events carry a lower-case key prefix and a
# severity outside the domain; the score is value/10 on the 0..10 scale.

def validation_view(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    prefix = F.when(et == "error", F.lit("cve-")).otherwise(F.lit("CVE-"))
    sev = (F.when(et == "click", "LOW").when(et == "view", "MEDIUM").when(et == "purchase", "HIGH")
           .when(et == "signup", "CRITICAL").otherwise(F.lower(et)))
    return ev.select(
        F.concat(prefix, F.year("ts").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("cve_id"),
        sev.alias("severity"), (F.col("value") / 10).alias("score"),
        props_k().cast("string").alias("epss_percentile_raw"), props_k().cast("double").alias("epss_percentile"))


def validation_rules():
    return [
        V.rule_required("cve_id", "missing:cve_id"),
        V.rule_pattern("cve_id", V.KEY_PATTERN, "pattern:cve_id", required=False),
        V.rule_in_set("severity", V.SEVERITIES, "domain:severity"),
        V.rule_range("score", 0, 10, "range:score"),
        V.rule_numeric_text("epss_percentile_raw", "bad_type:epss_percentile"),
        V.rule_range("epss_percentile", 0, 100, "range:epss_percentile"),
    ]


_VVIEW = f"""
WITH v AS (
  SELECT CASE WHEN event_type = 'error' THEN 'cve-' ELSE 'CVE-' END || cast(year(ts) AS VARCHAR) || '-' || cast(event_id AS VARCHAR) AS cve_id,
         CASE event_type WHEN 'click' THEN 'LOW' WHEN 'view' THEN 'MEDIUM' WHEN 'purchase' THEN 'HIGH'
                         WHEN 'signup' THEN 'CRITICAL' ELSE lower(event_type) END AS severity,
         value / 10 AS score, cast({_K_SQL} AS DOUBLE) AS epss_percentile
  FROM events),
 r AS (
  SELECT *, list_filter([
      CASE WHEN cve_id IS NULL THEN 'missing:cve_id' END,
      CASE WHEN cve_id IS NOT NULL AND NOT regexp_full_match(cve_id, '{V.KEY_PATTERN_SQL}') THEN 'pattern:cve_id' END,
      CASE WHEN severity IS NOT NULL AND severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'N/A', '') THEN 'domain:severity' END,
      CASE WHEN score < 0 OR score > 10 THEN 'range:score' END,
      CASE WHEN epss_percentile < 0 OR epss_percentile > 100 THEN 'range:epss_percentile' END
    ], lambda x: x IS NOT NULL) AS reasons
  FROM v)"""


@job("validation_accepted", _VVIEW + " SELECT cve_id, severity, score FROM r WHERE len(reasons) = 0")
def validation_accepted(spark, sf_dir):
    acc, _ = V.validation_split(validation_view(spark, sf_dir), validation_rules())
    return acc.select("cve_id", "severity", "score")


@job("validation_quarantine",
     _VVIEW + " SELECT cve_id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0")
def validation_quarantine(spark, sf_dir):
    _, q = V.validation_split(validation_view(spark, sf_dir), validation_rules())
    return q.select("cve_id", F.array_join("reasons", ",").alias("reasons"))


@job("validation_reasons", _VVIEW + " SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason")
def validation_reasons(spark, sf_dir):
    return V.validation_reasons(validation_view(spark, sf_dir), validation_rules())


@job("validation_summary", _VVIEW + """
 SELECT count(*) AS total, count(*) FILTER (WHERE len(reasons) = 0) AS valid,
        count(*) FILTER (WHERE len(reasons) > 0) AS invalid,
        CASE WHEN count(*) FILTER (WHERE len(reasons) > 0) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM r""")
def validation_summary(spark, sf_dir):
    return V.validation_summary(validation_view(spark, sf_dir), validation_rules())


@job("valid_key_filter", _VVIEW + f" SELECT cve_id FROM v WHERE regexp_full_match(cve_id, '{V.KEY_PATTERN_SQL}')")
def valid_key_filter(spark, sf_dir):
    return V.valid_key_filter(validation_view(spark, sf_dir)).select("cve_id")


@job("align_schema", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'UNKNOWN' AS c_mktsegment FROM customer")
def align_schema_job(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    full = cust.schema
    older = cust.drop("c_mktsegment")  # a slice written before the column existed
    return align_schema(older, full, {"c_mktsegment": "UNKNOWN"})


@job("ordered_export", f"SELECT {_KEY_SQL} AS cve_id, event_type, value FROM events ORDER BY cve_id")
def ordered_export(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    key = F.concat(F.lit("CVE-"), F.year("ts").cast("string"), F.lit("-"), F.col("event_id").cast("string"))
    return ev.select(key.alias("cve_id"), "event_type", "value").orderBy("cve_id")


@job("key_validation_summary", _VVIEW + f"""
 SELECT count(*) AS total,
        count(*) FILTER (WHERE coalesce(regexp_full_match(cve_id, '{V.KEY_PATTERN_SQL}'), false)) AS valid,
        count(*) FILTER (WHERE NOT coalesce(regexp_full_match(cve_id, '{V.KEY_PATTERN_SQL}'), false)) AS invalid,
        CASE WHEN count(*) FILTER (WHERE NOT coalesce(regexp_full_match(cve_id, '{V.KEY_PATTERN_SQL}'), false)) = 0
             THEN 'PASSED' ELSE 'FAILED' END AS status FROM v""")
def key_validation_summary(spark, sf_dir):
    """The ``validate`` command's report: the key format only."""
    return V.validation_summary(validation_view(spark, sf_dir))


@job("capped_load", _VVIEW + """
 SELECT cve_id, severity, score FROM r WHERE len(reasons) = 0
 ORDER BY cve_id LIMIT 500""")
def capped_load(spark, sf_dir):
    """The per-load cap on accepted records (the cap is the feature): the
    first 500 accepted by key, an explicit order since arrival order is not
    reproducible on a cluster (TakeOrderedAndProject, no global sort)."""
    from feedlake.operators.dedupe import cap_total
    acc, _ = V.validation_split(validation_view(spark, sf_dir), validation_rules())
    return cap_total(acc, 500, ["cve_id"]).select("cve_id", "severity", "score")
