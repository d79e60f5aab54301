"""Table access and the record views the jobs are bound to.

The driver's tables hold no vulnerability feed, so the record-shaped jobs
run on views derived from them (documented per view); the operators take
column names, so the same code runs on a real feed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions.jsoncols import decode_json

PROPS_SCHEMA = "k bigint"
# Fixed values for the bindings: the detail URL prefix used in the record
# view (a neutral placeholder host), and the load time of the upsert batch.
DETAIL_BASE = "https://records.example.org/cve/"
LOAD_TIME = "2024-02-01 00:00:00"


# White space by code point (fixed values), for the oracles: every one becomes a blank,
# runs of blanks become one.
SPACE_CODES = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
SPACES_SQL = "(" + " || ".join(f"chr({c})" for c in SPACE_CODES) + ")"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({x}, ''), {SPACES_SQL}, repeat(' ', {len(SPACE_CODES)})), ' +', ' ', 'g'), ' ')"


def ensure_utc(spark: SparkSession) -> None:
    """Dates and epoch conversions assume a UTC session zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def props_k() -> F.Column:
    return decode_json("props", PROPS_SCHEMA)["k"]


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as normalised records.

    key ``CVE-<year of ts>-<event_id>``, severity = upper(event_type),
    score = value, technologies = [event_type, 'k<props.k>'],
    component = 'user-<user_id>', published_date = date(ts),
    created_at = ts.
    """
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("CVE-"), F.year("ts").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("cve_id"),
        F.upper("event_type").alias("severity"),
        F.col("value").alias("score"),
        F.array(F.col("event_type"), F.concat(F.lit("k"), props_k().cast("string"))).alias("technologies"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("component"),
        F.to_date("ts").alias("published_date"),
        F.col("ts").alias("created_at"),
        F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("value"), F.col("ts"),
    )


EVENT_RECORDS_SQL = """
  SELECT 'CVE-' || cast(year(ts) AS VARCHAR) || '-' || cast(event_id AS VARCHAR) AS cve_id,
         upper(event_type) AS severity, value AS score,
         [event_type, 'k' || cast(cast(json_extract(props, '$.k') AS BIGINT) AS VARCHAR)] AS technologies,
         'user-' || cast(user_id AS VARCHAR) AS component,
         cast(ts AS DATE) AS published_date, ts AS created_at,
         event_id, user_id, event_type, value, ts
  FROM events"""

