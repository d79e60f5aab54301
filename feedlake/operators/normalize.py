"""Record normalisation: one native ``select`` from raw hits to records.

No Python runs per row: every rule is a built-in expression, and a value
that cannot be converted becomes NULL (``try_*``) instead of failing the job,
so one bad row never stops a load; the validation step quarantines it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.dates import parse_published_date
from feedlake.functions.text import clean_text, decimal_number

# Severity used when a hit has none, and the preview length of
# the component label with its continuation marker.
DEFAULT_SEVERITY = "N/A"
COMPONENT_PREVIEW_ITEMS = 3
COMPONENT_MORE = "..."
MISSING_LIST_LABEL = "N/A"
LIST_SEPARATOR = ", "

# Raw text kept next to the typed value, for the type rules of validation.
RAW_SUFFIX = "_raw"


def _truthy_text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def record_key() -> Column:
    """First non-empty of externalId, name, id."""
    return F.coalesce(_truthy_text(F.col("externalId")), _truthy_text(F.col("name")),
                      _truthy_text(F.col("id")))


def preview_list(arr: Column, items: int = COMPONENT_PREVIEW_ITEMS) -> Column:
    """First ``items`` elements joined by ', ', plus '...' when there are more."""
    head = F.array_join(F.slice(arr, 1, items), LIST_SEPARATOR, "")
    more = F.when(F.size(arr) > items, F.lit(COMPONENT_MORE)).otherwise(F.lit(""))
    return F.when(arr.isNull(), F.lit(MISSING_LIST_LABEL)).otherwise(F.concat(head, more))


def normalize_hits(hits: DataFrame, detail_base: str, keep_raw: bool = True,
                   extra: list[str] | None = None) -> DataFrame:
    """Raw hits (``schemas.HIT`` columns) -> normalised records.

    ``detail_base`` is the prefix of the detail URL (the key is appended in
    lower case). With ``keep_raw`` the raw score texts are kept as
    ``<name>_raw`` columns for ``validate.record_rules``; ``extra`` names
    pass-through columns such as a slice or a sequence number.
    """
    key = record_key()
    score_raw = F.coalesce(F.col("baseScore"), F.col("cnaScore"), F.col("cvssScore"), F.col("score"))
    techs = F.col("affectedTechnologies")
    software = F.col("affectedSoftware")
    empty_links = F.array().cast("array<struct<title:string,url:string,type:string>>")

    cols = [
        key.alias("cve_id"),
        F.coalesce(_truthy_text(F.col("severity")), F.lit(DEFAULT_SEVERITY)).alias("severity"),
        decimal_number(score_raw).alias("score"),
        F.coalesce(F.transform(techs, lambda t: t["name"]), F.array().cast("array<string>")).alias("technologies"),
        preview_list(software).alias("component"),
        parse_published_date("publishedAt").alias("published_date"),
        F.when(key.isNotNull(), F.concat(F.lit(detail_base), F.lower(key))).otherwise(F.lit("")).alias("detail_url"),
        clean_text("description").alias("description"),
        F.coalesce(F.col("sourceUrl"), F.lit("")).alias("source_url"),
        F.coalesce(F.col("hasCisaKevExploit"), F.lit(False)).alias("has_cisa_kev_exploit"),
        F.coalesce(F.col("hasFix"), F.lit(False)).alias("has_fix"),
        F.coalesce(F.col("isHighProfileThreat"), F.lit(False)).alias("is_high_profile_threat"),
        F.coalesce(F.col("exploitable"), F.lit(False)).alias("exploitable"),
        F.struct(
            F.coalesce(F.col("sourceUrl"), F.lit("")).alias("sourceUrl"),
            F.coalesce(software, F.array().cast("array<string>")).alias("affectedSoftware"),
            F.coalesce(techs, F.array().cast("array<struct<name:string,filter:string>>")).alias("affectedTechnologies"),
            empty_links.alias("externalLinks"),
        ).alias("additional_resources"),
        decimal_number("epssPercentile").alias("epss_percentile"),
        decimal_number("epssProbability").alias("epss_probability"),
        decimal_number("baseScore").alias("base_score"),
        decimal_number("cnaScore").alias("cna_score"),
        F.col("cvss2").alias("cvss2"),
        F.col("cvss3").alias("cvss3"),
        F.col("aiDescription").alias("ai_description"),
        F.coalesce(F.col("sourceFeeds"),
                   F.array().cast("array<struct<name:string,id:string,url:string>>")).alias("source_feeds"),
        _truthy_text(F.col("batchId")).alias("batch_id"),
    ]
    if keep_raw:
        cols += [
            score_raw.alias("score" + RAW_SUFFIX),
            F.col("epssPercentile").alias("epss_percentile" + RAW_SUFFIX),
            F.col("epssProbability").alias("epss_probability" + RAW_SUFFIX),
            F.col("baseScore").alias("base_score" + RAW_SUFFIX),
            F.col("cnaScore").alias("cna_score" + RAW_SUFFIX),
        ]
    cols += [F.col(c) for c in (extra or [])]
    return hits.select(*cols)


def drop_raw(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(RAW_SUFFIX)])


def technologies_text(c: Column) -> Column:
    """Display form of the technology list (nulls render as '')."""
    return F.array_join(c, LIST_SEPARATOR, "")
