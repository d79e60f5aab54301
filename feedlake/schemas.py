"""Explicit schemas. Production reads never infer a schema."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, B, L = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


TECHNOLOGY = T.StructType([_f("name", S), _f("filter", S)])
SOURCE_FEED = T.StructType([_f("name", S), _f("id", S), _f("url", S)])
LINK = T.StructType([_f("title", S), _f("url", S), _f("type", S)])
OPEN_OBJECT = T.MapType(S, S)

# A raw hit as landed from the remote index. Scores are kept as text so that
# "number or any string" (the validation rule) can still be told apart;
# publishedAt is epoch milliseconds or an ISO string, so it is text too.
HIT = T.StructType([
    _f("externalId", S), _f("name", S), _f("id", S),
    _f("severity", S), _f("description", S), _f("sourceUrl", S), _f("batchId", S),
    _f("baseScore", S), _f("cnaScore", S), _f("cvssScore", S), _f("score", S),
    _f("publishedAt", S),
    _f("affectedTechnologies", T.ArrayType(TECHNOLOGY)),
    _f("affectedSoftware", T.ArrayType(S)),
    _f("hasCisaKevExploit", B), _f("hasFix", B), _f("isHighProfileThreat", B), _f("exploitable", B),
    _f("epssPercentile", S), _f("epssProbability", S),
    _f("cvss2", OPEN_OBJECT), _f("cvss3", OPEN_OBJECT),
    _f("sourceFeeds", T.ArrayType(SOURCE_FEED)),
    _f("aiDescription", OPEN_OBJECT),
])

# Page envelopes: cursor style and search style. Hits stay JSON text here and are
# parsed one by one, so a bad hit costs itself and not its page. Both levels carry
# a corrupt-text column: what cannot be read is kept and quarantined.
# ``page_seq`` (optional) is the fetcher's page number: later pages win.
CORRUPT = "_corrupt_record"
CORRUPT_HIT = "_corrupt_hit"
HIT_TEXT = T.StructType([*HIT.fields, _f(CORRUPT_HIT, S)])
PAGE = T.StructType([
    _f("hits", T.ArrayType(S)),
    _f("cursor", S),
    _f("nbHits", L),
    _f("results", T.ArrayType(T.StructType([_f("hits", T.ArrayType(S)), _f("nbHits", L)]))),
    _f("page_seq", L),
    _f(CORRUPT, S),
])
# A page and the name of its slice folder (NULL without one).
SLICED_PAGE = T.StructType([*PAGE.fields, _f("slice", S)])

RESOURCES = T.StructType([
    _f("sourceUrl", S),
    _f("affectedSoftware", T.ArrayType(S)),
    _f("affectedTechnologies", T.ArrayType(TECHNOLOGY)),
    _f("externalLinks", T.ArrayType(LINK)),
])

# The normalised record (the store's row).
RECORD = T.StructType([
    _f("cve_id", S), _f("severity", S), _f("score", D),
    _f("technologies", T.ArrayType(S)), _f("component", S),
    _f("published_date", T.DateType()), _f("detail_url", S), _f("description", S),
    _f("source_url", S),
    _f("has_cisa_kev_exploit", B), _f("has_fix", B), _f("is_high_profile_threat", B),
    _f("exploitable", B),
    _f("additional_resources", RESOURCES),
    _f("epss_percentile", D), _f("epss_probability", D), _f("base_score", D), _f("cna_score", D),
    _f("cvss2", OPEN_OBJECT), _f("cvss3", OPEN_OBJECT), _f("ai_description", OPEN_OBJECT),
    _f("source_feeds", T.ArrayType(SOURCE_FEED)),
    _f("batch_id", S),
    _f("created_at", T.TimestampType()), _f("updated_at", T.TimestampType()),
])

# Bookkeeping: run events (folded into runs), progress snapshots, executions.
RUN_EVENT = T.StructType([
    _f("job_id", S), _f("seq", L), _f("started_at", T.TimestampType()),
    _f("completed_at", T.TimestampType()), _f("status", S), _f("total", L),
    _f("error_message", S),
])
PROGRESS = T.StructType([
    _f("batch_id", S), _f("ts", T.TimestampType()), _f("processed_count", L),
    _f("current_index", L),
])
EXECUTION = T.StructType([
    _f("job_type", S), _f("executed_at", T.TimestampType()), _f("seq", L), _f("forced", B),
])
