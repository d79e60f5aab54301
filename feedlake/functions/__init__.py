"""Column -> Column helpers. All are built-in Spark expressions (codegen'd)."""

from feedlake.functions.text import clean_text, extract_score, split_facet, ascii_lower, contains_literal, js_trim  # noqa: F401
from feedlake.functions.dates import parse_published_date  # noqa: F401
from feedlake.functions.urls import base_url, url_host, classify_link, DEFAULT_LINK_RULES  # noqa: F401
from feedlake.functions.jsoncols import decode_json, encode_json  # noqa: F401
