"""URL rules: scheme://host, host extraction and link classification."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# scheme, optional user-info (up to the last "@"), host (port, path, query and
# fragment excluded; an IPv6 host keeps its brackets). "\" ends the authority as
# "/" does. Anchored, so "not-a-url" and bare paths give no match.
URL_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#\\\s]*@)?(\[[^\]/?#\\\s]*\]|[^/?#\\:@\s]+)"

# Link classes, tried in this order; the first rule that matches
# wins, host rules before title rules. A rule is (class, test, values) with
# test one of host_eq, host_suffix, host_prefix, title_contains; values are
# lower-case. Anything unmatched is "Other".
DEFAULT_LINK_RULES = [
    ("NVD", "host_eq", ["nvd.nist.gov"]),
    ("GitHub", "host_eq", ["github.com"]),
    ("GitHub", "host_suffix", [".github.com"]),
    ("VulDB", "host_eq", ["vuldb.com"]),
    ("MITRE", "host_eq", ["cve.mitre.org"]),
    ("Exploit-DB", "host_eq", ["www.exploit-db.com", "exploit-db.com"]),
    ("Security Advisory", "host_prefix", ["security."]),
    ("Security Advisory", "title_contains", ["advisory"]),
    ("Patch/Fix", "title_contains", ["patch", "fix"]),
    ("Proof of Concept", "title_contains", ["poc", "proof of concept"]),
]
OTHER_CLASS = "Other"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_host(c) -> Column:
    """Lower-case host of an absolute URL; '' when the text is not a URL."""
    return F.lower(F.regexp_extract(_c(c), URL_PARTS, 2))


def base_url(c) -> Column:
    """``scheme://host`` in lower case; NULL when the text is not a URL."""
    parts_ok = _c(c).rlike(URL_PARTS)
    return F.when(parts_ok, F.concat(F.lower(F.regexp_extract(_c(c), URL_PARTS, 1)),
                                     F.lit("://"), url_host(c)))


# The full stops that separate labels of a host beside "."
_STOPS = re.compile("[\u3002\uff0e\uff61]")


def _ascii_label(label: str) -> str:
    if label.isascii():
        return label
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", label).lower())
    folded = folded.replace("\u00ad", "").replace("\u200b", "")  # soft hyphen and zero-width space are ignored
    return folded if folded.isascii() else "xn--" + folded.encode("punycode").decode("ascii")


def ascii_host_name(host: str | None) -> str | None:
    """The ASCII form of a host: each label with other letters in Punycode after ``xn--``, compatibility forms
    and case folded; sharp s and final sigma are letters of their own. ASCII hosts stay as they are."""
    if host is None or host.isascii():
        return host
    return ".".join(_ascii_label(label) for label in _STOPS.sub(".", host).split("."))


@F.pandas_udf(StringType())
def _ascii_urls(urls: pd.Series) -> pd.Series:
    parts = urls.str.partition("://")
    return parts[0] + "://" + parts[2].map(ascii_host_name)


def ascii_base_url(c) -> Column:
    """``scheme://host`` with the host in ASCII form (NULL stays NULL). Arrow batches in Python: apply it to
    distinct base URLs, not to rows."""
    return _ascii_urls(_c(c))


def _rule_test(kind: str, values: list[str], host: Column, title: Column) -> Column:
    tests = []
    for v in values:
        if kind == "host_eq":
            tests.append(host == F.lit(v))
        elif kind == "host_suffix":
            tests.append(host.endswith(v))
        elif kind == "host_prefix":
            tests.append(host.startswith(v))
        elif kind == "title_contains":
            tests.append(F.instr(title, v) > 0)
        else:
            raise ValueError(f"unknown rule test {kind!r}")
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def classify_link(url, title, rules=None) -> Column:
    """Class of a link from an ordered rule list (one CASE WHEN chain)."""
    rules = DEFAULT_LINK_RULES if rules is None else rules
    host = url_host(url)
    low_title = F.lower(F.coalesce(_c(title), F.lit("")))
    expr = None
    for cls, kind, values in rules:
        test = _rule_test(kind, values, host, low_title)
        expr = F.when(test, F.lit(cls)) if expr is None else expr.when(test, F.lit(cls))
    return expr.otherwise(F.lit(OTHER_CLASS)) if expr is not None else F.lit(OTHER_CLASS)
