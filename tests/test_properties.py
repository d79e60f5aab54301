"""Property tests: Spark column rules against small pure-Python brute force."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from feedlake.functions.text import clean_text, extract_score
from feedlake.functions.urls import base_url

# the whitespace set of a JavaScript regex \s, spelled out
JS_WS = "\t\n\x0b\x0c\r   " + "".join(chr(c) for c in range(0x2000, 0x200B)) + \
    "    　﻿"


def py_clean(s):
    if not s:
        return ""
    out, in_ws = [], False
    for ch in s:
        if ch in JS_WS:
            in_ws = True
        else:
            if in_ws and out:
                out.append(" ")
            out.append(ch)
            in_ws = False
    return "".join(out)


def py_score(s):
    if s is None or s == "":
        return None
    m = re.search(r"[0-9]+\.?[0-9]*", s)
    if not m:
        return None
    v = float(m.group(0))
    return v if 0 <= v <= 10 else None


def py_base(u):
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@\s]+)", u or "")
    return f"{m.group(1).lower()}://{m.group(2).lower()}" if m else None


ALPHABET = st.sampled_from(list("ab .,:/-1234567890\t\n") + [" ", " ", "﻿", "　"])
TEXT = st.lists(ALPHABET, max_size=25).map("".join)


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_clean_text_matches_brute_force(spark, values):
    assert _apply(spark, values, clean_text) == [py_clean(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=40))
def test_extract_score_matches_brute_force(spark, values):
    assert _apply(spark, values, extract_score) == [py_score(v) for v in values]


URLS = st.builds(lambda s, u, h, p, rest: f"{s}://{u}{h}{p}{rest}",
                 st.sampled_from(["http", "HTTPS", "ftp", "h2"]), st.sampled_from(["", "user@", "a:b@"]),
                 st.sampled_from(["Ex.com", "a-b.org", "x.y.z", "localhost"]),
                 st.sampled_from(["", ":8080"]), st.sampled_from(["", "/", "/a b?c#d", "?q"]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(URLS, TEXT), min_size=1, max_size=40))
def test_base_url_matches_brute_force(spark, values):
    assert _apply(spark, values, base_url) == [py_base(v) for v in values]


GARBAGE = st.one_of(st.none(), st.text(max_size=12), st.sampled_from(
    ["1e400", "-1e20", "NaN", "Infinity", "99999999999999999999", "0", "", " 7.5 ", "2025-13-45", "1735689600000"]))


@st.composite
def hits(draw):
    from feedlake.schemas import HIT
    row = {f.name: None for f in HIT.fields}
    for name in ("externalId", "name", "id", "severity", "description", "sourceUrl", "batchId", "baseScore",
                 "cnaScore", "cvssScore", "score", "publishedAt", "epssPercentile", "epssProbability"):
        row[name] = draw(GARBAGE)
    row["affectedSoftware"] = draw(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.text(max_size=5)), max_size=5)))
    row["affectedTechnologies"] = draw(st.one_of(st.none(), st.lists(
        st.fixed_dictionaries({"name": st.one_of(st.none(), st.text(max_size=5)), "filter": st.none()}), max_size=3)))
    return row


@settings(max_examples=3, deadline=None)
@given(st.lists(hits(), min_size=1, max_size=30))
def test_garbage_never_fails_a_job(spark, rows):
    from feedlake.operators import report as R
    from feedlake.operators import validate as V
    from feedlake.operators.links import base_urls
    from feedlake.operators.normalize import normalize_hits
    from feedlake.schemas import HIT
    rec = normalize_hits(spark.createDataFrame(rows, HIT), "https://x/")
    acc, q = V.validation_split(rec, V.record_rules())
    assert acc.count() + q.count() == len(rows)
    R.analytics_report(acc).collect()
    R.analytics_report(rec).collect()
    base_urls(rec, ("source_url",)).collect()


def brute_gate(rows, interval_us):
    """Reference rule, one key at a time: admitted iff forced or at least the
    interval after the last admitted execution; minutes left = ceil."""
    out = {}
    last = {}
    for key, t, i, forced in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        lt = last.get(key)
        if forced or lt is None or t - lt >= interval_us:
            out[(key, i)] = (True, 0)
            last[key] = t
        else:
            out[(key, i)] = (False, -(-(interval_us - (t - lt)) // 60_000_000))
    return out


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 600), st.booleans()),
                min_size=1, max_size=60))
def test_gate_matches_brute_force(spark, events):
    import datetime as dt

    from feedlake.operators.runs import min_interval_gate
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(minutes=m), n, f) for n, (k, m, f) in enumerate(events)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, i long, forced boolean")
    us = [(k, int(m * 60_000_000), n, f) for n, (k, m, f) in enumerate(events)]
    want = brute_gate(us, 60 * 60_000_000)
    args = dict(order_cols=("i",), forced="forced", keep=("i",))
    for hot in (None, 1):
        got = {(r.key, r.i): (r.admitted, r.minutes_left)
               for r in min_interval_gate(df, "key", "ts", 60, hot_key_rows=hot, rows_per_bucket=4, **args).collect()}
        assert got == want, hot


def py_class(url, title):
    from urllib.parse import urlsplit
    try:
        host = (urlsplit(url).hostname or "").lower()
    except ValueError:
        host = ""
    t = (title or "").lower()
    if host == "nvd.nist.gov":
        return "NVD"
    if host == "github.com" or host.endswith(".github.com"):
        return "GitHub"
    if host == "vuldb.com":
        return "VulDB"
    if host == "cve.mitre.org":
        return "MITRE"
    if host in ("www.exploit-db.com", "exploit-db.com"):
        return "Exploit-DB"
    if host.startswith("security.") or "advisory" in t:
        return "Security Advisory"
    if "patch" in t or "fix" in t:
        return "Patch/Fix"
    if "poc" in t or "proof of concept" in t:
        return "Proof of Concept"
    return "Other"


LINK_URLS = st.builds(lambda s, h, p: f"{s}://{h}{p}", st.sampled_from(["http", "https", "HTTPS"]),
                      st.sampled_from(["nvd.nist.gov", "NVD.nist.gov", "github.com", "raw.github.com", "notgithub.com",
                                       "vuldb.com", "cve.mitre.org", "www.exploit-db.com", "exploit-db.com",
                                       "security.example.com", "example.com", "evil.com"]),
                      st.sampled_from(["", "/", "/nvd.nist.gov/x", "/github.com/a?b#c", "/p"]))
TITLES = st.lists(st.sampled_from(["Advisory", "patch", "FIX", "PoC", "proof of concept", "note", "x"]),
                  max_size=3).map(" ".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(LINK_URLS, TITLES), min_size=1, max_size=40))
def test_classify_matches_brute_force(spark, pairs):
    from feedlake.functions.urls import classify_link
    df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(pairs)], "i int, u string, t string")
    got = [r[0] for r in df.orderBy("i").select(classify_link(F.col("u"), F.col("t"))).collect()]
    assert got == [py_class(u, t) for u, t in pairs]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.one_of(
    st.integers(-60_000_000_000_000, 250_000_000_000_000).map(str),
    st.builds(lambda d, h, m: f"{d.isoformat()}T{h:02d}:30:00{m}",
              st.dates(min_value=__import__("datetime").date(1971, 1, 1),
                       max_value=__import__("datetime").date(2099, 12, 31)),
              st.integers(0, 23), st.sampled_from(["Z", "+05:30", "-05:00", "+00:00"]))),
    min_size=1, max_size=30))
def test_published_date_matches_brute_force(spark, values):
    import datetime as dt

    from feedlake.functions.dates import parse_published_date

    def py_date(v):
        if v in ("", "0"):
            return None
        if v.lstrip("-").isdigit():
            return (dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=int(v))).date()
        return dt.datetime.fromisoformat(v.replace("Z", "+00:00")).astimezone(dt.timezone.utc).date()

    assert _apply(spark, values, parse_published_date) == [py_date(v) for v in values]
