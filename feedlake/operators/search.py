"""Search, paging, lookup and triage filters over a record table.

Equality filters reach the Parquet reader as pushed filters; substring search
is a full scan by nature (no file can be skipped on it). Paging sorts newest
first with the key as a tiebreak so that pages are stable; a deep ``offset``
keeps offset+limit rows per task, so ``search_page_keyset`` (seek after the
last row of the previous page) is offered for deep paging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import contains_literal

# Page size used when the limit is missing, zero or not a number.
DEFAULT_LIMIT = 100
MIN_LIMIT = 1


def clamp_limit(limit) -> int:
    try:
        n = int(str(limit).strip()) if limit is not None else 0
    except ValueError:
        n = 0
    return max(MIN_LIMIT, n or DEFAULT_LIMIT)


def clamp_offset(offset) -> int:
    try:
        n = int(str(offset).strip()) if offset is not None else 0
    except ValueError:
        n = 0
    return max(0, n)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_match(cols, query: str, wildcards: bool = False) -> Column:
    """OR over columns of a case-insensitive substring test.

    Literal by default (``%`` and ``_`` match themselves); ``wildcards=True``
    treats them as LIKE wildcards, a backslash as itself; case is folded for
    ASCII letters only.
    """
    tests = []
    for c in cols:
        if wildcards:
            pattern = query.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
            tests.append(F.coalesce(F.translate(F.col(c), _UPPER, _LOWER).like(f"%{pattern}%"), F.lit(False)))
        else:
            tests.append(contains_literal(c, query))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def filter_records(df: DataFrame, severity: str | None = None, search: str | None = None,
                   severity_col: str = "severity",
                   search_cols=("cve_id", "component", "description"),
                   wildcards: bool = False) -> DataFrame:
    if severity:
        df = df.filter(F.col(severity_col) == F.lit(severity))
    if search:
        df = df.filter(text_match(list(search_cols), search, wildcards))
    return df


def search_page(df: DataFrame, severity: str | None = None, search: str | None = None,
                limit=DEFAULT_LIMIT, offset=0, newest_col: str = "created_at", key: str = "cve_id",
                severity_col: str = "severity", search_cols=("cve_id", "component", "description"),
                wildcards: bool = False) -> DataFrame:
    """Newest first, key ascending on ties, then OFFSET/LIMIT (clamped)."""
    n, o = clamp_limit(limit), clamp_offset(offset)
    out = filter_records(df, severity, search, severity_col, search_cols, wildcards)
    out = out.orderBy(F.col(newest_col).desc_nulls_last(), F.col(key).asc())
    return out.offset(o).limit(n) if o else out.limit(n)


def search_page_keyset(df: DataFrame, after=None, severity: str | None = None,
                       search: str | None = None, limit=DEFAULT_LIMIT,
                       newest_col: str = "created_at", key: str = "cve_id",
                       severity_col: str = "severity",
                       search_cols=("cve_id", "component", "description")) -> DataFrame:
    """The page after ``after = (newest_value, key_value)`` of the same order.

    The seek predicate is a plain comparison, pushed to the scan; each task
    keeps only ``limit`` rows however deep the page is.
    """
    n = clamp_limit(limit)
    out = filter_records(df, severity, search, severity_col, search_cols)
    if after is not None:
        t, k = after
        newest = F.col(newest_col)
        if t is None:  # rows without a time come last, by key
            out = out.filter(newest.isNull() & (F.col(key) > F.lit(k)))
        else:
            tv = F.lit(t).cast(df.schema[newest_col].dataType)
            out = out.filter((newest < tv) | ((newest == tv) & (F.col(key) > F.lit(k))) | newest.isNull())
    return out.orderBy(F.col(newest_col).desc_nulls_last(), F.col(key).asc()).limit(n)


def search_totals(df: DataFrame, severity: str | None = None, search: str | None = None,
                  severity_col: str = "severity",
                  search_cols=("cve_id", "component", "description")) -> DataFrame:
    """(total_all, total_matching) in one pass."""
    cond = F.lit(True)
    if severity:
        cond = cond & F.coalesce(F.col(severity_col) == F.lit(severity), F.lit(False))
    if search:
        cond = cond & text_match(list(search_cols), search)
    return df.agg(F.count(F.lit(1)).alias("total_all"), F.count_if(cond).alias("total_matching"))


def lookup_by_key(df: DataFrame, value, key: str = "cve_id") -> DataFrame:
    """At most one row after an upsert; an unknown key gives an empty frame."""
    return df.filter(F.col(key) == F.lit(value))


def facet_filter(df: DataFrame, array_col: Column | str, values) -> DataFrame:
    """Rows whose facet values overlap ``values`` (OR inside the list)."""
    arr = F.col(array_col) if isinstance(array_col, str) else array_col
    wanted = F.array(*[F.lit(v) for v in values])
    return df.filter(F.coalesce(F.arrays_overlap(arr, wanted), F.lit(False)))


# ---- triage predicates (composable) --------------------------------------

def severity_in(c: str, values) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def any_element_contains(c, text: str) -> Column:
    arr = F.col(c) if isinstance(c, str) else c
    t = text.lower()
    return F.coalesce(F.exists(arr, lambda x: F.instr(F.lower(x), t) > 0), F.lit(False))


def at_least(c: str, threshold) -> Column:
    return F.coalesce(F.col(c) >= F.lit(threshold), F.lit(False))


def triage_summary(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Total plus one (non-exclusive) count per named predicate, one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count_if(p).alias(name) for name, p in predicates.items()])
