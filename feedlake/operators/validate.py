"""Validation with quarantine: every failing rule leaves one reason code.

A rule is ``(code, fails)`` where ``fails`` is a boolean Column that is true
when the row breaks the rule (NULL counts as "not failing" only where the
rule says so). ``with_reasons`` adds one ``array<string>`` column in a single
projection; accepted rows are those with an empty array. Nothing is dropped
silently: ``validation_split`` returns both sides, and the reason counts of
the quarantine add up to its rows (one row may carry several reasons).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions.text import decimal_number
from feedlake.operators.normalize import RAW_SUFFIX, drop_raw
from feedlake.schemas import HIT

# The key pattern and the severity domain ('' is allowed).
KEY_PATTERN = r"^CVE-\d{4}-\d+\z"
KEY_PATTERN_SQL = r"CVE-\d{4}-\d+"  # same rule for a full-match engine
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL", "N/A", ""]
REASONS = "reasons"
URI_PATTERN = r'^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>"{}|\\^`]+\z'


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- rule builders -------------------------------------------------------

def rule_required(c, code: str | None = None):
    name = c if isinstance(c, str) else "value"
    return (code or f"missing:{name}", _c(c).isNull())


def rule_pattern(c, pattern: str = KEY_PATTERN, code: str | None = None, required: bool = True):
    name = c if isinstance(c, str) else "value"
    ok = _c(c).rlike(pattern)
    fails = ~F.coalesce(ok, F.lit(False)) if required else (_c(c).isNotNull() & ~ok)
    return (code or f"pattern:{name}", fails)


def rule_in_set(c, values, code: str | None = None, allow_null: bool = True):
    name = c if isinstance(c, str) else "value"
    inside = _c(c).isin(*values)
    fails = (_c(c).isNotNull() & ~inside) if allow_null else ~F.coalesce(inside, F.lit(False))
    return (code or f"domain:{name}", fails)


def rule_range(c, lo=None, hi=None, code: str | None = None):
    """Numeric value outside [lo, hi]; NULL passes (optional field)."""
    name = c if isinstance(c, str) else "value"
    v = _c(c)
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (v < F.lit(lo))
    if hi is not None:
        bad = bad | (v > F.lit(hi))
    return (code or f"range:{name}", F.coalesce(bad, F.lit(False)))


def rule_numeric_text(raw, code: str | None = None):
    """Raw text present but not a number."""
    name = raw if isinstance(raw, str) else "value"
    v = _c(raw)
    return (code or f"bad_type:{name}", v.isNotNull() & decimal_number(v).isNull())


def rule_items(c, code: str | None = None):
    """A list with a missing or empty element; a NULL list passes."""
    name = c if isinstance(c, str) else "value"
    return (code or f"bad_item:{name}", F.coalesce(F.exists(_c(c), lambda x: x.isNull() | (x == "")), F.lit(False)))


def rule_links(c, code: str | None = None):
    """A list of (title, url) with an entry that has no title or whose URL is
    not an absolute URI; a NULL list passes."""
    name = c if isinstance(c, str) else "value"
    bad = F.exists(_c(c), lambda x: x.isNull() | F.coalesce(x["title"] == "", F.lit(True))
                   | ~F.coalesce(x["url"].rlike(URI_PATTERN), F.lit(False)))
    return (code or f"bad_item:{name}", F.coalesce(bad, F.lit(False)))


def hit_type_reasons(text) -> Column:
    """``bad_type:<field>`` for each field of a hit's JSON text that has not the
    type the hit schema asks for (flags, objects, lists and their elements);
    empty when the text is not JSON. Text fields take any scalar."""
    hit = F.try_parse_json(_c(text))

    def wrong(name, dtype):
        kind = F.schema_of_variant(F.try_variant_get(hit, f"$.{name}", "variant"))
        if isinstance(dtype, T.BooleanType):
            ok = kind == "BOOLEAN"
        elif isinstance(dtype, T.MapType):
            ok = kind.startswith("OBJECT")
        else:
            item = "OBJECT" if isinstance(dtype.elementType, T.StructType) else "STRING"
            ok = kind.startswith(f"ARRAY<{item}") | (kind == "ARRAY<VOID>")
        return F.when(kind.isNotNull() & (kind != "VOID") & ~ok, F.lit(f"bad_type:{name}"))

    typed = [f for f in HIT.fields if not isinstance(f.dataType, T.StringType)]
    return F.filter(F.array(*[wrong(f.name, f.dataType) for f in typed]), lambda x: x.isNotNull())


def record_rules(key_pattern: str = KEY_PATTERN) -> list[tuple[str, Column]]:
    """The rule set of a normalised record (``normalize_hits(keep_raw=True)``).

    score: a number must lie in 0..10, while any non-numeric text is allowed
    (it was already turned into NULL); EPSS percentile 0..100 and probability
    0..1, base and CNA scores 0..10, each number or missing; technologies have
    no missing or empty name. The types of flags, objects and lists are settled
    when a hit is parsed (``hit_type_reasons`` names the field that failed).
    """
    rules = [
        rule_required("cve_id", "missing:cve_id"),
        rule_pattern("cve_id", key_pattern, "pattern:cve_id", required=False),
        rule_in_set("severity", SEVERITIES, "domain:severity", allow_null=True),
        rule_range("score", 0, 10, "range:score"),
        rule_items("technologies"),
    ]
    for name, lo, hi in (("epss_percentile", 0, 100), ("epss_probability", 0, 1),
                         ("base_score", 0, 10), ("cna_score", 0, 10)):
        rules.append(rule_numeric_text(name + RAW_SUFFIX, f"bad_type:{name}"))
        rules.append(rule_range(name, lo, hi, f"range:{name}"))
    return rules


# ---- application ---------------------------------------------------------

def reasons_column(rules) -> Column:
    """``array<string>`` of the codes of every failing rule (one expression)."""
    return F.filter(F.array(*[F.when(fails, F.lit(code)) for code, fails in rules]),
                    lambda x: x.isNotNull())


def with_reasons(df: DataFrame, rules) -> DataFrame:
    return df.withColumn(REASONS, reasons_column(rules))


def any_failure(rules) -> Column:
    """True when at least one rule fails: a short-circuit OR, no array built."""
    out = None
    for _, fails in rules:
        f = F.coalesce(fails, F.lit(False))
        out = f if out is None else (out | f)
    return out if out is not None else F.lit(False)


def validation_split(df: DataFrame, rules, drop_raw_columns: bool = True):
    """-> (accepted, quarantine). Both come from the same projection.

    The split predicate is a plain OR of the rule conditions (Catalyst may
    push it into the scan stage); the reasons array is only built for the
    quarantined side. When both sides are written, write them from one
    checkpointed (or persisted) frame so the source is scanned once.
    """
    bad = any_failure(rules)
    accepted = df.filter(~bad)
    quarantine = df.filter(bad).withColumn(REASONS, reasons_column(rules))
    if drop_raw_columns:
        accepted = drop_raw(accepted)
    return accepted, quarantine


def validation_reasons(df: DataFrame, rules) -> DataFrame:
    """Reason code counts over the quarantined rows: (reason, n)."""
    return (df.filter(any_failure(rules)).select(F.explode(reasons_column(rules)).alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def validation_summary(df: DataFrame, rules=None, key: str = "cve_id",
                       key_pattern: str = KEY_PATTERN) -> DataFrame:
    """One row: total, valid, invalid, status (PASSED iff nothing invalid).

    Without ``rules`` only the key format is checked (the report of the
    ``validate`` command); with rules the full record validation is used.
    """
    if rules is None:
        valid = F.coalesce(F.col(key).rlike(key_pattern), F.lit(False))
    else:
        valid = ~any_failure(rules)
    agg = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"))
    return agg.select(
        "total", "valid", (F.col("total") - F.col("valid")).alias("invalid"),
        F.when(F.col("total") == F.col("valid"), F.lit("PASSED")).otherwise(F.lit("FAILED")).alias("status"))


def valid_key_filter(df: DataFrame, key: str = "cve_id", key_pattern: str = KEY_PATTERN) -> DataFrame:
    return df.filter(F.coalesce(F.col(key).rlike(key_pattern), F.lit(False)))
