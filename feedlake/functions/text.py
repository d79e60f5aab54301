"""Text rules: whitespace cleaning, score extraction, facet splitting, search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. The whitespace class of a JavaScript regex `\s`: ASCII
# whitespace, vertical tab, NBSP, U+1680, U+2000..U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000, U+FEFF. Java's `\s` is ASCII-only, so the class is
# spelled out; the same text works in RE2 (DuckDB).
WHITESPACE_RUN = (r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
                  r"\x{202F}\x{205F}\x{3000}\x{FEFF}]+")
# First unsigned number in a text (sign is ignored), and the score range.
FIRST_NUMBER = r"\d+\.?\d*"
# A decimal number as text: no type suffixes, hexadecimal or names of numbers.
DECIMAL_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
SCORE_MIN, SCORE_MAX = 0.0, 10.0
# Separator of a composite facet value "icon||name".
FACET_SEPARATOR = r"\|\|"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Collapse every whitespace run to one space and trim; NULL -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), WHITESPACE_RUN, " "))


def extract_score(c) -> Column:
    """First number in the text as a double, kept only within 0..10.

    ``'CVSS: 7.2'`` -> 7.2, ``'-5'`` -> 5, ``'11.5'`` -> NULL, ``''`` -> NULL.
    """
    txt = _c(c).cast("string")
    num = F.nullif(F.regexp_extract(txt, FIRST_NUMBER, 0), F.lit("")).try_cast("double")
    return F.when((num >= SCORE_MIN) & (num <= SCORE_MAX), num)


def split_facet(c, position: int = 2) -> Column:
    """Element of a ``a||b`` composite facet value; NULL when absent."""
    return F.try_element_at(F.split(_c(c), FACET_SEPARATOR), F.lit(position))


def ascii_lower(c) -> Column:
    """Lower-case ASCII letters only (the case folding of SQLite's LIKE)."""
    return F.translate(_c(c), _UPPER, _LOWER)


def contains_literal(c, needle: str, ascii_fold: bool = True) -> Column:
    """Case-insensitive *literal* substring test (``%``/``_`` are not wildcards)."""
    if ascii_fold:
        return F.coalesce(F.instr(ascii_lower(c), needle.translate(str.maketrans(_UPPER, _LOWER))) > 0,
                          F.lit(False))
    return F.coalesce(F.instr(F.lower(_c(c)), needle.lower()) > 0, F.lit(False))


def js_trim(c) -> Column:
    """Strip leading/trailing whitespace of the full (Unicode) class, as
    JavaScript's ``String.prototype.trim``; Spark's ``trim`` strips spaces only."""
    cls = WHITESPACE_RUN[:-1]  # the class without the trailing '+'
    return F.regexp_replace(_c(c), f"^{cls}+|{cls}+$", "")


def decimal_number(c) -> Column:
    """Text of a decimal number -> double; NULL for any other text."""
    return F.when(_c(c).rlike(DECIMAL_TEXT), F.trim(_c(c)).try_cast("double"))
