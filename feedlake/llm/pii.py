"""Personal data: patterns, and information-theoretic sanitisation.

Base spans are found by pattern (fixed values of the query's contract). Each
distinct value (an address, a card number) is a protected entity. Terms that
stand within ``CONTEXT`` words of an entity are counted with it over the whole
corpus, and every term's documents are counted. A term discloses an entity
when knowing the term leaves at most ``MAX_BITS`` of the entity's information:

    IC(e) - PMI(e; t) = -log2 p(e | t) <= MAX_BITS

and the pair was seen in at least ``MIN_TEXTS`` different texts. For a term
that no text holds without the entity, ``DECISIVE_TEXTS`` are enough if the
words around the entity differ (a passage copied whole counts once here).
Exact copies always count once. Terms above the threshold get spans of kind ``term`` wherever they occur outside base
spans; ``sanitise`` generalises base spans to their kind and removes terms.

Texts go through Python once for the contexts (only documents with an entity
leave that pass) and once for the spans; in the second pass a bitmap of a
fixed number of bits drops terms before the exact join, whose false positives
the join removes. Term counts are pre-aggregated per task. A hot entity or
term is a sum, never a group.

Defined cases: NULL text is empty and has no spans; repeated rows get equal
results; a row counts once for a pair; spans that tie in their start are ordered
by kind. Texts of any length are scanned whole. Extra columns are ignored, whatever
their names; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import cut, null_key, slices

CONTEXT = 8
MAX_BITS = 0.5
MIN_TEXTS = 5
DECISIVE_TEXTS = 2
FILTER_BITS = 1 << 24
#: Words whose look-up a task remembers: how many, and the longest.
REMEMBERED = 1 << 16
USUAL_LENGTH = 64
KINDS = ("email", "ip", "card", "phone", "term")
# patterns and bounds fixed by the contract; the look-behinds only skip starts
# inside a run, from which no other match can begin
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# a term: a run of characters other than ASCII punctuation and controls
_TERM_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        head = text[done:at]  # from the last match, or the last sign: neither is part of a local name
        start = at - len(head) + len(head.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _is_octet(digits: str) -> bool:
    value = digits.lstrip("0")  # zeros first: a run of digits may be longer than int() takes
    return len(value) < 4 and int(value or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_is_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def term_hash(term: str) -> int:
    """As Spark's xxhash64 of the lower-case term."""
    x = xxhash.xxh64_intdigest(term.lower().encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def _free_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms that touch no base span."""
    bounds, out, i = sorted((a, b) for _, a, b in spans), [], 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        while i < len(bounds) and bounds[i][1] <= a:
            i += 1
        # spans of different kinds may overlap: look at all that begin before the term ends
        j = i
        while j < len(bounds) and bounds[j][0] < b and bounds[j][1] <= a:
            j += 1
        if j == len(bounds) or bounds[j][0] >= b:
            out.append((a, b, m[0]))
    return out


def _contexts(text: str) -> list[tuple[int, int, int]]:
    """Distinct (entity, term) hashes of the terms near each entity, with the
    hash of all words around the first mention that has the pair."""
    spans = base_spans(text)
    if not spans:
        return []
    terms = _free_terms(text, spans)
    starts = [a for a, _, _ in terms]
    pairs: dict[tuple[int, int], int] = {}
    for kind, a, b in spans:
        entity, at = term_hash(f"{KINDS[kind]} {text[a:b]}"), int(np.searchsorted(starts, a))
        around = [t for _, _, t in terms[max(at - CONTEXT, 0):at + CONTEXT]]
        setting = term_hash(" ".join(around))
        for t in around:
            pairs.setdefault((entity, term_hash(t)), setting)
    return sorted((*k, v) for k, v in pairs.items())


_PAIR = pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("setting", pa.int64())])


def _entity_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [_contexts(t or "") for t in batch.column(1).to_pylist()]
        hit = [i for i, p in enumerate(found) if p]
        pairs = [[{"entity": e, "term": t, "setting": x} for e, t, x in found[i]] for i in hit]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64())), pa.array(pairs, pa.list_(_PAIR))],
                                         names=["kt", "pairs"])


def disclosing_terms(docs: DataFrame, text: str = "text", max_bits: float = MAX_BITS, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(term): hashes of the terms that disclose some entity."""
    rows = docs.select(F.xxhash64(text).alias("kt"), F.col(text).cast("string").alias("text"))
    near = rows.mapInArrow(_entity_pairs, "kt bigint, pairs array<struct<entity:bigint,term:bigint,setting:bigint>>")
    per_text = near.select("kt", F.inline("pairs")).groupBy("entity", "term", "kt").agg(
        F.count("*").alias("n"), F.min("setting").alias("setting"))
    pairs = per_text.groupBy("entity", "term").agg(
        F.sum("n").alias("both"), (F.count("*") >= min_texts).alias("usual"),
        ((F.count("*") >= DECISIVE_TEXTS) & (F.min("setting") != F.max("setting"))).alias("varied")).filter("usual OR varied")
    words = F.array_distinct(F.split(F.lower(F.col("text")), _TERM_SEP))
    counts = (rows.select(F.explode(words).alias("w")).select(F.xxhash64("w").alias("term"))
              .groupBy("term").agg(F.count("*").alias("n")))
    met = pairs.join(counts, "term")
    bits = -F.log2(F.least(F.col("both") / F.col("n"), F.lit(1.0)))
    enough = F.col("usual") | (F.col("varied") & (F.col("both") >= F.col("n")))
    return met.filter((bits <= max_bits) & enough).select("term").distinct()


def _bitmap(terms: DataFrame, bits: int) -> bytes:
    cells = terms.select(F.col("term").bitwiseAND(F.lit(bits - 1)).alias("cell")).distinct()
    parts = cells.groupBy(F.shiftright("cell", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell").bitwiseAND(F.lit((1 << 15) - 1)) + 1)).alias("map")).collect()
    out = bytearray(bits // 8)
    for r in parts:  # at most bits / 2**15 rows of 4 KB
        out[r["part"] * 4096:r["part"] * 4096 + 4096] = r["map"]
    return bytes(out)


_SPAN = pa.struct([("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64())])
_HIT = pa.struct([("term", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def _term_lookup(bitmap: bytes, bits: int):
    """word -> its hash if the bitmap may hold it, else None; answers for usual
    words are remembered, at most ``REMEMBERED`` at a time."""
    known: dict[str, int | None] = {}

    def lookup(word: str) -> int | None:
        if word in known:
            return known[word]
        h = term_hash(word)
        found = h if bitmap[(h & bits - 1) >> 3] >> (h & 7) & 1 else None
        if len(word) <= USUAL_LENGTH:
            if len(known) >= REMEMBERED:
                known.clear()
            known[word] = found
        return found
    return lookup


def _span_scan(bitmap: bytes, bits: int):
    empty = not any(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _term_lookup(bitmap, bits)
        for batch in slices(batches):
            spans, hits = [], []
            for t in batch.column(2).to_pylist():
                base = base_spans(t or "")
                spans.append([{"kind": k, "s": a, "e": b} for k, a, b in base])
                # each distinct word is looked up once; places are sought only where one may be in the set
                found = {} if empty else {w: h for w in set(_TERM.findall(t or "")) if (h := lookup(w)) is not None}
                hits.append([{"term": found[w], "s": a, "e": b} for a, b, w in _free_terms(t, base) if w in found]
                            if found else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN)),
                                              pa.array(hits, pa.list_(_HIT))], names=["id", "kt", "base", "hits"])
    return run


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: float = MAX_BITS,
                  min_texts: int = MIN_TEXTS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Per row: ``key``, k0 and kt (its identity), ``base`` (kind, s, e) and
    ``spans``: base spans and disclosing terms (kind 4), by kind, then start."""
    terms = cut(disclosing_terms(docs, text, max_bits, min_texts))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("kt"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scanned = cut(rows.mapInArrow(_span_scan(_bitmap(terms, filter_bits), filter_bits),
                                  f"id {kind}, kt bigint, base array<struct<kind:int,s:bigint,e:bigint>>, "
                                  "hits array<struct<term:bigint,s:bigint,e:bigint>>"))
    scanned = scanned.withColumn("k0", null_key(F.col("id")))
    more = (scanned.filter(F.size("hits") > 0).select("k0", "kt", F.inline("hits")).join(terms, "term")
            .groupBy("k0", "kt").agg(F.sort_array(F.collect_set(F.struct(F.lit(4).alias("kind"), "s", "e"))).alias("more")))
    out = scanned.join(more, ["k0", "kt"], "left")
    return out.select(F.col("id").alias(key), "k0", "kt", "base",
                      F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,s:bigint,e:bigint>>"))).alias("spans"))


def span_text(spans: str, names: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kinds, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with base spans generalised to "[KIND]" and disclosing terms removed."""
    found = personal_data(docs, key, text).filter(F.size("spans") > 0).select(
        F.col("k0").alias("found_k0"), F.col("kt").alias("found_kt"), "spans").dropDuplicates(["found_k0", "found_kt"])
    rows = docs.select(F.struct(*docs.columns).alias("rec"), F.col(text).alias("t"), null_key(F.col(key)).alias("k0"),
                       F.xxhash64(text).alias("kt"))
    rows = rows.join(found, (F.col("k0") == F.col("found_k0")) & (F.col("kt") == F.col("found_kt")), "left")

    @F.pandas_udf("string")
    def cleaned(t, spans):
        import pandas as pd
        return pd.Series([a if a is None or s is None else replace_spans(a, [(x["kind"], x["s"], x["e"]) for x in s])
                          for a, s in zip(t, spans)])

    rows = rows.withColumn("t", F.when(F.col("spans").isNotNull(), cleaned("t", "spans")).otherwise(F.col("t")))
    return rows.select(*[F.col("t").alias(c) if c == text else F.col("rec")[c].alias(c) for c in docs.columns])


def replace_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans are replaced as one, by the kind that starts first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], "" if kind == 4 else f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
