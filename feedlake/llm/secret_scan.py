"""Secret scans by dictionary-primed zstandard novelty.

Base matches are found by pattern (fixed values of the query's contract). The
method adds ``novel`` spans: strings of at least ``MIN_LENGTH`` characters in
sensitive context that stay incompressible. The context is a sensitive word
that ends at most ``NEAR`` characters before, the PEM block of a private key,
or a reported string with only a line break between (a key of many
lines). The short last line of a PEM block is reported with its block. A
candidate's novelty is its marginal compressed size,

    (bytes(context + candidate) - bytes(context)) / length,

under a compressor primed with the corpus' identifiers: words and names that
the dictionary or the surrounding code explain cost a fraction of a byte per
character, random keys most of one. The candidate's own repeats are blanked in
the context: a key that stands there twice does not explain itself.

The identifier dictionary is counted over all documents (pre-aggregated, top
``DICTIONARY_SIZE`` by count, then name) and is the only thing broadcast; its
bytes are bounded by ``DICTIONARY_BYTES``. A text's candidates in sensitive
context are not counted wherever they stand in it, so copies of a text, however
many, do not explain its keys. Everything else is a map over whole texts.

Defined cases: NULL text is empty; ties in the dictionary are broken by name;
repeated rows get equal results; texts of any length are scanned whole; extra columns
are ignored, whatever their names; an empty table has an empty dictionary and gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import cut, slices

KINDS = ("assign", "access", "hex", "novel")
DICTIONARY_SIZE = 8192
DICTIONARY_BYTES = 1 << 17
IDENTIFIER_MAX = 40
IDENTIFIER_MIN_COUNT = 5
#: A dictionary name is at least this share of all counted names: there are at
#: most 2**16 of those in a corpus of any size, so few rows are ever ranked.
IDENTIFIER_SHARE = 2.0 ** -16
MIN_LENGTH = 16
AROUND = 256
NEAR = 48
MIN_NOVELTY = 0.5
# patterns fixed by the contract; the look-behind only skips starts inside a run
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# words that make their surroundings sensitive
_SENSITIVE = re.compile(r"passw|pwd|secret|token|api.?key|private.?key|access.?key|credential|bearer|authorization|"
                        r"client.?id|session|signature", re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
# of a run NAME=VALUE the parts count; "=" is padding at the end only
_PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=+\Z)?")
_UNPADDED = re.compile(r"[A-Za-z0-9+/_-]+")
_DIGIT = re.compile(r"[0-9]")
# the body of a private key block that has an end; the short last line of one
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----((?:(?!-----)[\s\S])*)(?=-----END )", re.A)
_TAIL = re.compile(r"(?:\r?\n|\\r|\\n)+[ \t]*([A-Za-z0-9+/=]{1,%d})(?=[ \t]*(?:\r?\n|\\r|\\n)+[ \t]*-----END )" % (MIN_LENGTH - 1))
_BREAK = re.compile(r"[ \t]*(?:\r?\n|\\r|\\(?=n))[ \t]*")
_IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Novelty:
    """Compressor primed with a dictionary of identifiers."""

    def __init__(self, identifiers: list[str]) -> None:
        # the end of a raw dictionary is the cheapest to refer to: frequent names come last
        raw = " ".join(reversed(identifiers)).encode()[-DICTIONARY_BYTES:]
        primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
        self._zstd = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False,
                                              write_dict_id=False)

    def __call__(self, before: str, candidate: str, after: str) -> float:
        context = (before + "\n" + after + "\n").encode()
        more = len(self._zstd.compress(context + candidate.encode())) - len(self._zstd.compress(context))
        return more / len(candidate)


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of ``MIN_LENGTH`` characters or more. Of NAME=VALUE each long part is
    one, but not a name without digits; a run without a long part is one as it is."""
    for m in _CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        parts = [(at + p.start(), at + p.end()) for p in _PART.finditer(run) if p.end() - p.start() >= MIN_LENGTH
                 and (p.end() == len(run) or _DIGIT.search(p[0]))] if "=" in run else []
        yield from parts or [m.span()]


def _in_context(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, follows) of the candidates near a sensitive word that comes
    before them, in a private key block, or, ``follows``, on the line after another."""
    marks, i = [m.span() for m in _SENSITIVE.finditer(text)], 0
    if not marks:
        return
    blocks, k, last = [m.span(1) for m in _BLOCK.finditer(text)], 0, -1
    for a, b in _candidates(text):
        while i < len(marks) and marks[i][1] < a - NEAR:
            i += 1
        while k < len(blocks) and blocks[k][1] <= a:
            k += 1
        near = i < len(marks) and marks[i][0] < a or k < len(blocks) and blocks[k][0] <= a
        if near or last >= 0 and _BREAK.fullmatch(text, last, a):
            yield a, b, not near
            last = b


def _surroundings(text: str, a: int, b: int) -> tuple[str, str, str]:
    """(before, candidate, after) with repeats of the candidate blanked, also those that the context cuts."""
    candidate = text[a:b]
    own = candidate.rstrip("=") or candidate
    more, blank = AROUND + len(own), "\n" * len(own)
    before, after = (x.replace(own, blank) for x in (text[max(a - more, 0):a], text[b:b + more]))
    return before[-AROUND:], candidate, after[:AROUND]


def _without_candidates(text: str) -> str:
    """``text`` without its candidates in sensitive context, there and wherever they are repeated."""
    found, out, at = set(), [], 0
    for a, b, _ in _in_context(text):
        found.add(text[a:b].rstrip("="))
        out += [text[at:a], " "]
        at = b
    if not found:
        return text
    return _UNPADDED.sub(lambda m: " " if m[0] in found else m[0], "".join([*out, text[at:]]))


def _plain_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [_without_candidates(t or "") for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings in sensitive context that touch no base span."""
    out, j, last = [], 0, -1
    taken = sorted((a, b) for a, _, b in base)
    for a, b, follows in _in_context(text):
        if follows and not (last >= 0 and _BREAK.fullmatch(text, last, a)):
            continue
        while j < len(taken) and taken[j][1] <= a:
            j += 1
        if any(s < b and e > a for s, e in taken[j:j + len(KINDS)]):
            continue
        if novelty(*_surroundings(text, a, b)) >= MIN_NOVELTY:
            out.append((a, 3, b))
            last = b
            tail = _TAIL.match(text, b)
            if tail:
                out.append((tail.start(1), 3, tail.end(1)))
    return out


def identifier_dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY_SIZE) -> list[str]:
    """The most frequent identifiers of the corpus, at most ``size``. Names of a
    key's length with a digit stay out: a key that copies repeat explains nothing.
    For the same reason a text's candidates near sensitive words are not counted."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    names = texts.mapInArrow(_plain_texts, "text string").select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(_IDENTIFIER), F.lit(0))).alias("name"))
    plain = (F.length("name") < MIN_LENGTH) | (~F.col("name").rlike("[0-9]") & (F.length("name") <= IDENTIFIER_MAX))
    counts = cut(names.filter(plain).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= IDENTIFIER_MIN_COUNT))
    total = counts.agg(F.sum("n")).first()[0] or 0
    counts = counts.filter(F.col("n") >= total * IDENTIFIER_SHARE)
    return [r["name"] for r in counts.orderBy(F.desc("n"), "name").limit(size).collect()]


_SPAN = pa.struct([("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64())])


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", dictionary_size: int = DICTIONARY_SIZE) -> DataFrame:
    """Per row: ``key`` and ``spans`` (kind, s, e), by start, then kind."""
    identifiers = identifier_dictionary(docs, text, dictionary_size)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in slices(batches):
            spans = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                spans.append([{"kind": k, "s": a, "e": b} for a, k, b in sorted(base + novel_spans(t or "", base, novelty))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["id", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:int,s:bigint,e:bigint>>").select(
        F.col("id").alias(key), "spans")
