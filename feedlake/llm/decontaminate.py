"""Benchmark decontamination by winnowing.

Of every ``GUARD`` consecutive word k-grams the one with the smallest hash is
kept as a fingerprint, in benchmark items and documents alike. A shared span
of k + GUARD - 1 = 10 words holds at least one window of k-grams in full, so
both sides keep the same k-gram of it: no shared span of 10 words is missed.
Each fingerprint is extended by its neighbouring words, on both sides, to the
10-word windows that hold it, and training and test fingerprints are joined on
these windows: spans that meet are hits. A fingerprint that many items and many
documents share, such as the opening of a template, so never meets in pairs that
differ one word further on. Items of fewer than 10 words are one window and are
looked up whole, by their length.

Documents are read once, in Arrow batches: word bounds, hashes and sliding
minima are computed by numpy over a batch. A bitmap of the benchmark's hashes,
of a fixed number of bits, drops most fingerprints before the shuffle; its
false positives die in the exact join, so a crowded bitmap costs time and
loses nothing. The candidates are written once (a checkpoint) and joined by
Spark. Every distinct window is joined once; documents meet items after the match, once
per class of windows that the same items hold.

Defined cases: NULL and empty texts have no words; items without words match
nothing; repeated rows get equal results, and so do items of equal text; ties of the
smallest hash are all kept; a NULL item_id reads "null"; texts of any length are read
whole, a batch of at most ``TEXT_ROWS`` or ``TEXT_BYTES`` at a time; an empty benchmark contaminates
nothing and an empty table gives no row. Columns of the input may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import cut_texts, null_key, slices
from feedlake.llm.tokens import STEP, Powers, Words, mix

WINDOW = 10
K = 6
GUARD = WINDOW - K + 1
SIDE = WINDOW - K
FILTER_BITS = 1 << 24


class _Windows(Words):
    """Word windows of a batch of texts."""

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the k-grams from each word on; 0 where a text ends first."""
        n = max(len(self.hash) - k + 1, 0)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * STEP + self.hash[j:j + n]
        total = mix(total + np.uint64(k)) | np.uint64(1)
        total[self.text[:n] != self.text[k - 1:k - 1 + n]] = 0
        return total

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and hashes of the k-grams that winnowing keeps (ties: all)."""
        h = self.grams(K)
        windows = len(h) - GUARD + 1
        if windows <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = np.minimum.reduce([h[j:j + windows] for j in range(GUARD)])  # 0: not in one text
        top = np.zeros(len(h), np.uint64)
        for j in range(GUARD):
            np.maximum(top[j:j + windows], least, out=top[j:j + windows])
        at = np.flatnonzero((top == h) & (h != 0))
        return at, h[at]

    def whole(self, k: int) -> np.ndarray:
        """Hashes of the k-grams as whole items: apart from those of fingerprints."""
        h = self.grams(k)
        return np.where(h == 0, h, mix(h ^ STEP) | np.uint64(1))

    def word(self, i: int) -> str:
        return self.low[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")

    def context(self, at: int, k: int, h: np.uint64, side: int) -> dict:
        """The k words at ``at`` and up to ``side`` words to each side (nearest first)."""
        text = self.text[at]
        lo, hi = self.base[text], self.base[text + 1]
        return {"pos": int(at - lo), "n": k, "h": int(h.view(np.int64)), "whole": side == 0,
                "gram": " ".join(self.word(i) for i in range(at, at + k)),
                "left": [self.word(i) for i in range(at - 1, max(at - 1 - side, lo - 1), -1)],
                "right": [self.word(i) for i in range(at + k, min(at + k + side, hi))]}


_CAND = pa.struct([("pos", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("whole", pa.bool_()),
                   ("gram", pa.string()),
                   ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
_CAND_SQL = "array<struct<pos:bigint,n:bigint,h:bigint,whole:boolean,gram:string,left:array<string>,right:array<string>>>"


def _scan(pick):
    """A mapInArrow function: (id, kt, text) to (id, kt, n_words, cands); ``pick``
    gives the (word position, length, hash, words to each side) of the candidates of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            words = _Windows(batch.column(2), powers)
            cands: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for at, k, h, side in pick(words):
                cands[words.text[at]].append(words.context(at, k, h, side))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words.counts.astype(np.int64)),
                 pa.array(cands, pa.list_(_CAND))], names=["id", "kt", "n_words", "cands"])
    return run


def _item_pick(words: _Windows):
    short = np.flatnonzero((words.counts > 0) & (words.counts < WINDOW))
    for k in np.unique(words.counts[short]).tolist():
        h = words.whole(k)
        yield from ((a, k, h[a], 0) for a in words.base[short[words.counts[short] == k]])
    long = words.counts[words.text] >= WINDOW
    yield from ((a, K, h, SIDE) for a, h in zip(*words.fingerprints()) if long[a])


def _document_pick(bitmap: bytes, bits: int, lengths: list[int]):
    table = np.frombuffer(bitmap, np.uint8)

    def known(h: np.ndarray) -> np.ndarray:
        cell = (h & np.uint64(bits - 1)).astype(np.int64)
        return (table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1

    def pick(words: _Windows):
        at, h = words.fingerprints()
        hit = known(h)
        yield from ((a, K, x, SIDE) for a, x in zip(at[hit], h[hit]))
        for k in lengths:
            h = words.whole(k)
            yield from ((a, k, h[a], 0) for a in np.flatnonzero((h != 0) & known(h)))
    return pick


def _benchmark_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, pos, n, h, whole, gram, left, right): the fingerprints of long items and the whole of short ones."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("id"), F.lit(0).cast("long").alias("kt"),
                            F.col(text).cast("string").alias("text"))
    scanned = rows.mapInArrow(_scan(_item_pick), f"id string, kt bigint, n_words bigint, cands {_CAND_SQL}")
    return scanned.select(F.col("id").alias("item"), F.inline("cands"))


def _bitmap(windows: DataFrame, bits: int) -> bytes:
    """A bitmap of ``bits`` bits, whatever the benchmark's size, with the cell of every window set."""
    # the number of cells is a power of two: the low bits are the unsigned remainder
    cells = windows.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("cell")).distinct()
    parts = cells.groupBy(F.shiftright("cell", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell").bitwiseAND(F.lit((1 << 15) - 1)) + 1)).alias("map"))
    out = bytearray(bits // 8)
    for r in parts.collect():  # at most bits / 2**15 rows of 4 KB
        out[r["part"] * 4096:r["part"] * 4096 + 4096] = r["map"]
    return bytes(out)


def _occurrences(cands: DataFrame, *keep: str) -> DataFrame:
    """One row per window of a candidate: ``keep``, win (its words) and s, e (its word positions)."""
    whole = F.struct(F.col("gram").alias("win"), F.col("pos").alias("s"), (F.col("pos") + F.col("n")).alias("e"))
    around = []
    for before in range(SIDE + 1):
        after = SIDE - before
        words = F.concat_ws(" ", F.reverse(F.slice("left", 1, before)), "gram", F.slice("right", 1, after))
        at = F.struct(words.alias("win"), (F.col("pos") - before).alias("s"), (F.col("pos") - before + WINDOW).alias("e"))
        around.append(F.when((F.size("left") >= before) & (F.size("right") >= after), at))
    wins = F.when(F.col("whole"), F.array(whole)).otherwise(F.array_compact(F.array(*around)))
    return cands.select(*keep, F.inline(wins))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Per row of ``docs``: ``key``, k0 and kt (its identity), n_words, n_hit
    (words inside an occurrence of a benchmark window), spans (of words, end
    exclusive, NULL for none), items (sorted ids with an occurring window)."""
    spark = docs.sparkSession
    windows = cut_texts(_benchmark_windows(benchmark, item, item_text))
    lengths = [r["n"] for r in windows.filter("whole").select("n").distinct().orderBy("n").collect()]  # below WINDOW
    pick = _document_pick(_bitmap(windows, filter_bits), filter_bits, lengths)

    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("kt"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scanned = cut_texts(rows.mapInArrow(_scan(pick), f"id {kind}, kt bigint, n_words bigint, cands {_CAND_SQL}"))
    scanned = scanned.withColumn("k0", null_key(F.col("id")))

    # words hold no blanks: windows of equal text are equal word by word, and of one length
    listed = _occurrences(windows, "item").select("win", "item").distinct()
    # windows of the same items (all those of a shared passage) are one class, known by 128 bits of their hashes
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), "item")).alias(f"x{salt}") for salt in (1, 2)]
    classes = listed.groupBy("win").agg(F.struct(*marks, F.count("*").alias("n")).alias("class"))
    members = classes.groupBy("class").agg(F.min("win").alias("win")).join(listed, "win").select("class", "item")
    found = _occurrences(scanned.select("k0", "kt", F.inline("cands")), "k0", "kt").join(classes, "win")
    spans = found.groupBy("k0", "kt").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"),
                                          F.collect_set("class").alias("classes"))
    items = (spans.select("k0", "kt", F.explode("classes").alias("class")).join(members, "class")
             .groupBy("k0", "kt").agg(F.sort_array(F.collect_set("item")).alias("items")))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["upto"]), F.lit(0))).alias("n"),
                              F.greatest(a["upto"], x["e"]).alias("upto")), lambda a: a["n"])
    return (scanned.select(F.col("id").alias(key), "k0", "kt", "n_words")
            .join(spans.select("k0", "kt", "spans", covered.alias("hit")), ["k0", "kt"], "left")
            .join(items, ["k0", "kt"], "left")
            .select(key, "k0", "kt", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), "spans",
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs; columns as in ``docs``."""
    hit = contamination(docs, benchmark, key, text).filter("n_hit > 0").select(F.col("k0").alias("__k0"), F.col("kt").alias("__kt"))
    same = (null_key(F.col(key)) == F.col("__k0")) & (F.xxhash64(F.col(text)) == F.col("__kt"))
    return docs.join(hit.distinct(), same, "left_anti").select(*docs.columns)
