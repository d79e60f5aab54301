"""Mixing sources to target weights.

1. Words are counted per source; weights become targets in words, capped at
   ``max_passes`` times the source, the excess shared anew by weight.
2. Packing: a source's documents are laid end to end in a pseudorandom order
   and cut into blocks of ``BLOCK_WORDS`` words (the last one is shorter). A
   document's place comes from sums over ``LAYOUT_BUCKETS`` hash buckets per
   source, so a source with a third of all rows is laid out by many tasks.
3. Each output shard of ``SHARD_SLOTS`` slots has multinomial counts of slots
   per source, drawn by halving the range of shards from what the sources'
   targets hold there, so the totals meet the targets exactly. Tasks draw for
   their own shards. The last slot of a source takes part of its block.
4. Slot j of a source is block perm(j) of pass j // blocks, where perm is a
   keyed permutation of the block numbers (a Feistel network with cycle
   walking), another one in every pass. Slots and blocks are joined by
   (source, block).

A source is visited in whole passes and one part of a pass, so no document is
taken more than ``max_passes`` times. Everything follows from the seed.

Only per-source totals are on the driver: sources are a configured list, at
most ``MAX_SOURCES`` (checked). Any number of shards.

Defined cases: NULL text has no words and nothing is taken of it; NULL source
is a source of its own, last in the order; rows equal in id, text and source
are interchangeable, repeated rows count each; without any words, or of an empty
table, all targets are 0 and there are no shards. A long text spans many
blocks, its text is cut by one task. Columns of the input may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedlake.llm.common import WORD_RUN, cut, null_key, slices, without

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
TASK_SHARDS = 64
MAX_SOURCES = 100_000
MAX_PASSES = 3
LAYOUT_BUCKETS = 1024
SEED = 20_11
_ROUNDS = 4


def source_targets(sizes: list[int], weights: list[float], max_passes: int = MAX_PASSES) -> list[float]:
    """Words to take of each source: all words shared by weight, none above
    ``max_passes`` times its source; the excess goes to the others by weight."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if weights[i] * share > max_passes * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * share
            break
        for i in full:
            out[i] = float(max_passes * sizes[i])
            left -= out[i]
            open_.discard(i)
        left = max(left, 0.0)
    return out


def _round_keys(key: np.ndarray) -> list[np.ndarray]:
    return [_scramble(key + np.uint64(r + 1)) for r in range(_ROUNDS)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """perm(index) of 0..n-1 under ``key``, elementwise; or its inverse."""
    index, n, key = (np.asarray(a).astype(np.uint64) for a in (index, n, key))
    half = np.ones(len(n), np.uint64)
    while (small := (np.uint64(1) << (half + half)) < n).any():
        half[small] += np.uint64(1)
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key)

    def once(x, at):
        a, b = x >> half[at], x & low[at]
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ (_scramble(a ^ k[at]) & low[at]), a
            else:
                a, b = b, a ^ (_scramble(b ^ k[at]) & low[at])
        return (a << half[at]) | b

    out, at = index.copy(), np.arange(len(index))
    while len(at):  # cycle walking: the network permutes a power of 4, at most 4 n
        out[at] = once(out[at], at)
        at = at[out[at] >= n[at]]
    return out.astype(np.int64)


def _pass_key(source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    return _scramble(_scramble(np.asarray(source).astype(np.uint64) + np.uint64(seed)) + np.asarray(epoch).astype(np.uint64))


def source_slots(source: int, size: int, target: float, block: int = BLOCK_WORDS, max_passes: int = MAX_PASSES,
                 seed: int = SEED) -> tuple[int, int]:
    """(slots, words of the last slot) that take the source's target, to a word."""
    want = min(round(target), max_passes * size)
    if want <= 0:
        return 0, 0
    blocks, tail = -(-size // block), size - (size - 1) // block * block
    passes, rest = divmod(want, size)
    if not rest:
        return passes * blocks, block
    tail_at = int(permute(np.array([blocks - 1]), np.array([blocks]),
                          _pass_key(np.array([source]), np.array([passes]), seed), inverse=True)[0])

    def words(slots: int) -> int:
        return slots * block - (block - tail if tail_at < slots else 0)
    slots = -(-rest // block)
    while words(slots) < rest:
        slots += 1
    return passes * blocks + slots, rest - words(slots - 1)


def _draw(left: np.ndarray, need: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of ``need`` slots, with the probabilities of what is left of each source."""
    counts = np.zeros_like(left)
    while need:  # a draw above what a source has left is drawn again among the others
        free = left - counts
        drawn = np.minimum(rng.multinomial(need, free / free.sum()), free)
        counts += drawn
        need -= int(drawn.sum())
    return counts


def shard_count(slots: list[int]) -> int:
    return -(-sum(slots) // SHARD_SLOTS)


def shard_draws(slots: list[int], seed: int = SEED, first: int = 0, last: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots) of the shards [first, last), in order.

    A range of shards is halved until one is left; the left half draws its
    multinomial counts from what the range holds of each source, the right half
    gets the rest. A node's draw follows from the seed and its range alone, so
    any task finds the counts of its shards without the others'.
    """
    whole, shards = np.array(slots, np.int64), shard_count(slots)
    last = shards if last is None else last
    held = np.flatnonzero(whole)
    nodes = [(0, shards, held, whole[held], np.zeros(len(held), np.int64))]
    while nodes:
        lo, hi, source, left, before = nodes.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield from ((lo, int(i), int(b), int(n)) for i, b, n in zip(source, before, left))
            continue
        mid = (lo + hi) // 2
        counts = _draw(left, (mid - lo) * SHARD_SLOTS, np.random.Generator(np.random.PCG64([seed, lo, hi])))
        rest = left - counts
        nodes.append((mid, hi, source[rest > 0], rest[rest > 0], (before + counts)[rest > 0]))
        nodes.append((lo, mid, source[counts > 0], counts[counts > 0], before[counts > 0]))


def _slots(spark, plan: list[int], seed: int) -> DataFrame:
    """(shard, src, slot), drawn by tasks that hold about ``TASK_SHARDS`` shards each."""
    shards = shard_count(plan)
    held = spark.sparkContext.broadcast(plan)  # one number per source

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if not ids:
                continue
            for shard, rows in groupby(shard_draws(held.value, seed, ids[0], ids[-1] + 1), key=lambda r: r[0]):
                _, src, first, n = zip(*rows)
                slot = np.concatenate([np.arange(f, f + c) for f, c in zip(first, n)])
                yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(slot), shard, np.int64)),
                                                  "src": pa.array(np.repeat(np.array(src, np.int32), n)), "slot": pa.array(slot)})

    # range() hands each task a run of consecutive shards, in order
    return spark.range(0, shards, 1, max(1, -(-shards // TASK_SHARDS))).mapInArrow(draw, "shard long, src int, slot long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def _sources(rows: DataFrame) -> list:
    """(source, size) by code point, NULL last."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mixing is over a configured list of sources")
    return sorted(((r["source"], r["size"]) for r in totals), key=lambda r: (r[0] is None, r[0] or ""))


def _layout(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``start``, the place of a document's first word in its source."""
    mixed = F.xxhash64(F.lit(seed), "k0", "kt")
    placed = rows.withColumn("order", mixed).withColumn("bucket", F.pmod("order", F.lit(LAYOUT_BUCKETS)))
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("src", "bucket").agg(F.sum("size").alias("n")).select(
        "src", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("src", "bucket").orderBy("order", "k0", "kt", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    return (placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(firsts, ["src", "bucket"]).withColumn("start", F.col("first") + F.col("within"))
            .drop("first", "within", "order", "bucket"))


def mix(docs: DataFrame, weights, key: str = "doc_id", text: str = "text", source: str = "source",
        seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``weights``: source values in order -> their weights. Returns the
    documents (id, k0, kt, s0, src, source_size, target, size, start) and the mix:
    per taken piece of a document src, start, shard, slot, epoch and the words
    [lo, hi) of the document."""
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(key).alias("id"), null_key(F.col(key)).alias("k0"), F.xxhash64(text).alias("kt"),
                           F.col(source).cast("string").alias("source"), null_key(F.col(source)).alias("s0"),
                           word_count(F.col(text)).alias("size")))
    found = _sources(rows)
    sizes = [n for _, n in found]
    targets = source_targets(sizes, weights([s for s, _ in found]))
    plan = [source_slots(i, n, t, seed=seed) for i, (n, t) in enumerate(zip(sizes, targets))]
    facts = spark.createDataFrame(
        [(i, s, n, t, max(-(-n // BLOCK_WORDS), 1), *p) for i, ((s, n), t, p) in enumerate(zip(found, targets, plan))],
        "src int, src_name string, source_size long, target double, blocks long, slots long, last long")
    # at most MAX_SOURCES rows are broadcast
    named = rows.join(F.broadcast(facts.select("src", "src_name", "source_size", "target")),
                      F.col("source").eqNullSafe(F.col("src_name"))).drop("src_name", "source")
    laid = cut(_layout(named, seed))

    slots = _slots(spark, [p[0] for p in plan], seed)

    @F.pandas_udf("long")
    def block_of(src: pd.Series, slot: pd.Series, blocks: pd.Series) -> pd.Series:
        n = blocks.to_numpy(np.int64)
        epoch, index = np.divmod(slot.to_numpy(np.int64), n)
        return pd.Series(permute(index, n, _pass_key(src.to_numpy(np.int64), epoch, seed)))

    slots = slots.join(F.broadcast(facts.select("src", "blocks", "slots", "last")), "src").select(
        "src", "shard", "slot", F.floor(F.col("slot") / F.col("blocks")).alias("epoch"),
        block_of("src", "slot", "blocks").alias("block"),
        F.when(F.col("slot") == F.col("slots") - 1, F.col("last")).otherwise(BLOCK_WORDS).alias("take"))

    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    pieces = laid.filter("size > 0").select("src", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * BLOCK_WORDS - F.col("start"), F.lit(0))
    hi = F.least(F.col("block") * BLOCK_WORDS + F.col("take") - F.col("start"), F.col("size"))
    taken = pieces.join(slots, ["src", "block"]).select("src", "start", "shard", "slot", "epoch", lo.alias("lo"), hi.alias("hi"))
    return laid, taken.filter("hi > lo")


def mix_counts(docs: DataFrame, weights, key: str = "doc_id", text: str = "text", source: str = "source",
               seed: int = SEED) -> DataFrame:
    """Per document ``key``, size, source_size, target and ``taken``: its words in the mix, repeats counted."""
    laid, taken = mix(docs, weights, key, text, source, seed)
    words = taken.groupBy("src", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    full = laid.filter("size > 0").join(words, ["src", "start"], "left")
    return full.unionByName(laid.filter("size = 0"), allowMissingColumns=True).select(
        F.col("id").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


_WORD = re.compile(WORD_RUN)


def _cut_words(text: str, spans: list) -> str:
    """The text of the word spans [lo, hi), joined by newlines; a whole text stays as it is."""
    bounds = [m.span() for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if merged and merged[-1][1] == lo:
            merged[-1][1] = hi
        else:
            merged.append([lo, hi])
    if merged == [[0, len(bounds)]]:
        return text
    return "\n".join(text[bounds[lo][0]:bounds[hi - 1][1]] for lo, hi in merged)


def mixed_documents(docs: DataFrame, weights, key: str = "doc_id", text: str = "text", source: str = "source",
                    seed: int = SEED) -> DataFrame:
    """The mix as documents: one row per document and pass that takes words of
    it, its text the words taken, in order (``n_chars``, if there is one, is
    counted anew). Rows equal in id, text and source count as often as they occur."""
    laid, taken = mix(docs, weights, key, text, source, seed)
    spans = (taken.join(laid.filter("size > 0").select("src", "start", "k0", "kt", "s0"), ["src", "start"])
             .groupBy("src", "start", "k0", "kt", "s0", "epoch").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
             .select("k0", "kt", "s0", "spans"))
    columns = docs.columns
    packed = docs.select(null_key(F.col(key)).alias("k0"), F.xxhash64(text).alias("kt"), null_key(F.col(source)).alias("s0"),
                         F.col(text).alias("t"), F.struct(*without(docs, text)).alias("rec"))
    packed = packed.dropDuplicates(["k0", "kt", "s0"]).join(spans, ["k0", "kt", "s0"])

    def words_taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [_cut_words(a, s) for a, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["rec", "t"])

    packed = packed.select("rec", F.col("t").cast("string").alias("t"), "spans")
    out = packed.mapInArrow(words_taken, StructType([packed.schema["rec"], StructField("t", StringType())]))
    final = {c: F.col("t") if c.lower() == text.lower() else F.col("rec")[c] for c in columns}
    if "n_chars" in final:
        final["n_chars"] = F.length("t").cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in final.items()])


def cycling_weights(names: list) -> list[float]:
    """1, 2, 3, repeating, over the sources in order."""
    return [float(i % 3 + 1) for i in range(len(names))]
