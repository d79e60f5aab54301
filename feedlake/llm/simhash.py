"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: 64 majority bits over the XXH64 hashes of a text's word
shingles. Texts with equal fingerprints are one node from the start, so copies
cost nothing later.

Candidates: the 64 bits are cut into radius + 4 blocks. Two fingerprints
within the radius differ in at most ``radius`` blocks, so they agree on some
choice of the other 4; each distinct fingerprint goes once into the bucket of
every such choice (15 for radius 2). In a bucket 42 or 43 bits are equal, so it
holds at most 2**22 fingerprints however large the corpus is.

Comparison: a bucket's fingerprints are stored vertically, one integer per bit
plane. For a query the planes are XORed with its bits and added into
carry-save counters, so one operation updates the distances of a whole block;
a block is abandoned as soon as all its distances exceed the radius. Buckets
too large for one block are first cut by the same pigeonhole on the bits that
still vary, which is exact. Of a bucket only a spanning forest is emitted, at
most one link per fingerprint, never its pairs.

Components: alternating large-star and small-star steps over the links, each
cut by a checkpoint, until the stars are stable; labels are aggregated by
minimum. Nothing is collected to the driver but two numbers per step.

Defined cases: NULL and empty texts have fingerprint 0 and are linked like any
other; texts shorter than a shingle are one shingle; NULL ids join components
and are never their smallest id; repeated rows are copies, and of rows equal in id and
text ``near_dedup`` keeps any one, whatever their other columns hold; texts of any length
are hashed whole. Columns of the input may have any name; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import cut, cut_texts, null_key, slices

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints that one block of bit planes holds.
BLOCK = 4096
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CHUNK = 1 << 16


def text_fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = _WORD.findall((text or b"").lower())  # bytes.lower() touches A-Z alone
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-shingle] + 1])
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i:i + _CHUNK], np.dtype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, kt, fp) per row."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("kt"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([text_fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             names=["id", "kt", "fp"])
    return rows.mapInArrow(run, f"id {kind}, kt bigint, fp bigint")


class _Forest:
    """Components of a bucket as bit masks; ``links`` is its spanning forest."""

    def __init__(self, n: int) -> None:
        self.root, self.mask, self.links = list(range(n)), [1 << i for i in range(n)], []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[b] = a
            self.mask[a] |= self.mask[b]
            self.mask[b] = 0
            self.links.append((i, j))


def near_in_block(planes: dict[int, int], full: int, query: int, radius: int) -> int:
    """The members of a block (as a mask) within ``radius`` of ``query``."""
    width = (radius + 1).bit_length()
    counter, over = [0] * width, 0
    for bit, plane in planes.items():
        carry = plane ^ full if query >> bit & 1 else plane
        for j in range(width):  # carry-save: all distances of the block at once
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        over |= carry
        above, equal = over, full
        for j in reversed(range(width)):
            if radius >> j & 1:
                equal &= counter[j]
            else:
                above |= equal & counter[j]
                equal &= ~counter[j]
        if above == full:
            return 0
        gone = above
    return full & ~gone if planes else full


def bucket_links(fps: list[int], radius: int = RADIUS, block: int = BLOCK) -> list[tuple[int, int]]:
    """A spanning forest of the links (distance at most ``radius``) among distinct fingerprints."""
    first, vary = fps[0], 0
    for f in fps:
        vary |= f ^ first
    bits = [b for b in range(64) if vary >> b & 1]
    if len(fps) > block and len(bits) > radius + 12:
        links: set[tuple[int, int]] = set()
        for part in (bits[i::radius + 1] for i in range(radius + 1)):  # some part is equal in any two near ones
            mask, cells = sum(1 << b for b in part), {}
            for f in fps:
                cells.setdefault(f & mask, []).append(f)
            for cell in cells.values():
                if len(cell) > 1:
                    links.update(bucket_links(cell, radius, block))
        return sorted(links)
    forest = _Forest(len(fps))
    for lo in range(0, len(fps), block):
        members = fps[lo:lo + block]
        full = (1 << len(members)) - 1
        planes = {b: int.from_bytes(np.packbits([f >> b & 1 for f in members], bitorder="little").tobytes(), "little")
                  if len(members) > 64 else sum((f >> b & 1) << i for i, f in enumerate(members)) for b in bits}
        for i in range(lo, len(fps)):
            near = near_in_block(planes, full, fps[i], radius) & ~(forest.mask[forest.find(i)] >> lo)
            while near:
                j = (near & -near).bit_length() - 1 + lo
                forest.join(i, j)
                near &= ~(forest.mask[forest.find(i)] >> lo)
    return [(fps[a], fps[b]) for a, b in forest.links]


def _block_masks(radius: int) -> list[int]:
    """For every choice of blocks to agree on, the mask of their bits."""
    cuts = np.linspace(0, 64, radius + 5).round().astype(int).tolist()
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, 4)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a > b: links between distinct fingerprints ``fp`` that keep every component whole."""
    buckets = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for t, m in enumerate(_block_masks(radius))])).alias("k")).select("k.t", "k.bits", "fp")
    placed = buckets.repartition("t", "bits").sortWithinPartitions("t", "bits", "fp")

    def linked(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        fps = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        sizes = np.diff(cuts)
        out = [x for i in np.flatnonzero(sizes > 1) for pair in bucket_links(fps[cuts[i]:cuts[i + 1]].tolist(), radius)
               for x in pair]
        both = np.array(out, np.uint64).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both.max(axis=1)), pa.array(both.min(axis=1))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)  # the last bucket so far, which the next batch may continue
        for batch in batches:
            rows = np.concatenate([held, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])])
            if len(rows):
                new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
                cuts = np.concatenate([[0], new])
                yield linked(rows, cuts)
                held = rows[cuts[-1]:]
        if len(held):
            yield linked(held, np.array([0, len(held)]))

    return placed.mapInArrow(run, "a bigint, b bigint").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node of its component."""
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.select("a", "b"))
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = cut(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """Per row: ``key``, kt (text hash), fp, root (a fingerprint that names the
    component) and ``component_id``, the smallest key in the component."""
    rows = cut_texts(fingerprints(docs, key, text, shingle))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = stars(links(nodes.select("fp"), radius))
    labels = nodes.join(rooted, nodes["fp"] == rooted["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labels.select("fp", "root").join(ids, "root")
    return rows.join(named, "fp").select(F.col("id").alias(key), "kt", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
               radius: int = RADIUS) -> DataFrame:
    """One document of each component stays: that with the smallest key (NULL
    last), then text hash; one of rows equal in both. Columns as in ``docs``."""
    found = near_duplicates(docs, key, text, shingle, radius)
    order = F.struct(F.col(key).isNull(), F.col(key).alias("k"), "kt")
    best = found.groupBy("root").agg(F.min(order).alias("x")).select(
        null_key(F.col("x.k")).alias("best_k0"), F.col("x.kt").alias("best_kt"))
    packed = docs.select(null_key(F.col(key)).alias("k0"), F.xxhash64(text).alias("kt"),
                         F.struct(*docs.columns).alias("rec"))
    kept = packed.join(best, (F.col("k0") == F.col("best_k0")) & (F.col("kt") == F.col("best_kt")), "left_semi")
    return kept.dropDuplicates(["k0", "kt"]).select("rec.*")
