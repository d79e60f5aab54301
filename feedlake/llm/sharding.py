"""Sharding by sampled splitters (DataFrame functions only).

The keys, sizes and content hashes are cut first: each text is read and hashed
once, and no sort or window below carries a text. ``shard_texts`` joins the texts
back by key last.

1. One pass sums the sizes. A second draws a size-weighted sample of keys:
   a row is drawn with probability size / step, from a hash of its key, so
   reruns agree; a row larger than a step is always drawn, with its own weight.
2. Quantiles of the weighted sample split the key order into many ranges per
   shard (``ranges_per_shard``, more if a range would hold over ``RANGE_ROWS`` rows).
   The splitters are the only rows that reach the driver: at most
   ``MAX_RANGES`` keys (or shards * ranges_per_shard), whatever the input.
3. Records are range-partitioned by binary search in the splitters. The exact
   bytes and rows of every range are counted, and ranges get their offset in
   the whole key order.
4. A range that is overfull, or crosses the border of a shard, is subdivided:
   a running sum within the range gives each row its byte offset, and the
   shard is the one in which the row's middle byte falls. Shard sizes are
   therefore equal up to one row, however the sample fell.

Keys are compared as structs (NULL first). Use a key that ends in an id: rows
of one hot text are then split by the id. Only rows equal in the whole key
stay in one range. The running sums are per range and hold narrow rows.

Defined cases: NULL text has size ``overhead``; ties in the key are ordered by
size and content hash, and rows equal in all of these are interchangeable; texts of
any length count whole; an empty table gives an empty result; clashing input columns are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import cut, without

#: Sampled rows per range: the bytes of a range vary by about a quarter.
SAMPLES_PER_RANGE = 16
SEED = 1729
RANGE_ROWS = 2_000_000
MAX_RANGES = 16_384


def text_size(text: Column, overhead: int = 16) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def _splitters(keyed: DataFrame, ranges: int) -> list:
    """Ascending keys k1..km, m < ranges: range i holds the keys from k_i to below k_(i+1)."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    step = max(total / (ranges * SAMPLES_PER_RANGE), 1.0)
    u = F.pmod(F.xxhash64(F.lit(SEED), "key.*"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keyed.filter(u < F.col("size") / F.lit(step)).select("key", F.greatest("size", F.lit(step)).alias("weight"))
    # the sample has at most about 2 * ranges * SAMPLES_PER_RANGE rows: one ordered pass over it
    upto = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("before", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    weight = drawn.agg(F.sum("weight")).first()[0] or 0.0
    cell = F.floor(F.col("before") * ranges / F.lit(max(weight, 1.0)))
    return [r["key"] for r in placed.groupBy(cell.alias("cell")).agg(F.min("key").alias("key"))
            .filter("cell > 0").orderBy("key").collect()]


def _range_of(key: Column, splitters: list, key_type) -> Column:
    """The number of splitters that are not above ``key``, by binary search."""
    if not splitters:
        return F.lit(0)
    bounds = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(k, key_type.fields)])
                       for k in splitters])
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    found = F.lit(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), found,
                       lambda at, s: F.when(F.get(bounds, at + s - 1) <= key, at + s).otherwise(at))


def shard_records(df: DataFrame, key: list[Column], size: Column, shards: int, content: Column | None = None,
                  ranges_per_shard: int = 16) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (row number in the
    shard, gapless from 0, in key order); shards are near equal in ``size``. The rows
    are cut and sorted as they are: give narrow ones."""
    keyed = cut(df.select(F.struct(*without(df, "shard", "slot")).alias("rec"), size.cast("long").alias("size"),
                          F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]).alias("key"),
                          (content if content is not None else F.lit(0)).alias("content")))
    ranges = max(shards * ranges_per_shard, min(MAX_RANGES, -(-keyed.count() // RANGE_ROWS)))
    splitters = _splitters(keyed.select("key", "size"), ranges)
    at = _range_of(F.col("key"), splitters, keyed.schema["key"].dataType)
    ranged = keyed.withColumn("range", at)

    # one row per range (at most shards * ranges_per_shard): offsets of the ranges
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("byte0"),
                          F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row0"),
                          F.sum("bytes").over(every).alias("total"))

    inside = Window.partitionBy("range").orderBy("key", "size", "content")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (ranged.withColumn("upto", F.sum("size").over(upto)).withColumn("nth", F.row_number().over(inside))
            .join(F.broadcast(offsets), "range"))
    middle = (F.col("byte0") + F.col("upto")) - F.col("size") / 2
    rows = rows.withColumn("shard", F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int"))
    rows = rows.withColumn("row", F.col("row0") + F.col("nth") - 1)
    # every shard is a run of rows in key order: its first row is where the counts of the shards before it end
    counts = ranged_counts(rows.select("shard"))
    out = rows.join(F.broadcast(counts), "shard")
    return out.select("rec.*", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def ranged_counts(rows: DataFrame) -> DataFrame:
    """(shard, first): the number of rows in the shards before (one row per shard)."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.groupBy("shard").agg(F.count("*").alias("n"))
            .select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")))


def shard_texts(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Shard rows of texts: key order is (text hash, id), so equal texts are
    neighbours and share a shard unless their group is cut by a border."""
    rows = df.select(F.struct(*without(df, "shard", "slot")).alias("rec"), F.xxhash64(text).alias("h"), F.col(key).alias("id"),
                     F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("c"),
                     text_size(F.col(text), overhead).alias("size"))
    placed = shard_records(rows.select("h", "id", "c", "size"), [F.col("h"), F.col("id")], F.col("size"), shards, F.col("c"))
    # rows equal in id and text are told apart by their number, in the order of what else they hold
    same = Window.partitionBy("h", "id", "c")
    hashable = [F.col("rec")[f.name] for f in rows.schema["rec"].dataType.fields if "map<" not in f.dataType.simpleString()]
    texts = rows.withColumn("nth", F.row_number().over(same.orderBy(F.xxhash64(*hashable)))).alias("x")
    placed = placed.withColumn("nth", F.row_number().over(same.orderBy("shard", "slot"))).alias("y")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("h", "id", "c", "nth")]
    return texts.join(placed, on).select("x.rec.*", "y.shard", "y.slot")
