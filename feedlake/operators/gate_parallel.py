"""Exact minimum-interval gate for very large keys, without one task per key.

The gate admits an execution iff it is forced or at least ``I`` after the
last admitted one. Seen as a linked list, every execution ``i`` has one
successor ``nxt(i)``: the first later execution that is forced or lies at
least ``I`` after it. The admitted executions of a key are exactly the chain
``head, nxt(head), nxt(nxt(head)), ...`` from its first execution.

Rows are cut into buckets by rank, not by time: a range partition of the rows in
(key, time, id) order gives buckets of about ``rows_per_bucket`` rows each, whatever
the times look like (an early outlier and a burst too).

1. ``nxt`` comes from two as-of lookups ("first execution at or after a
   point"): executions and points are ranged together, reverse running minimums
   run over windows partitioned by ``(key, range)``, plus a fall-through to the
   next range that holds an execution, over one row per range.
2. Inside each bucket pointer doubling over arrays gives every node its *exit*: the
   first node of its chain that lies in a later bucket. The pass is a
   ``mapInPandas`` stream over rows sorted by (key, bucket, time) that holds
   one bucket at a time.
3. Pointer doubling runs over bucket entry nodes only (heads and exit
   targets): ``ceil(log2(buckets on the chain))`` rounds of a self-join,
   each checkpointed to cut lineage, find the node where the chain enters
   each bucket.
4. Inside each bucket the chain is walked from its entry node, from admitted to admitted.
5. For refused executions the last admitted one before them (another as-of
   lookup) gives the minutes left.

No hot key's rows are shuffled by the key alone: shuffles are keyed by
ranges, (key, bucket) or node ids; only the per-range summaries (one row per
range) are ranked per key. Executions are ordered by (time, id); ``id`` must
be an integer, unique within a key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 100_000


def _ranges(df: DataFrame, rows: int, per_bucket: int, *order) -> DataFrame:
    """``df`` (of about ``rows`` rows) with its bucket ``b``: a task's range of rows, cut by rank into
    pieces of ``per_bucket`` rows; ascending in ``order``. The checkpoint fixes which row is in which."""
    parts = max(1, -(-rows // max(per_bucket, ROWS_PER_BUCKET)))
    placed = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("m", F.monotonically_increasing_id()))  # the task's number, then the row's within it
    within = F.col("m").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("b", F.col("m") - within + F.floor(within / per_bucket)).drop("m").checkpoint()


def first_at_or_after(events: DataFrame, probes: DataFrame, key: str, rows: int, per_bucket: int) -> DataFrame:
    """For each probe ``(key, pid, qt, qi)`` the first event ``(key, t, i, c)``
    with ``(t, i) >= (qt, qi)``; returns ``(key, pid, nt, ni, nc)`` (NULL when
    none)."""
    none = F.lit(None).cast("long")
    both = events.select(key, F.col("t").alias("st"), F.col("i").alias("si"), F.lit(0).alias("kind"), none.alias("pid"),
                         F.col("c").cast("long").alias("c")).unionByName(
        probes.select(key, F.col("qt").alias("st"), F.col("qi").alias("si"), F.lit(1).alias("kind"), "pid", none.alias("c")))
    # at an equal position the probe comes first, so the event is at or after it (inclusive)
    placed = _ranges(both, rows, per_bucket, key, "st", "si", F.col("kind").desc())
    found = F.when(F.col("kind") == 0, F.struct(F.col("st").alias("t"), F.col("si").alias("i"), "c"))
    w = (Window.partitionBy(key, "b").orderBy(F.col("st").desc(), F.col("si").desc(), F.col("kind").asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inb = placed.withColumn("hit", F.min(found).over(w)).filter("kind = 1").select(key, "pid", "b", "hit")

    # fall-through: the first event of the next range that has one of this key
    summary = placed.groupBy(key, "b").agg(F.min(found).alias("first"))
    after = Window.partitionBy(key).orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    later = summary.select(key, "b", F.min("first").over(after).alias("next"))
    best = F.coalesce("hit", "next")
    return inb.join(later, [key, "b"], "left").select(
        key, "pid", best["t"].alias("nt"), best["i"].alias("ni"), best["c"].alias("nc"))


def _bucket_stream(loop, key: str):
    """mapInPandas driver: rows arrive sorted by (key, bucket, t, i); hand
    ``loop`` only whole buckets. The pieces of the last bucket so far are held
    and joined once, so memory is bounded by one bucket and the work is linear."""
    import pandas as pd

    def run(batches):
        held = []  # pieces of one bucket, which the next batch may continue
        for pdf in batches:
            if pdf.empty:
                continue
            tail = (pdf[key] == pdf[key].iloc[-1]) & (pdf["c"] == pdf["c"].iloc[-1])
            last = held[-1].iloc[-1] if held else None
            goes_on = held and last[key] == pdf[key].iloc[0] and last["c"] == pdf["c"].iloc[0]
            if held and not (goes_on and tail.all()):
                if goes_on:  # the bucket ends inside this batch
                    held.append(pdf[~tail])
                    yield loop(pd.concat(held, ignore_index=True))
                    held = [pdf[tail]]
                    continue
                yield loop(pd.concat(held, ignore_index=True))
                held = []
            if not tail.all():
                yield loop(pdf[~tail])
            held.append(pdf[tail])
        if held:
            yield loop(pd.concat(held, ignore_index=True))
    return run


def _places(pdf) -> tuple[np.ndarray, np.ndarray]:
    """(row of each row's successor in the same bucket, or -1; whether it has one elsewhere).
    ``pdf`` holds whole buckets, each in (t, i) order."""
    n = len(pdf)
    here = pdf["has_nxt"].to_numpy(bool) & (pdf["nc"].to_numpy() == pdf["c"].to_numpy())
    ids, nxt = pdf["i"].to_numpy(), pdf["ni"].to_numpy()
    order = np.argsort(ids, kind="stable")
    place = np.full(n, -1)
    if n:
        at = np.minimum(np.searchsorted(ids[order], nxt), n - 1)
        place = np.where(here & (ids[order][at] == nxt), order[at], -1)
    return place, pdf["has_nxt"].to_numpy(bool) & ~here


def _exits_loop(key: str):
    """exit(i) = nxt(i) when nxt leaves the bucket, none at the chain's end, else
    exit(nxt(i)): the last row of the bucket on each row's chain, by pointer doubling."""
    import pandas as pd

    def loop(pdf):
        place, leaves = _places(pdf)
        last = np.where(place >= 0, place, np.arange(len(pdf)))
        while True:
            ahead = last[last]
            if (ahead == last).all():
                break
            last = ahead
        has = leaves[last]
        return pd.DataFrame({key: pdf[key].to_numpy(), "i": pdf["i"].to_numpy(), "has_exit": has,
                             "ei": np.where(has, pdf["ni"].to_numpy()[last], 0)})
    return loop


def _walk_loop(key: str):
    """The chain inside each bucket, from the node where it enters, admitted to admitted."""
    import pandas as pd

    def loop(pdf):
        place, _ = _places(pdf)
        out = np.zeros(len(pdf), bool)
        for at in np.flatnonzero(pdf["is_entry"].to_numpy(bool)):
            while at >= 0 and not out[at]:
                out[at] = True
                at = place[at]
        return pd.DataFrame({key: pdf[key].to_numpy(), "i": pdf["i"].to_numpy(), "admitted": out})
    return loop


def _by_bucket(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key, "c").sortWithinPartitions(key, "c", "t", "i")


def _least(a_t, a_i, b_t, b_i):
    """The earlier of two optional positions."""
    a_first = b_t.isNull() | (a_t.isNotNull() & ((a_t < b_t) | ((a_t == b_t) & (a_i <= b_i))))
    return F.when(a_first, a_t).otherwise(b_t), F.when(a_first, a_i).otherwise(b_i)


def gate_parallel(events: DataFrame, key: str, interval_us: int, forced: str | None,
                  rows_per_bucket: int = ROWS_PER_BUCKET, max_rounds: int = 64) -> DataFrame:
    """``events``: (key, t [epoch us], i [bigint id], forced?).
    Returns (key, i, admitted, minutes_left)."""
    from feedlake.session import checkpoint_root
    checkpoint_root(events.sparkSession)  # lineage cuts go to the shared checkpoint folder
    flag = (F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)).alias("f")
    rows = events.select(key, "t", "i", flag)
    n = rows.count()
    base = _ranges(rows, n, rows_per_bucket, key, "t", "i").withColumnRenamed("b", "c")

    # successor candidates: first execution at or after t + I, and the first
    # forced execution strictly after (t, i)  [(t, i + 1) as an inclusive bound]
    probes_a = base.select(key, F.col("i").alias("pid"), (F.col("t") + F.lit(interval_us)).alias("qt"),
                           F.lit(-(2 ** 63)).cast("long").alias("qi"))
    a = first_at_or_after(base, probes_a, key, 2 * n, rows_per_bucket).select(
        key, F.col("pid").alias("i"), F.struct(F.col("nt").alias("t"), F.col("ni").alias("i"), F.col("nc").alias("c")).alias("a"))
    nodes = base.join(a, [key, "i"])
    best = F.when(F.col("a.i").isNotNull(), F.col("a"))
    if forced:
        probes_f = base.select(key, F.col("i").alias("pid"), F.col("t").alias("qt"), (F.col("i") + 1).alias("qi"))
        z = first_at_or_after(base.filter("f"), probes_f, key, 2 * n, rows_per_bucket).select(
            key, F.col("pid").alias("i"), F.struct(F.col("nt").alias("t"), F.col("ni").alias("i"), F.col("nc").alias("c")).alias("z"))
        nodes = nodes.join(z, [key, "i"])
        best = F.least(best, F.when(F.col("z.i").isNotNull(), F.col("z")))  # NULLs are skipped
    nodes = (nodes.withColumn("n", best)
             .select(key, "c", "t", "i", F.col("n").isNotNull().alias("has_nxt"), F.coalesce("n.i", F.lit(0)).alias("ni"),
                     F.coalesce("n.c", F.lit(0)).alias("nc"))).checkpoint()
    key_type = nodes.schema[key].dataType.simpleString()

    # exits: first node of the chain from i that lies in a later bucket
    exits = (_by_bucket(nodes, key)
             .mapInPandas(_bucket_stream(_exits_loop(key), key),
                          f"`{key}` {key_type}, i long, has_exit boolean, ei long")).checkpoint()

    # doubling over entry nodes only: heads and exit targets
    heads = base.groupBy(key).agg(F.min(F.struct("t", "i")).alias("h")).select(key, F.col("h.i").alias("i"))
    targets = exits.filter("has_exit").select(key, F.col("ei").alias("i"))
    entry_nodes = heads.unionByName(targets).distinct()
    jump = (exits.join(entry_nodes, [key, "i"], "left_semi")
                 .select(key, "i", F.when(F.col("has_exit"), F.col("ei")).alias("nxt"))).checkpoint()
    path = heads.checkpoint()
    size = path.count()
    for _ in range(max_rounds):
        step = (path.join(jump, [key, "i"]).filter(F.col("nxt").isNotNull())
                    .select(key, F.col("nxt").alias("i")))
        grown = path.unionByName(step).checkpoint()
        new_size = grown.count()
        if new_size == size:  # no node added: every chain is complete
            break
        path, size = grown, new_size
        jump = (jump.alias("x").join(jump.alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}"))
                                     & (F.col("x.nxt") == F.col("y.i")), "left")
                    .select(F.col(f"x.{key}").alias(key), F.col("x.i").alias("i"),
                            F.col("y.nxt").alias("nxt"))).checkpoint()
    else:
        raise RuntimeError("gate chain longer than 2**max_rounds buckets")

    # walk the chain inside each bucket from the node where it enters
    flagged = (nodes.join(path.withColumn("is_entry", F.lit(True)), [key, "i"], "left")
                    .withColumn("is_entry", F.coalesce("is_entry", F.lit(False))))
    walked = (_by_bucket(flagged.select(key, "c", "t", "i", "has_nxt", "ni", "nc", "is_entry"), key)
              .mapInPandas(_bucket_stream(_walk_loop(key), key), f"`{key}` {key_type}, i long, admitted boolean"))
    marked = base.join(walked, [key, "i"]).checkpoint()

    # minutes left: last admitted execution strictly before each refused one,
    # as a first-at-or-after lookup on negated positions
    adm = marked.filter("admitted").select(key, (-F.col("t")).alias("t"), (-F.col("i")).alias("i"), "c")
    refused = marked.filter(~F.col("admitted"))
    probes_l = refused.select(key, F.col("i").alias("pid"), (-F.col("t")).alias("qt"),
                              (-F.col("i") + 1).alias("qi"))
    last = first_at_or_after(adm, probes_l, key, n, rows_per_bucket).select(key, F.col("pid").alias("i"),
                                                             (-F.col("nt")).alias("last_t"))
    joined = (marked.join(last, [key, "i"], "left")
                    .withColumn("_rem", F.lit(interval_us) - (F.col("t") - F.col("last_t"))))
    # ceil of the remaining minutes, in integer arithmetic
    left = F.when(F.col("admitted"), F.lit(0).cast("long")).otherwise(F.expr("(_rem + 59999999) div 60000000"))
    return joined.select(key, "i", "admitted", left.alias("minutes_left"))
