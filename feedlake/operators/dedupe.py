"""Keyed de-duplication (last write wins), slice unions and row caps.

Arrival order is not reproducible on a cluster, so "last" is always defined
by explicit order columns (a sequence number, a timestamp, a slice rank).
``row_number() == 1`` plans as WindowGroupLimit -> Exchange ->
WindowGroupLimit: duplicates are pruned inside each map task before the
shuffle, so a key that repeats in a third of all rows ships only one row per
map task, not all of its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = "_rank"


def _order(cols, descending: bool = True) -> list[Column]:
    out = []
    for c in cols:
        col = F.col(c) if isinstance(c, str) else c
        out.append(col.desc_nulls_last() if descending else col.asc_nulls_last())
    return out


def dedupe_last(df: DataFrame, key, order_cols, keep_rank: bool = False) -> DataFrame:
    """One row per key: the row with the greatest ``order_cols`` (lexicographic).

    ``order_cols`` must make the winner unique within a key; include a
    sequence or a tiebreak column.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*_order(order_cols, True))
    ranked = df.withColumn(RANK, F.row_number().over(w)).filter(F.col(RANK) == 1)
    return ranked if keep_rank else ranked.drop(RANK)


def dedupe_last_narrow(df: DataFrame, key: str, value_cols: list[str], order_col: str) -> DataFrame:
    """Latest values of a few narrow columns per key via ``max_by``.

    Plans as a partial hash aggregate (map-side combine), cheaper than a
    window when only a couple of scalar columns are needed.
    """
    return df.groupBy(key).agg(*[F.max_by(c, order_col).alias(c) for c in value_cols],
                               F.max(order_col).alias(order_col))


def cap_per_group(df: DataFrame, group, n: int, order_cols, descending: bool = True,
                  rank_col: str | None = "rank") -> DataFrame:
    """At most ``n`` rows per group, the first by ``order_cols`` (top-k per group)."""
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(*_order(order_cols, descending))
    out = df.withColumn(RANK, F.row_number().over(w)).filter(F.col(RANK) <= n)
    return out.withColumnRenamed(RANK, rank_col) if rank_col else out.drop(RANK)


def cap_total(df: DataFrame, n: int, order_cols, descending: bool = False) -> DataFrame:
    """A load cap: the first ``n`` rows by explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*_order(order_cols, descending)).limit(n)


def union_slices(slices: dict[str, DataFrame], slice_col: str = "slice") -> DataFrame:
    """Tag and union slices by name (all must share column names)."""
    out = None
    for name, frame in slices.items():
        tagged = frame.withColumn(slice_col, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
