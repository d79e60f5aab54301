"""The record store: versioned bucket folders and a table of loads that points to them.

Rows live in ``data/folder=<load>/bucket=<pmod(xxhash64(key), N)>`` Parquet
folders. ``loads`` is a small Parquet table with one row a load: its version and
folder, the folder of every bucket and the store's schema from then on, and the load's
source and batch. Its newest row is the pointer to the current rows.

An upsert reads only the buckets its batch touches, merges them
(``operators.upsert``: one full outer join on the key), writes them to a folder of
its own and then appends its row to ``loads``, which is the commit: a crash
before it leaves an unread folder, nothing is overwritten in place. Of two writers
of one version the first counts and the other one fails. A column that a batch
adds joins the store's schema; rows of older loads read as NULL there.

``batch_id`` (per ``source``) makes a load idempotent. The bucket count is part of the
store; another count is refused. The cost of a load grows with the buckets it
touches; size ``n_buckets`` to about store size / 1 GB. Folders that no bucket points
to may be deleted by whoever runs the store. With a table format prefer
``operators.upsert.merge_into``.

Files are sorted by key with a bloom filter on it, so a lookup of one key opens one
bucket and, if the key is absent, reads no row group."""

from __future__ import annotations

import json
import os
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.operators.upsert import upsert_by_key

BUCKET, FOLDER = "bucket", "folder"
DATA, LOADS = "data", "loads"
DEFAULT_BUCKETS = 64
LOAD_ROW = T.StructType([
    T.StructField("version", T.LongType()), T.StructField(FOLDER, T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("batch_id", T.StringType()), T.StructField("n_buckets", T.IntegerType()),
    T.StructField("folders", T.MapType(T.IntegerType(), T.StringType())), T.StructField("store_schema", T.StringType())])


class State(NamedTuple):
    """What the loads say: 0, None, {} and None before the first one."""
    version: int
    n_buckets: int | None
    folders: dict[int, str]
    schema: T.StructType | None


def bucket_of(key, n_buckets: int = DEFAULT_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(n_buckets)).cast("int")


def loads(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the table of loads, with the time each was ``written``; None before the first load."""
    try:
        rows = spark.read.schema(LOAD_ROW).parquet(os.path.join(root, LOADS))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.select("*", F.col("_metadata.file_modification_time").alias("written"))


def _first_of_newest(rows: DataFrame):
    """The newest version; of two rows of one version the one written first counts."""
    return rows.orderBy(F.desc("version"), "written", FOLDER).first()


def current(spark: SparkSession, root: str) -> State:
    rows = loads(spark, root)
    last = None if rows is None else _first_of_newest(rows)
    if last is None:
        return State(0, None, {}, None)
    return State(last["version"], last["n_buckets"], dict(last["folders"]), T.StructType.fromJson(json.loads(last["store_schema"])))


def committed(spark: SparkSession, root: str, batch_id, source: str = "load") -> bool:
    rows = loads(spark, root)
    if rows is None:
        return False
    same = rows.filter((F.col("source") == source) & (F.col("batch_id") == str(batch_id))).select("version", FOLDER).collect()
    return any(_first_of_newest(rows.filter(F.col("version") == r["version"]))[FOLDER] == r[FOLDER] for r in same)


def _commit(spark: SparkSession, root: str, state: State, folder: str, source: str, batch_id) -> None:
    folders = F.map_from_arrays(F.lit(list(state.folders)).cast("array<int>"), F.lit(list(state.folders.values())).cast("array<string>"))
    batch = None if batch_id is None else str(batch_id)
    values = [F.lit(state.version), F.lit(folder), F.lit(source), F.lit(batch), F.lit(state.n_buckets), folders, F.lit(state.schema.json())]
    row = spark.range(0, 1, 1, 1).select(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, LOAD_ROW.fields)])
    row.write.mode("append").parquet(os.path.join(root, LOADS))
    if _first_of_newest(loads(spark, root).filter(F.col("version") == state.version))[FOLDER] != folder:
        raise RuntimeError(f"another load committed version {state.version} of {root}")


def _read(spark: SparkSession, root: str, state: State, buckets=None) -> DataFrame | None:
    wanted = state.folders if buckets is None else {b: state.folders[b] for b in buckets if b in state.folders}
    paths = [os.path.join(root, DATA, f"{FOLDER}={f}", f"{BUCKET}={b}") for b, f in sorted(wanted.items())]
    if not paths:
        return None
    schema = T.StructType([*state.schema.fields, T.StructField(BUCKET, T.IntegerType())])
    return spark.read.schema(schema).option("basePath", os.path.join(root, DATA)).parquet(*paths).drop(FOLDER)


def read_store(spark: SparkSession, root: str, buckets=None) -> DataFrame | None:
    """Current rows (with the ``bucket`` column), of all buckets or those given;
    None before the first load."""
    return _read(spark, root, current(spark, root), buckets)


def lookup(spark: SparkSession, root: str, key: str, value) -> DataFrame | None:
    """The rows of one key: only its bucket is opened."""
    state = current(spark, root)
    if state.n_buckets is None:
        return None
    bucket = spark.range(1).select(bucket_of(F.lit(value).cast(state.schema[key].dataType), state.n_buckets)).first()[0]
    rows = _read(spark, root, state, [bucket])
    return None if rows is None else rows.filter(F.col(key) == F.lit(value))


def upsert_store(spark: SparkSession, root: str, batch: DataFrame, key: str, order_cols, load_time,
                 empty_target: DataFrame, n_buckets: int = DEFAULT_BUCKETS, batch_id=None, source: str = "load") -> bool:
    """Merge ``batch`` into the store; returns False when ``batch_id`` of
    ``source`` was already committed (nothing is written). Columns of ``batch`` that the
    store lacks join it, but for those that only order (``order_cols``)."""
    if batch_id is not None and committed(spark, root, batch_id, source):
        return False
    state = current(spark, root)
    if state.n_buckets not in (None, n_buckets):
        raise ValueError(f"the store has {state.n_buckets} buckets, not {n_buckets}")
    schema = state.schema or empty_target.schema
    b = batch.withColumn(BUCKET, bucket_of(F.col(key).cast(schema[key].dataType), n_buckets))
    # the touched bucket ids: at most n_buckets small integers
    touched = sorted(r[0] for r in b.select(BUCKET).distinct().collect())
    folder = f"load-{state.version + 1}-{uuid.uuid4().hex[:12]}"
    held = _read(spark, root, state, touched)
    target = spark.createDataFrame([], schema) if held is None else held.drop(BUCKET)
    merged = upsert_by_key(target, b.drop(BUCKET), key, order_cols, load_time)
    if touched:
        (merged.withColumn(BUCKET, bucket_of(key, n_buckets)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, key)
         .write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
         .partitionBy(BUCKET).parquet(os.path.join(root, DATA, f"{FOLDER}={folder}")))
    after = State(state.version + 1, n_buckets, state.folders | {b: folder for b in touched},
                  T.StructType([T.StructField(f.name, f.dataType) for f in merged.schema.fields]))
    _commit(spark, root, after, folder, source, batch_id)
    return True
