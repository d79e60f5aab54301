"""Upsert by key and additive schema alignment.

``upsert_by_key`` is one full outer join of the store and the (de-duplicated)
batch on the key: each side is hash-partitioned once, and every output row is
decided by a ``CASE`` on which side is present. Rows only in the store pass
through unchanged, rows in the batch replace the stored payload, keep the
stored ``created_at`` and move ``updated_at`` to the load time. The columns are
those of both sides: one that the batch adds is NULL for rows only in the store,
one that the batch lacks keeps what is stored.

When the target is a v2 table that supports row-level operations (Delta,
Iceberg), ``DataFrame.mergeInto`` expresses the same merge and rewrites only
touched files; ``merge_into`` below wraps that path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.operators.dedupe import dedupe_last

CREATED, UPDATED = "created_at", "updated_at"


def upsert_by_key(target: DataFrame, batch: DataFrame, key: str, order_cols, load_time,
                  created: str = CREATED, updated: str = UPDATED) -> DataFrame:
    """Merge ``batch`` into ``target``; the columns evolve as in ``evolved_schema``.

    ``order_cols`` decide the winner among duplicates inside the batch (last
    wins); those that ``target`` lacks only order and are not stored.
    ``load_time`` is a timestamp Column or literal for this load. ``target`` carries
    ``created``/``updated``; those of ``batch`` are ignored. A NULL key in the
    batch has no row to go to and fails the job: quarantine it before.
    """
    held = {c.lower() for c in target.columns}
    aside = {created.lower(), updated.lower(), *(c.lower() for c in order_cols if c.lower() not in held)}
    given = T.StructType([f for f in batch.schema.fields if f.name.lower() not in aside])
    schema = evolved_schema(target.schema, given)
    target = conform(target, schema)
    batch = batch.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"upsert: NULL {key}")).cast(
        batch.schema[key].dataType)))
    now = load_time if isinstance(load_time, Column) else F.lit(load_time).cast("timestamp")
    payload = [c for c in schema.names if c not in (key, created, updated)]
    brought = {f.name.lower() for f in given.fields}
    last = conform(dedupe_last(batch, key, order_cols),
                   T.StructType([f for f in schema.fields if f.name.lower() in brought]))
    t = target.alias("t")
    b = last.alias("b")
    joined = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer")
    in_batch = F.col(f"b.{key}").isNotNull()
    out = [F.coalesce(F.col(f"b.{key}"), F.col(f"t.{key}")).alias(key)]
    out += [(F.when(in_batch, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")) if c.lower() in brought else F.col(f"t.{c}")).alias(c)
            for c in payload]
    out += [F.coalesce(F.col(f"t.{created}"), now).alias(created),
            F.when(in_batch, now).otherwise(F.col(f"t.{updated}")).alias(updated)]
    return joined.select(*out)


def upsert_counts(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """(input_rows, distinct_keys, inserted, updated) of one batch against a store."""
    b = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    t = target.select(key).withColumn("_in_store", F.lit(True))
    j = b.join(t, key, "left")
    return j.agg(F.sum("_n").cast("bigint").alias("input_rows"),
                 F.count(F.lit(1)).alias("distinct_keys"),
                 F.count_if(F.col("_in_store").isNull()).alias("inserted"),
                 F.count_if(F.col("_in_store")).alias("updated"))


def merge_into(spark, table: str, batch: DataFrame, key: str, order_cols, load_time):
    """Row-level merge into a v2 table (Delta/Iceberg) via ``DataFrame.mergeInto``."""
    now = F.lit(load_time).cast("timestamp")
    src = dedupe_last(batch, key, order_cols).withColumn(UPDATED, now).withColumn(CREATED, now)
    cols = src.columns
    cond = F.col(f"{table}.{key}") == F.col(f"src.{key}")
    (src.alias("src").mergeInto(table, cond)
        .whenMatched().update({c: F.col(f"src.{c}") for c in cols if c != CREATED})
        .whenNotMatched().insert({c: F.col(f"src.{c}") for c in cols})
        .merge())


_INTEGRAL = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_FRACTIONAL = [T.FloatType(), T.DoubleType()]


def _evolved_type(old: T.DataType, new: T.DataType, at: str) -> T.DataType:
    if old.simpleString() == new.simpleString():
        return old
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return evolved_schema(old, new, f"{at}.")
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(_evolved_type(old.elementType, new.elementType, f"{at}[]"))
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        return T.MapType(_evolved_type(old.keyType, new.keyType, f"{at} key"), _evolved_type(old.valueType, new.valueType, f"{at}{{}}"))
    if isinstance(new, T.NullType):
        return old
    for wider in (_INTEGRAL, _FRACTIONAL):
        if old in wider and new in wider:
            return wider[max(wider.index(old), wider.index(new))]
    if isinstance(old, T.NullType) or old == T.DoubleType() and new in _INTEGRAL[:3]:
        return new if isinstance(old, T.NullType) else old
    raise ValueError(f"{at}: {new.simpleString()} does not fit the stored {old.simpleString()}")


def evolved_schema(old: T.StructType, new: T.StructType, at: str = "") -> T.StructType:
    """The columns of ``old``, then those that ``new`` adds (names without regard to case).
    A column of both has the wider number type, nested structs gain fields alike; any
    other change of a type is an error, since stored values would be lost."""
    by_name = {f.name.lower(): f for f in new.fields}
    kept = [T.StructField(f.name, _evolved_type(f.dataType, by_name[f.name.lower()].dataType, at + f.name)
                          if f.name.lower() in by_name else f.dataType) for f in old.fields]
    held = {f.name.lower() for f in old.fields}
    return T.StructType(kept + [T.StructField(f.name, f.dataType) for f in new.fields if f.name.lower() not in held])


def _conformed(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if have.simpleString() == want.simpleString():  # nullability aside
        return c
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        own = {f.name.lower(): f for f in have.fields}
        fields = [(_conformed(c[own[f.name.lower()].name], own[f.name.lower()].dataType, f.dataType)
                   if f.name.lower() in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: _conformed(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType) and have.keyType == want.keyType:
        return F.transform_values(c, lambda k, v: _conformed(v, have.valueType, want.valueType))
    return c.cast(want)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, nested fields by name; what it lacks is NULL."""
    own = {f.name.lower(): f for f in df.schema.fields}
    return df.select(*[(_conformed(F.col(own[f.name.lower()].name), own[f.name.lower()].dataType, f.dataType)
                        if f.name.lower() in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def align_schema(df: DataFrame, target: T.StructType, defaults: dict | None = None,
                 keep_extra: bool = False) -> DataFrame:
    """Make ``df`` match ``target``: missing columns are added (default or NULL,
    cast to the target type), present ones are cast, order follows the target.
    Idempotent: aligning an aligned frame changes nothing."""
    defaults = defaults or {}
    have = set(df.columns)
    cols = []
    for f in target.fields:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    if keep_extra:
        names = {f.name for f in target.fields}
        cols += [F.col(c) for c in df.columns if c not in names]
    return df.select(*cols)
