"""JSON text <-> nested columns (decode with a fallback, encode for export)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad_text"


def decode_json(c, schema, fallback: Column | None = None) -> Column:
    """Parse JSON text with an explicit schema; bad or missing text -> fallback.

    Bad text for a struct parses to a struct of NULLs, so with a fallback the
    parser also reports the text it could not read."""
    text = F.col(c) if isinstance(c, str) else c
    if fallback is None:
        return F.from_json(text, schema)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not isinstance(kind, T.StructType):
        return F.coalesce(F.from_json(text, schema), fallback)
    parsed = F.from_json(text, T.StructType([*kind.fields, T.StructField(BAD, T.StringType())]),
                         {"columnNameOfCorruptRecord": BAD})
    good = parsed.isNotNull() & parsed[BAD].isNull()
    return F.when(good, F.struct(*[parsed[f.name].alias(f.name) for f in kind.fields])).otherwise(fallback)


def encode_json(c) -> Column:
    """Nested value -> compact JSON text (export only; the store keeps it nested)."""
    return F.to_json(F.col(c) if isinstance(c, str) else c)
