"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.session import checkpoint_root

#: Separator of words for the operators that split on ASCII white space
#: (fixed value): a word is a maximal run of other characters.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"

#: Texts, and bytes of texts, that a Python function works on at a time; a text
#: that is longer goes alone.
TEXT_ROWS = 128
TEXT_BYTES = 1 << 20

#: Spark closes an Arrow batch at 64 MB, which the executor, its Python worker and
#: the batch's results hold at once in every task; ``cut_texts`` closes it here.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the text columns of each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
            total += pc.binary_length(column).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return total


def slices(batches: Iterable[pa.RecordBatch], rows: int = TEXT_ROWS, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and ``size`` bytes of texts, without a copy, so that what a
    function derives from whole texts is bounded whatever the session's batch size."""
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(_row_bytes(batch))])
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(upto, upto[lo] + size, side="right")) - 1
            hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once under the cluster's shared
    ``spark.checkpoint.dir`` and read it from there. Survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def cut_texts(df: DataFrame) -> DataFrame:
    """``cut`` of what Python functions make of whole texts: while it is computed, Arrow
    batches close at ``BATCH_BYTES``; then the session's own limit holds again."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return cut(df)
    finally:
        conf.set(_BATCH, before)


def null_key(col: Column) -> Column:
    """A text key under which NULL is a value of its own, for joins and windows."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("-"))


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those that an operator is about to add: on a
    clash of names (case is ignored) the operator's column replaces the input's."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
