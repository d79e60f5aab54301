"""A record table laid out in the order of its pages, with two small side tables.

``write_ordered`` range-partitions records by (newest first, key) into parts of
about ``rows_per_part`` rows, one folder ``part=<n>`` each, and writes beside them

- ``directory``: rows per (part, facet value). ``page_at`` finds the parts that
  hold a page at any offset from running sums, and reads these alone;
- ``postings``: (trigram, part) over the folded text columns, sorted by
  trigram. ``search_ordered`` reads only the parts that hold every trigram of
  the query and then applies the exact test of ``search.filter_records``.

The layout is written once and read-only; a new one is written after loads.
Parts are cut by ranges of (time, key), so a time that very many rows share is
cut by key.

Defined cases: rows with equal time and key are interchangeable; NULL times
come last; NULL facets have a directory entry of their own; NULL texts have no
trigrams; queries below three characters have no trigram and read all parts; an
empty table has no parts and every page of it is empty.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from feedlake.functions.text import ascii_lower
from feedlake.operators.search import clamp_limit, clamp_offset, filter_records

GRAM = 3
ROWS_PER_PART = 1_000_000


def _order(newest_col: str, key: str) -> list[Column]:
    return [F.col(newest_col).desc_nulls_last(), F.col(key).asc()]


def _grams(text: Column) -> Column:
    folded = ascii_lower(text)
    starts = F.sequence(F.lit(1), F.length(folded) - (GRAM - 1))
    return F.when(F.length(folded) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substr(folded, i, F.lit(GRAM)))))


def write_ordered(records: DataFrame, path: str, newest_col: str, key: str, facet: str | None = None, text_cols=(),
                  rows_per_part: int = ROWS_PER_PART) -> None:
    """Writes rows, directory and postings under ``path``; a column named ``part`` is not allowed."""
    if "part" in (c.lower() for c in records.columns):
        raise ValueError("the layout names its folders 'part': rename that column")
    spark = records.sparkSession
    parts = max(1, -(-records.select(F.lit(1)).count() // rows_per_part))
    ranged = records.repartitionByRange(parts, *_order(newest_col, key)).withColumn("part", F.spark_partition_id())
    # one task holds one part, so the folder column does not disturb the order inside it
    ranged.sortWithinPartitions("part", *_order(newest_col, key)).write.partitionBy("part").parquet(f"{path}/rows")
    rows = _rows(spark, path, records.schema)
    facet_col = F.col(facet).cast("string") if facet else F.lit(None).cast("string")
    directory = rows.select("part", facet_col.alias("facet")).groupBy("part", "facet").agg(F.count(F.lit(1)).alias("n"))
    directory.coalesce(1).write.parquet(f"{path}/directory")  # a row per part and facet value
    if text_cols:
        grams = F.flatten(F.array_compact(F.array(*[_grams(F.col(c)) for c in text_cols])))
        postings = rows.select("part", F.explode(F.array_distinct(grams)).alias("gram")).distinct()
        postings.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part").write.parquet(f"{path}/postings")
    facts = {"newest_col": newest_col, "key": key, "facet": facet, "text_cols": list(text_cols), "schema": records.schema.json()}
    spark.range(1).select(F.lit(json.dumps(facts)).alias("value")).coalesce(1).write.text(f"{path}/facts")


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("part", IntegerType())])).parquet(f"{path}/rows")


def _open(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    return facts, _rows(spark, path, StructType.fromJson(json.loads(facts["schema"])))


def _keep_parts(rows: DataFrame, parts: list[int]) -> DataFrame:
    """Folders are chosen while the scan is planned; no other is opened."""
    return rows.filter(F.col("part").isin(*parts)) if parts else rows.filter(F.lit(False))


def page_at(spark: SparkSession, path: str, limit=100, offset=0, facet_value: str | None = None) -> DataFrame:
    """The page that ``search.search_page`` gives at ``offset``, read from the parts that hold it.

    The directory has one row per part and facet value and is summed by one small window; the parts of the
    page come to the driver, at most ``limit`` of them. Each task keeps at most one part's offset plus ``limit`` rows,
    however deep the page is.
    """
    n, o = clamp_limit(limit), clamp_offset(offset)
    facts, rows = _open(spark, path)
    directory = spark.read.schema("part int, facet string, n long").parquet(f"{path}/directory")
    if facet_value is not None:
        if not facts["facet"]:
            raise ValueError("the layout was written without a facet")
        directory = directory.filter(F.col("facet") == facet_value)
        rows = rows.filter(F.col(facts["facet"]) == facet_value)
    sums = directory.groupBy("part").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    held = (sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
            .filter((F.col("upto") > o) & (F.col("before") < o + n)).orderBy("part").collect())
    page = _keep_parts(rows, [r["part"] for r in held]).drop("part").orderBy(*_order(facts["newest_col"], facts["key"]))
    inside = o - held[0]["before"] if held else 0
    return page.offset(inside).limit(n) if inside else page.limit(n)


def parts_with(spark: SparkSession, path: str, query: str) -> list[int] | None:
    """The parts that hold every trigram of the query, in order; None where the query has none to look up."""
    folded = query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    grams = sorted({folded[i:i + GRAM] for i in range(len(folded) - GRAM + 1)})
    if not grams:
        return None
    postings = spark.read.schema("part int, gram string").parquet(f"{path}/postings")
    full = postings.filter(F.col("gram").isin(*grams)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # part numbers only: one per ROWS_PER_PART rows of the table
    return [r["part"] for r in full.filter(F.col("n") == len(grams)).orderBy("part").collect()]


def search_ordered(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The rows of which a text column of the layout holds ``query`` (literal, ASCII case folded), as
    ``search.filter_records`` gives them, read from the parts that can hold it."""
    facts, rows = _open(spark, path)
    if not facts["text_cols"]:
        raise ValueError("the layout was written without text columns")
    parts = parts_with(spark, path, query)
    if parts is not None:
        rows = _keep_parts(rows, parts)
    return filter_records(rows, search=query, search_cols=facts["text_cols"]).drop("part")
