"""Landed hit pages (JSON) -> one row per hit.

Pages of both envelope styles are read in one scan with an explicit schema
(no inference), and hits are parsed one by one. A malformed page or hit is kept
as text and goes to the quarantine; the other hits of its page load. One file per page parallelises
the read. Slices are sub-folders ``slice=<name>``: Spark's partition
discovery turns the folder name into a column, so 100 slices are one scan,
not 100 unioned plans. The schema gives that column as a string, so ``2023``,
``01`` or ``2023-01-05`` stay the names they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.schemas import CORRUPT, CORRUPT_HIT, HIT, HIT_TEXT, SLICED_PAGE


def read_pages(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Raw pages with ``page_file`` and (when present in the path) the slice.

    ``multiline=True`` reads one page per file (as fetched); ``False`` reads
    JSON lines, one page per line, which splits large landing files."""
    reader = (spark.read.schema(SLICED_PAGE)
              .option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT)
              .option("multiLine", str(multiline).lower()))
    return with_page_place(reader.json(path))


def with_page_place(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"page_file": F.col("_metadata.file_path"), "page_block": F.col("_metadata.file_block_start")})


#: The page number in a file name, unless the page has its own ``page_seq``: the digits
#: after ``page`` or of a name that is one letter and a number. Other names have none.
PAGE_NUMBER = r"(?i)(?:page[-_.]?|^p)(\d+)"

#: Columns that order hits as they were fetched: page number (``page_seq``, else
#: ``PAGE_NUMBER``, else 0), file, place of the page in the file, place of the hit in
#: the page.
HIT_ORDER = ["page_no", "page_file", "page_block", "page_line", "hit_pos"]


def parsed_hits(pages: DataFrame, keep=("slice",), page_number: str = PAGE_NUMBER) -> DataFrame:
    """One row per hit (struct ``h``) and one per bad page. ``page_number`` is the pattern
    whose group 1 is the page number in a file name.

    ``bad`` is NULL for a readable hit, else ``malformed_page``, ``no_hits`` or
    ``malformed_hit``, with the text in ``bad_text``. Pages with an empty hits
    list are fine and give no row.
    """
    keep = [c for c in keep if c in pages.columns]
    named = F.regexp_extract(F.regexp_extract("page_file", r"([^/]*)$", 1), page_number, 1).try_cast("bigint")
    search = F.flatten(F.filter(F.transform("results", lambda r: r["hits"]), lambda h: h.isNotNull()))
    hits = F.concat(F.coalesce("hits", F.array().cast("array<string>")), F.coalesce(search, F.array().cast("array<string>")))
    bad_page = (F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed_page"))
                .when(F.col("hits").isNull() & F.col("results").isNull(), F.lit("no_hits")))
    rows = pages.select(*keep, "page_file", "page_block", F.coalesce("page_seq", named, F.lit(0)).alias("page_no"),
                        F.monotonically_increasing_id().alias("page_line"), bad_page.alias("bad_page"),
                        F.col(CORRUPT).alias("page_text"), hits.alias("hits"))
    # a bad page is one row without a hit
    entries = F.when(F.col("bad_page").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("hits"))
    rows = rows.select(*keep, "page_no", "page_file", "page_block", "page_line", "bad_page", "page_text",
                       F.posexplode(entries).alias("hit_pos", "hit_text"))
    rows = rows.withColumn("h", F.from_json("hit_text", HIT_TEXT, {"columnNameOfCorruptRecord": CORRUPT_HIT}))
    bad = F.coalesce("bad_page", F.when(F.col("h").isNull() | F.col(f"h.{CORRUPT_HIT}").isNotNull(), F.lit("malformed_hit")))
    return rows.select(*keep, *HIT_ORDER, "h", bad.alias("bad"),
                       F.when(bad.isNotNull(), F.coalesce("page_text", "hit_text")).alias("bad_text"))


def hits_from_pages(pages: DataFrame, keep=("slice",)) -> DataFrame:
    """The readable hits of both envelopes, in columns, with their place (``HIT_ORDER``)."""
    found = parsed_hits(pages, keep)
    keep = [c for c in keep if c in pages.columns]
    return found.filter("bad IS NULL").select(*keep, *HIT_ORDER, *[f"h.{f.name}" for f in HIT.fields])


def page_quarantine(pages: DataFrame) -> DataFrame:
    """Pages that could not be parsed or carried no hits list at all, and hits that could not be parsed."""
    return parsed_hits(pages).filter("bad IS NOT NULL").select("page_file", "hit_pos", F.col("bad").alias("reason"), "bad_text")


def read_hit_pages(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return hits_from_pages(read_pages(spark, path, multiline))
