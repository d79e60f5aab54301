"""Batch load: landed pages -> accepted records, quarantine and a slice report.

    accepted, quarantine, report = load(spark, "s3://bucket/landing/", detail_base=...)

One scan of the page files (slices from ``slice=<name>`` folders), one
projection, one validation pass. The validated frame is checkpointed to the
shared checkpoint folder (a reliable lineage cut) so that writing both the
accepted and the quarantined side — and the report — reads the pages once,
and a lost executor recomputes from the checkpoint, not from the landing
zone. Duplicates resolve last-wins by slice order, then page number, file,
line and position. Nothing is lost: every hit is accepted, a duplicate, or in
the quarantine, where bad hits and bad pages keep their text (``bad_text``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.operators.dedupe import dedupe_last
from feedlake.operators.links import attach_links
from feedlake.operators.normalize import drop_raw, normalize_hits
from feedlake.operators.report import slice_load_report
from feedlake.operators.validate import REASONS, any_failure, hit_type_reasons, reasons_column, record_rules
from feedlake.schemas import HIT, RECORD
from feedlake.session import checkpoint_root
from feedlake.sources import runlog, store
from feedlake.sources.pages import HIT_ORDER, parsed_hits, read_pages

SLICE_ALL = "all"


def load(spark: SparkSession, path: str, detail_base: str, slice_order: list[str] | None = None,
         rules=None, multiline: bool = True, store_root: str | None = None, load_time=None,
         n_buckets: int = store.DEFAULT_BUCKETS, batch_id=None, cut_lineage: bool = True,
         detail_pages: DataFrame | None = None, job_id: str | None = None):
    """-> (accepted, quarantine, slice_report).

    ``slice_order`` ranks slices for last-wins (later wins); by default the
    unfiltered slice ``all`` first and every facet slice after it. With
    ``store_root`` the accepted rows are also upserted into the bucket store
    (idempotent per ``batch_id``). ``cut_lineage=False`` skips the checkpoint
    when the caller consumes only one of the outputs, once. ``detail_pages``
    (url, html) fills ``externalLinks`` of the accepted records. With ``store_root`` and
    ``job_id`` the run is logged beside the store: its start, its end with the rows
    accepted or its error, and a progress snapshot (``sources.runlog``).
    """
    if job_id is not None and store_root is not None:
        with runlog.logged_run(spark, store_root, job_id) as run:
            out = load(spark, path, detail_base, slice_order, rules, multiline, store_root, load_time, n_buckets,
                       batch_id, True, detail_pages)
            seen = out[2].agg(F.sum("accepted"), F.sum("rejected")).first()  # from the checkpointed rows
            run.total = seen[0] or 0
            runlog.save_progress(spark, store_root, job_id, 0, run.total, seen[1] or 0)
        return out
    checkpoint_root(spark)
    rules = rules or record_rules()
    records = normalised_pages(read_pages(spark, path, multiline), detail_base)
    checked = records.withColumn("_bad", F.col("bad").isNotNull() | any_failure(rules))
    if cut_lineage:
        checked = checked.checkpoint()

    bad_page = F.col("bad").isin("malformed_page", "no_hits")
    report = slice_load_report(checked, "slice", "cve_id", ~F.col("_bad"), bad_page=F.coalesce(bad_page, F.lit(False)))
    reasons = F.when(F.col("bad").isNotNull(), bad_reasons()).otherwise(reasons_column(rules))
    quarantine = checked.filter("_bad").withColumn(REASONS, reasons).drop("_bad", "bad")
    if slice_order:
        rank = F.array_position(F.array(*[F.lit(s) for s in slice_order]), F.col("slice"))
    else:
        rank = F.when(F.col("slice") == SLICE_ALL, F.lit(0)).otherwise(F.lit(1))
    ok = drop_raw(checked.filter(~F.col("_bad")).drop("_bad", "bad", "bad_text")).withColumn("_slice_rank", rank)
    accepted = dedupe_last(ok, "cve_id", ["_slice_rank", *HIT_ORDER]).drop("_slice_rank")

    if detail_pages is not None:
        accepted = attach_links(accepted, detail_pages)

    if store_root is not None:
        payload = [c for c in RECORD.fieldNames() if c not in ("created_at", "updated_at")]
        batch = accepted.select(*payload, F.lit(0).alias("_seq"))
        store.upsert_store(spark, store_root, batch, "cve_id", ["_seq"], load_time,
                           spark.createDataFrame([], RECORD), n_buckets, batch_id=batch_id)
    return accepted, quarantine, report


def bad_reasons():
    """Reasons of a row of ``normalised_pages`` with ``bad`` set: the code, then the fields of a wrong type."""
    fields = F.when(F.col("bad") == "malformed_hit", hit_type_reasons("bad_text"))
    return F.concat(F.array("bad"), F.coalesce(fields, F.array().cast("array<string>")))


def normalised_pages(pages: DataFrame, detail_base: str) -> DataFrame:
    """Records of all hits (raw columns kept) with slice, place, ``bad`` and ``bad_text``; a bad page is a row too."""
    found = parsed_hits(pages)
    found = found.withColumn("slice", F.coalesce("slice", F.lit(SLICE_ALL)))
    extra = ["slice", *HIT_ORDER, "bad", "bad_text"]
    # of an unreadable hit only the text is kept
    fields = [F.when(F.col("bad").isNull(), F.col(f"h.{f.name}")).alias(f.name) for f in HIT.fields]
    return normalize_hits(found.select(*extra, *fields), detail_base, keep_raw=True, extra=extra)


def accepted_records(accepted: DataFrame) -> DataFrame:
    """The record columns only (drops slice and page bookkeeping)."""
    return accepted.select(*[c for c in RECORD.fieldNames() if c in accepted.columns])
