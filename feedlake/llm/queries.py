"""The operators bound to the driver's tables: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import chat, decontaminate, mixing, neighbours, pii, quality, repair, secret_scan, sharding, simhash, toxicity, variants, warc
from feedlake.llm.common import cut, null_key, read_table
from feedlake.llm.oracles import ORACLES  # noqa: F401
from feedlake.session import scratch_path

SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"),
                         F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64("text").alias("h"))
    out = sharding.shard_records(narrow, [F.col("h"), F.col("doc_id")], F.col("size"), SHARDS, F.col("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read_table(spark, sf_dir, "documents"), mixing.cycling_weights)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "warc")
    warc.write_archives(cut(warc.bundles(pages)), folder)
    kind = pages.schema["page_id"].dataType
    return warc.records(warc.read_archives(spark, folder), payloads=False).select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


PROBE_TEXT = "\\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)], turns.schema)
    out = chat.read_back(chat.format_turns(turns.unionByName(probe)))
    return out.select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                      "formatted_chars", "valid")


def _count(spans: str, kind: int, name: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(name)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(read_table(spark, sf_dir, "documents"))
    counts = [_count("base", i, f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(pii.span_text("base"), 256).alias("base_sha256"),
                      pii.span_text("spans").alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secrets(read_table(spark, sf_dir, "documents"))
    out = out.withColumn("base", F.filter("spans", lambda x: x["kind"] < 3))
    counts = [_count("base", i, f"n_{k}") for i, k in enumerate(secret_scan.KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(pii.span_text("base", secret_scan.KINDS), 256).alias("base_sha256"),
                      pii.span_text("spans", secret_scan.KINDS).alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "n_removed_words")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("id") % 100 == 0).select(
        "query_id", "rank", F.col("neighbour").alias("vec_id"), "score")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.words(read_table(spark, sf_dir, "documents"), drop_every=97)
    return variants.group(variants.vocabulary(found)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    found = repair.repair(repair.damaged(turns))
    ids = turns.select("conv_id").distinct().withColumn("k", null_key(F.col("conv_id")))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in
              ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, "k", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_chat": op4_chat,
    "op5_pii": op5_pii,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_neighbours": op11_neighbours,
    "op12_variants": op12_variants,
    "op13_repair": op13_repair,
}
