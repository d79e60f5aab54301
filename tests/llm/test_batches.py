"""What Python functions hold of whole texts at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from feedlake.llm import common, decontaminate, simhash
from feedlake.llm.common import BATCH_BYTES, TEXT_BYTES, TEXT_ROWS, cut_texts, slices


def test_slices_are_bounded_by_the_bytes_of_their_texts():
    texts = ["x" * 100_000] * 40 + [None] * 300 + ["y" * (2 * TEXT_BYTES), "", "é" * 50]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "t": texts, "b": [b"zz"] * len(texts)})
    parts = list(slices([batch, batch.slice(5, 0), batch.slice(30, 20)]))
    got = [i for p in parts for i in p.column(0).to_pylist()]
    assert got == [*range(len(texts)), *range(30, 50)]
    for p in parts:
        size = sum(len((t or "").encode()) + 2 for t in p.column(1).to_pylist())
        assert 0 < p.num_rows <= TEXT_ROWS and (size <= TEXT_BYTES or p.num_rows == 1)


def test_texts_reach_python_in_small_batches_and_the_setting_comes_back(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    before = spark.conf.get(common._BATCH)
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("some words "), 500).alias("text"))
    got = cut_texts(texts.mapInArrow(sizes, "rows long, bytes long")).collect()
    assert sum(r["rows"] for r in got) == 4000 and max(r["bytes"] for r in got) < 2 * BATCH_BYTES
    assert spark.conf.get(common._BATCH) == before


def test_scans_of_whole_texts_use_them(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12))), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(1, 11)))], "item_id string, text string")
    seen = []

    def spied(df):
        seen.append(df.columns)
        return cut_texts(df)

    monkeypatch.setattr(decontaminate, "cut_texts", spied)
    monkeypatch.setattr(simhash, "cut_texts", spied)
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [2]
    assert simhash.near_dedup(docs).count() == 2
    assert len(seen) == 3 and ["id", "kt", "fp"] in seen
