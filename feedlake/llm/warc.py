"""WARC records in seekable Zstandard bundles.

Records are written to independent Zstandard frames of about ``FRAME_BYTES``
bytes, frames to bundles of about ``BUNDLE_BYTES``. Behind its frames a bundle
has a skippable frame with the record index (record id -> frame, offset in the
decompressed frame, length) and the footer: the seek table, a skippable frame
with the sizes of all frames, in the public seekable format. One record is
read by footer, index and a single frame.

Equal payloads are found by digest: only the digests that occur twice are
joined back, so no text is grouped; a hot digest meets one row and AQE can
split its side. Bundles are rows (bundle, records, archive) of a table that
Spark writes and commits, safely under lost executors; ``archive`` is a complete
file. ``write_archives`` puts each into a file ``<bundle>.warc.zst`` of its own
and a table of record offsets beside them; ``read_archives`` reads all files back,
``read_keys`` only those that hold the records asked for. A task holds one bundle
and one record at a time.

Defined cases: a NULL payload is an empty one; payloads under ``MIN_REVISIT``
bytes are always responses; of equal payloads the row with the smallest id is
the response and rows with that same id all are; NULL ids are never the
smallest and a group of NULL ids alone has responses only; line breaks in URLs
and ids are percent-encoded. A payload of any length is one record in a frame of its
own; an empty table gives no bundle, no file and no row. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import slices

MIN_REVISIT = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 22
LEVEL = 3
# fixed values of the seekable format and of WARC
_SKIPPABLE_INDEX = 0x184D2A50
_SKIPPABLE_SEEK = 0x184D2A5E
_SEEK_MAGIC = 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_URN = "urn:record:"
BUNDLE_SCHEMA = "bundle string, records long, archive binary"


def record_id(key: str | None) -> str:
    return _URN + ("null" if key is None else "id:" + quote(key, safe=""))


def key_of(urn: str) -> str | None:
    name = urn.removeprefix(_URN)
    return None if name == "null" else unquote(name.removeprefix("id:"))


def warc_record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit (``refers_to`` is set) has the HTTP header but not the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id(key)}>"),
            ("WARC-Date", _DATE), ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    block = http + (payload if refers_to is None else b"")
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields, HTTP payload length and payload (None for a revisit) of one record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines)
    length = int(head["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its content")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    told = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    full = head["WARC-Type"] == "response"
    if full and told != len(payload):
        raise ValueError("a payload is cut")
    return {"head": head, "payload_bytes": told, "payload": payload if full else None}


class BundleWriter:
    """Collects records into one bundle."""

    def __init__(self) -> None:
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._open, self._open_bytes = [], 0
        self.index: list[tuple[str, int, int, int]] = []
        self.bytes = 0

    def add(self, urn: str, record: bytes) -> None:
        if self._open and self._open_bytes + len(record) > FRAME_BYTES:
            self._close()
        self.index.append((urn, len(self._sizes), self._open_bytes, len(record)))
        self._open.append(record)
        self._open_bytes += len(record)

    def _close(self) -> None:
        plain = b"".join(self._open)
        frame = self._zstd.compress(plain)
        self._frames.append(frame)
        self._sizes.append((len(frame), len(plain)))
        self.bytes += len(frame)
        self._open, self._open_bytes = [], 0

    def finish(self) -> bytes:
        if self._open:
            self._close()
        names = zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps(self.index).encode())
        index = struct.pack("<II", _SKIPPABLE_INDEX, len(names)) + names
        entries = b"".join(struct.pack("<II", *s) for s in [*self._sizes, (len(index), 0)])
        footer = struct.pack("<IBI", len(self._sizes) + 1, 0, _SEEK_MAGIC)
        seek = struct.pack("<II", _SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer
        return b"".join([*self._frames, index, seek])


class BundleReader:
    """Random access to a bundle: ``read(i)`` gives record i of ``index``."""

    def __init__(self, archive: bytes) -> None:
        frames, flags, magic = struct.unpack("<IBI", archive[-9:])
        if magic != _SEEK_MAGIC or flags:
            raise ValueError("no seek table")
        at = len(archive) - 9 - 8 * frames
        sizes = list(struct.iter_unpack("<II", archive[at:-9]))
        self._archive, self._at, offset = memoryview(archive), [], 0
        for packed, _ in sizes:
            self._at.append((offset, packed))
            offset += packed
        if offset + 8 != at:
            raise ValueError("the seek table does not match the frames")
        start, packed = self._at[-1]
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(archive[start + 8:start + packed]))
        self._frame: tuple[int, bytes] = (-1, b"")

    def read(self, i: int) -> bytes:
        _, frame, offset, length = self.index[i]
        if self._frame[0] != frame:
            start, packed = self._at[frame]
            self._frame = (frame, zstandard.ZstdDecompressor().decompress(self._archive[start:start + packed]))
        return self._frame[1][offset:offset + length]


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, url, payload, digest, refers_to) to bundles."""
    part, made, writer = TaskContext.get().partitionId() if TaskContext.get() else 0, 0, BundleWriter()

    def bundle() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:06d}"]), pa.array([len(writer.index)]),
                                           pa.array([writer.finish()], pa.binary())], names=["bundle", "records", "archive"])

    for batch in slices(batches):
        for i in range(batch.num_rows):
            key, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
            writer.add(record_id(key), warc_record(key, url, payload, digest, refers_to))
            if writer.bytes >= BUNDLE_BYTES:
                yield bundle()
                made, writer = made + 1, BundleWriter()
    if writer.index:
        yield bundle()


def bundles(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One row per bundle of the records of ``pages``, revisits resolved."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_REVISIT
    first = (rows.filter(large).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
             .filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("same"), "first"))
    # small payloads get a join key of their own, spread over all tasks
    on = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.xxhash64("key", "url").cast("string")))
    met = rows.withColumn("on", on).join(first, F.col("on") == F.col("same"), "left")
    refers = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    return met.select(F.col("key").cast("string").alias("key"), "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(
        pack, BUNDLE_SCHEMA)


OFFSET_SCHEMA = "bundle string, key string, frame long, offset long, length long"
SUFFIX = ".warc.zst"


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def write_archives(archives: DataFrame, folder: str) -> None:
    """A file per bundle in ``folder``/archives, written by the tasks, and the table
    ``folder``/offsets: where each record is. ``folder`` is shared by all executors.

    Give a written or checkpointed table of bundles: a task that runs again writes the
    same bytes. A file appears under its name when it is complete."""
    place = f"{folder}/archives"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(place)
        files.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in slices(batches, 1):
            for name, archive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                unfinished = f"{root}/_{name}-{attempt}"
                with files.open_output_stream(unfinished) as out:
                    out.write(archive)
                files.move(unfinished, f"{root}/{name}{SUFFIX}")
                rows = [(name, key_of(urn), frame, offset, length) for urn, frame, offset, length in BundleReader(archive).index]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                                                 names=[x.split()[0] for x in OFFSET_SCHEMA.split(", ")])

    files, root = _files(place)
    files.create_dir(root, recursive=True)
    archives.select("bundle", "archive").mapInArrow(save, OFFSET_SCHEMA).write.parquet(f"{folder}/offsets")


def _load(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(paths)
    return found.select(F.regexp_extract("path", r"([^/]+)\.warc\.zst$", 1).alias("bundle"), F.col("content").alias("archive"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, archive) of the files that ``write_archives`` wrote."""
    return _load(spark, [f"{folder}/archives"])


def read_keys(spark: SparkSession, folder: str, keys: list[str | None]) -> DataFrame:
    """The records of ``keys``: the offsets name their files (at most one a key and repeat), others are not opened."""
    asked = F.col("key").isin([k for k in keys if k is not None])
    if None in keys:
        asked = F.coalesce(asked, F.lit(True))
    names = [r["bundle"] for r in spark.read.parquet(f"{folder}/offsets").filter(asked).select("bundle").distinct().collect()]
    place = f"{folder}/archives"
    found = _load(spark, [f"{place}/{n}{SUFFIX}" for n in sorted(names)] or [place])
    return records(found if names else found.limit(0), keys)


RECORD_SCHEMA = ("bundle string, key string, url string, record_type string, refers_to string, payload_digest string, "
                 "payload_bytes long, payload binary")


def records(archives: DataFrame, keys: list[str | None] | None = None, payloads: bool = True) -> DataFrame:
    """The records of the bundles, or only those of ``keys`` (by the index:
    other frames are not decompressed). Without ``payloads`` they are read and
    checked against their digest, and NULL is returned."""
    import hashlib
    wanted = None if keys is None else {record_id(k) for k in keys}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for name, archive in zip(batch.column(0), batch.column(1)):
                reader, out = BundleReader(archive.as_py()), []
                for i, entry in enumerate(reader.index):
                    if wanted is not None and entry[0] not in wanted:
                        continue
                    got = parse_record(reader.read(i))
                    head, body = got["head"], got["payload"]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if body is not None and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"damaged record {entry[0]}")
                    refers = head.get("WARC-Refers-To")
                    out.append((name.as_py(), key_of(head["WARC-Record-ID"][1:-1]), head["WARC-Target-URI"],
                                head["WARC-Type"], key_of(refers[1:-1]) if refers else None, digest,
                                got["payload_bytes"], body if payloads else None))
                columns = list(zip(*out)) or [()] * 8
                kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                                 names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    return archives.select("bundle", "archive").mapInArrow(unpack, RECORD_SCHEMA)
