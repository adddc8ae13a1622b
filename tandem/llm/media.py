"""Media columns (operator 6): archives of media members behind a custom Spark data source.

An archive folder holds shards; a shard is its members one after the other, then an index of their offsets. Writing
commits shards by a rename, so a task that runs twice leaves one shard. Reading plans byte ranges by the shards' sizes
alone; each task opens its shard's index, takes the members that begin in its range, fetches each by its offset, and
tries a member again by itself where reading or its checksum fails. Payloads are streamed as Arrow batches.

The member format is PNG with 8-bit grey samples, one filter-0 row per WIDTH bytes: a lossless store for any bytes.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tandem.llm.util import integral, shared_dir, tidy

WIDTH = 576  # samples in a row
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 3
_PNG = b"\x89PNG\r\n\x1a\n"
_ENTRY = "<qqII"  # id, offset, size, crc32; a null id is stored as the smallest number
_FOOTER = "<qq8s"  # where the index begins, how many members, mark
_MARK = b"tndmidx1"
_NULL = -(1 << 63)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """payload: a positive multiple of WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that to_png made; ValueError for anything else or a wrong checksum."""
    if data[:8] != _PNG:
        raise ValueError("no PNG")
    at, parts, shape = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"wrong checksum of {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    if raw[:, 0].any():
        raise ValueError("a filtered row")
    return raw[:, 1:].tobytes()


def padded(text: bytes) -> bytes:
    """The payload of a text: bytes 255 up to a positive multiple of WIDTH."""
    return text + b"\xff" * (WIDTH - len(text) if not text else -len(text) % WIDTH)


def feature(payload: bytes) -> str:
    """Mean, standard deviation and a 16-bin histogram of the samples in thousandths, all in whole numbers."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, values = len(x), np.arange(256)
    total, squares = int(counts @ values), int(counts @ values**2)
    spread = np.sqrt((squares * n - total * total) / n**2)
    bins = counts.reshape(16, 16).sum(1) * 1000 // n
    return f"{total * 1000 // n}:{int(spread * 1000)}:" + ",".join(map(str, bins.tolist()))


# ---- archives -----------------------------------------------------------------------------------------------------


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def write_shards(path: str, id_col: str, text_col: str):
    """For mapInArrow: write a partition's texts as one shard; returns (shard, members, bytes)."""

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = opened(path)
        name, draft = f"shard-{TaskContext.get().partitionId():07d}.arc", f"draft-{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        entries, at = [], 0
        with fs.open_output_stream(f"{folder}/{draft}") as out:
            for batch in batches:
                for i, text in zip(batch.column(id_col).cast(pa.int64()), batch.column(text_col).cast(pa.binary()), strict=True):
                    text = text.as_py() or b""
                    member = struct.pack("<q", len(text)) + to_png(padded(text))
                    entries.append(struct.pack(_ENTRY, i.as_py() if i.is_valid else _NULL, at, len(member), zlib.crc32(member)))
                    out.write(member)
                    at += len(member)
            out.write(b"".join(entries))
            out.write(struct.pack(_FOOTER, at, len(entries), _MARK))
        if fs.get_file_info(f"{folder}/{name}").type != pa.fs.FileType.NotFound:
            fs.delete_file(f"{folder}/{name}")  # of an attempt that was lost after its rename; the bytes are the same
        fs.move(f"{folder}/{draft}", f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(entries)], pa.int64()), pa.array([at], pa.int64())], ["shard", "members", "bytes"])

    return write


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[ByteRange]:
        """By sizes alone; indexes are read by the tasks."""
        fs, folder = opened(self.path)
        shards = sorted((f.path, f.size) for f in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith("shard-"))
        return [ByteRange(p, a, min(a + self.step, size)) for p, size in shards for a in range(0, size, self.step)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(part.path) as shard:
            size = shard.size()
            where, members, mark = struct.unpack(_FOOTER, shard.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER)))
            if mark != _MARK:
                raise ValueError(f"{part.path}: no archive")
            if part.start >= where:
                return
            # offsets rise, so the range's part of the index can be found by halving
            first, last = (self.seek(shard, where, members, x) for x in (part.start, part.end))
            rows, total = [], 0
            for a in range(first, last, 4096):
                index = shard.read_at(min(last - a, 4096) * struct.calcsize(_ENTRY), where + a * struct.calcsize(_ENTRY))
                for entry in struct.iter_unpack(_ENTRY, index):
                    rows.append(self.member(fs, shard, part.path, entry))
                    total += len(rows[-1][2] or b"")
                    if total >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, total = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def seek(shard, where: int, members: int, offset: int) -> int:
        """The first member that begins at offset or later."""
        lo, hi = 0, members
        while lo < hi:
            mid = (lo + hi) // 2
            if struct.unpack(_ENTRY, shard.read_at(struct.calcsize(_ENTRY), where + mid * struct.calcsize(_ENTRY)))[1] < offset:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def member(self, fs, shard, path: str, entry: tuple) -> tuple:
        """One member; after a failure the shard is opened anew for it. Its error is a value of its row."""
        i, offset, size, crc = entry
        for attempt in range(self.attempts):
            try:
                data = shard.read_at(size, offset) if not attempt else fs.open_input_file(path).read_at(size, offset)
                if zlib.crc32(data) != crc:
                    raise ValueError("wrong checksum")
                return (i, struct.unpack_from("<q", data)[0], data[8:], from_png(data[8:]), None)
            except (OSError, ValueError, zlib.error, struct.error) as e:
                error = f"{path} at {offset}: {e}"
                time.sleep(0.05 * attempt)
        return (i, None, None, None, error)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, media, payloads, errors = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([None if i == _NULL else i for i in ids], pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], ["id", "n_bytes", "media", "payload", "error"])


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder); options rangeBytes and attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id long, n_bytes long, media binary, payload binary, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each text as a member of an archive in folder, which every executor must reach (file, hdfs, s3, gs).

    Ids are whole numbers (ValueError else); a null id stays null. Null text is empty; texts of any length are stored
    whole; repeated rows are members each. Other columns don't matter, whatever their names. An empty table leaves no shard.
    """
    integral(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows.mapInArrow(write_shards(folder, "id", "text"), "shard string, members long, bytes long").write.format("noop").mode("overwrite").save()


def read_media(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, attempts: int = ATTEMPTS) -> DataFrame:
    """An archive's members: id, n_bytes (of the text), media (the PNG), payload (its samples), error (null if read).

    A member that can't be read or decoded after `attempts` trials has null media and payload and its error; others
    are not touched by it.
    """
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", str(range_bytes)).option("attempts", str(attempts)).load(folder)


def with_features(media: DataFrame, strict: bool = False) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature; drops the bytes. A member
    that could not be read keeps its error and has null values; with strict it fails the job instead."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if strict and (lost := batch.column("error").drop_null()):
                raise RuntimeError(f"members that can't be read: {lost.to_pylist()[:3]}")
            rows = []
            for payload, stored in zip(batch.column("payload"), batch.column("media"), strict=True):
                p, m = payload.as_py(), stored.as_py()
                rows.append((None,) * 6 if p is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)), batch.column("error")], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    return media.mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    store_media(docs, folder)
    return with_features(read_media(spark, folder), strict=True).withColumnRenamed("id", "doc_id")
