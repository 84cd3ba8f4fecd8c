"""Media columns (8): a Spark data source for archives of media members.

`ArchiveDataSource` ("media_archive") writes zip archives of about 256 MB into a directory, each task its
own, and lists the committed archives in a manifest, so files of failed or repeated attempts never count.
Reading plans byte-range partitions over the archives: a partition owns the members whose local
header begins in its range, finds them in the archive's directory, and streams them in Arrow
batches. Every member is read on its own, by offset, checked against its CRC, and when that fails read
again (`retries`) through a new handle. Files are reached through pyarrow's file systems by URI.

A document's payload is stored as an 8-bit greyscale PNG image of rows of 576 samples.

Defined results: null text is the empty text (one row of padding); repeated rows are members of
their own; equal texts give equal values; very long texts are one member each; an empty table gives no
members; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from graphloom.llm.common import drop_path, materialize, shared_dir, small_batches

ROW = 576
PAD = 255
MANIFEST = "_members.json"
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """Payload padded to a positive multiple of ROW, and the bytes of the text."""
    data = (text or "").encode("utf-8")
    return data + bytes([PAD]) * (-len(data) % ROW if data else ROW), len(data)


def to_png(payload: bytes) -> bytes:
    """8-bit greyscale image, ROW samples wide, each scan line unfiltered."""
    lines = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    body = np.zeros((len(lines), ROW + 1), dtype=np.uint8)
    body[:, 1:] = lines
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(body.tobytes(), 4)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png() wrote; raises on damage."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, width = 8, [], 0
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].tobytes()


def features_of(payload: bytes) -> str:
    """Image size and the mean, standard deviation and entropy of the samples."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    used = share[share > 0]
    return f"{ROW}x{len(samples) // ROW};mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(used * np.log2(used)).sum():.4f}"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


class ByteRange(InputPartition):
    def __init__(self, name: str, begin: int, end: int):
        self.name, self.begin, self.end = name, begin, end


class Written(WriterCommitMessage):
    def __init__(self, archives: list[tuple[str, int, int]]):
        self.archives = archives  # name, size, members


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.archive_bytes = options["path"], int(options.get("archive_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _fs(self.path)
        store.create_dir(root, recursive=True)
        task, done = TaskContext.get(), []
        rows = ((i, m) for b in iterator for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        row = next(rows, None)
        while row is not None:  # one archive
            name, members = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.zip", 0
            with store.open_output_stream(f"{root}/{name}") as f:
                out = _Counting(f)
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    while row is not None and (not members or out.at < self.archive_bytes):
                        archive.writestr(zipfile.ZipInfo(f"{members}_{'' if row[0] is None else row[0]}.png"), row[1])
                        members, row = members + 1, next(rows, None)
            done.append((name, out.at, members))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _fs(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _fs(self.path)
        for m in messages:
            for name, *_ in m.archives if m else ():
                store.delete_file(f"{root}/{name}")


class _Counting(io.RawIOBase):
    """Write-only stream for zipfile that knows its position."""

    def __init__(self, f):
        self.f, self.at = f, 0

    def write(self, data) -> int:
        self.f.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def writable(self) -> bool:
        return True

    def flush(self) -> None:
        pass


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("range_bytes", 16 << 20))
        self.batch_bytes, self.retries = int(options.get("batch_bytes", 8 << 20)), int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        store, root = _fs(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        return [ByteRange(name, at, min(at + self.range_bytes, size)) for name, size, _ in files for at in range(0, size, self.range_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives, so no ranges
            return
        store, root = _fs(self.path)
        name = f"{root}/{partition.name}"
        with store.open_input_file(name) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.begin <= m.header_offset < partition.end]
        ids, media, held = [], [], 0
        source = Archive(store, name)
        try:
            for member in members:
                data = self._member(source, member)
                doc_id = member.filename.partition("_")[2].removesuffix(".png")
                ids.append(int(doc_id) if doc_id else None)
                media.append(data)
                held += len(data)
                if held >= self.batch_bytes:
                    yield _batch(ids, media)
                    ids, media, held = [], [], 0
        finally:
            source.close()
        if ids:
            yield _batch(ids, media)

    def _member(self, source: Archive, member: zipfile.ZipInfo) -> bytes:
        for attempt in range(self.retries + 1):
            try:
                return source.read(member)
            except (OSError, ValueError):
                if attempt == self.retries:
                    raise
                source.close()  # the next attempt opens it anew
        raise AssertionError


class Archive:
    """Members of an archive by offset: a local header of 30 bytes, a name, extra bytes, the data."""

    def __init__(self, store, name: str):
        self.store, self.name, self.file = store, name, None

    def read(self, member: zipfile.ZipInfo) -> bytes:
        if self.file is None:
            self.file = self.store.open_input_file(self.name)
        head = self.file.read_at(30, member.header_offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {member.header_offset} of {self.name}")
        name, extra = struct.unpack_from("<HH", head, 26)
        data = self.file.read_at(member.compress_size, member.header_offset + 30 + name + extra)
        if zlib.crc32(data) != member.CRC:
            raise ValueError(f"damaged member at {member.header_offset} of {self.name}")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _batch(ids: list, media: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])


class ArchiveDataSource(DataSource):
    """options: path, archive_bytes (from which on a task begins another archive), range_bytes (of a partition), batch_bytes (of an Arrow batch), retries (of a member)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options))


def write_archives(docs: DataFrame, path: str) -> None:
    """Store the payload of every whole text as a member."""
    small_batches(docs.sparkSession)
    docs.sparkSession.dataSource.register(ArchiveDataSource)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "media": [to_png(payload_of(t)[0]) for t in b["text"]]})

    docs.select("doc_id", "text").mapInPandas(run, "doc_id long, media binary").write.format("media_archive").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveDataSource)
    return spark.read.format("media_archive").options(**options).load(path)


def media_features(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write archives, read them back and describe what was read. Without a path they are removed afterwards."""
    spark = docs.sparkSession
    own = None if path else shared_dir(spark)
    write_archives(docs, path or own)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for media in map(bytes, b["media"]):
                payload = from_png(media)
                # Byte 255 is in no UTF-8 text, so the padding ends where the text does.
                rows.append((len(payload.rstrip(bytes([PAD]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features_of(payload)))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64"))
            yield out

    found = read_archives(spark, path or own).mapInPandas(run, schema)
    if own:
        found = materialize(found)
        drop_path(spark, own)
    return found
