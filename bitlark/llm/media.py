"""Media columns: payloads as PNG members of tar archives, read by a custom Spark data source.

``pack`` stores each text's UTF-8 bytes, filled with byte 255 to a positive multiple of 576, as the 8-bit grey samples of a
lossless PNG, 576 samples a row. A task streams its members into one tar archive in a shared folder, beside an index (an Arrow file) of
offset, doc_id and length of its members, so an id may hold any characters and be of any length; a manifest lists the archives of the tasks that Spark counted, so files of lost or repeated attempts are never read.

``ArchiveSource`` (format ``bitlark_archive``) plans partitions as byte ranges over the archives of a folder: a range owns the members
that begin in it. A reader finds its members in the index, streams them as Arrow batches of bounded size and retries each member alone, by its
offset and with a fresh handle, if its header, checksum or length is wrong or the store fails; samples are decoded once, by ``features``. After ``retries`` a member fails
the read, or with ``mode=permissive`` comes as a row with ``error`` set and no media.

Scale: no shuffle; memory is a batch and a member; what the driver sees is a row for each archive. The archives stay until the caller removes the folder.

Edge cases: a null or empty text is one row of 576 bytes 255; equal texts give equal values; repeated rows are members of their own; a null
doc_id stays null; an empty table gives no archive and no row; texts of any length are stored whole. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sources.files import opened
from .common import work_path

UNIT = 576
# Fixed value: the signature of the format.
PNG = b"\x89PNG\r\n\x1a\n"
BATCH_BYTES = 4 << 20
RANGE_BYTES = 16 << 20
INDEX = pa.schema([("offset", pa.int64()), ("doc_id", pa.string()), ("n_bytes", pa.int64())])
MEMBER = "doc_id string, n_bytes long, archive string, offset long, media binary, error string"


class MediaError(Exception):
    pass


# -- payloads ------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def verified(data: bytes) -> tuple[tuple, bytes]:
    """Header and packed samples of a PNG whose structure and checksums are right; any damage is refused."""
    if data[:8] != PNG:
        raise MediaError("not a PNG")
    at, head, body, kind = 8, None, [], b""
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) != n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise MediaError("checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if head is None or head[0] != UNIT or head[2:] != (8, 0, 0, 0, 0) or kind != b"IEND":
        raise MediaError("unknown layout")
    return head, b"".join(body)


def from_png(data: bytes) -> bytes:
    """The samples."""
    head, body = verified(data)
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(head[1], UNIT + 1)
    if lines[:, 0].any():
        raise MediaError("unknown filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """An 8 x 8 average hash of the mean 24 x 24 tile, and mean and deviation of all samples."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    tile = x.mean(axis=0).reshape(8, 3, 8, 3).mean(axis=(1, 3))
    bits = int("".join("1" if b else "0" for b in (tile > tile.mean()).ravel()), 2)
    return f"{bits:016x}-{x.mean():.3f}-{x.std():.3f}"


# -- archives --------------------------------------------------------------------


def pack(docs: DataFrame, folder: str) -> int:
    """Writes the archives of ``docs`` (doc_id, text) below ``folder`` and their manifest; the number of members."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)

    def run(batches):
        name = f"part-{uuid.uuid4().hex}"
        system, path = opened(folder)
        out, index, at = None, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}.tar")
                data = (text or "").encode("utf-8", "surrogatepass")
                media = to_png(padded(data))
                info = tarfile.TarInfo(f"{len(index):012d}.png")
                info.size = len(media)
                block = info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % 512)
                out.write(block)
                index.append((at, doc, len(data)))
                at += len(block)
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()
            with system.open_output_stream(f"{path}/{name}.idx") as f, pa.ipc.new_file(f, INDEX) as w:
                w.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*index, strict=True), INDEX.types, strict=True)], schema=INDEX))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([at], pa.int64())], names=["name", "members", "bytes"])

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "name string, members long, bytes long").collect()
    with system.open_output_stream(f"{path}/manifest.json") as f:  # a row for each task
        f.write(json.dumps([list(r) for r in sorted(parts)]).encode())
    return sum(r.members for r in parts)


class Range(InputPartition):
    def __init__(self, archive: str, start: int, stop: int) -> None:
        self.archive, self.start, self.stop = archive, start, stop


class ArchiveSource(DataSource):
    """Options: path (folder), range_bytes, retries, mode (failfast or permissive)."""

    @classmethod
    def name(cls) -> str:
        return "bitlark_archive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))
        self.permissive = options.get("mode", "failfast") == "permissive"

    def partitions(self) -> list[Range]:
        system, path = opened(self.folder)
        with system.open_input_stream(f"{path}/manifest.json") as f:
            parts = json.loads(f.read())
        return [Range(name, at, min(at + self.range_bytes, size)) for name, _, size in parts for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range):
        if not partition.archive:
            return
        system, path = opened(self.folder)
        with system.open_input_file(f"{path}/{partition.archive}.idx") as f:
            index = pa.ipc.open_file(f).read_all()
        rows, size = [], 0
        at = index["offset"].to_numpy()
        first, stop = np.searchsorted(at, (partition.start, partition.stop))  # offsets ascend
        handle = None
        for entry in index.slice(first, stop - first).to_pylist():
            row, handle = self._member(system, f"{path}/{partition.archive}.tar", partition.archive, entry, handle)
            rows.append(row)
            size += len(row[4] or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _member(self, system, path: str, archive: str, entry: dict, handle):
        """One member, tried on its own; a fresh handle after each failure."""
        at = entry["offset"]
        for attempt in range(self.retries + 1):
            try:
                handle = handle or system.open_input_file(path)
                info = tarfile.TarInfo.frombuf(handle.read_at(512, at), "utf-8", "strict")
                media = handle.read_at(info.size, at + 512)
                if len(media) != info.size:
                    raise MediaError("short read")
                verified(media)
                return (entry["doc_id"], entry["n_bytes"], archive, at, media, None), handle
            except (OSError, tarfile.TarError, MediaError, ValueError, struct.error, zlib.error) as e:
                handle, error = None, f"{type(e).__name__}: {e}"
                if attempt < self.retries:
                    time.sleep(0.05 * 2**attempt)
        if not self.permissive:
            raise MediaError(f"{archive} at {at}: {error}")
        return (entry["doc_id"], entry["n_bytes"], archive, at, None, error), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "archive", "offset", "media", "error"])


def members(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The members of an archive folder, a row each (``MEMBER``)."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("bitlark_archive").options(path=folder, **options).load()


FEATURES = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Payload and media facts of members; their bytes are decoded batch by batch."""

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(6)]
            for data in batch.column(2).to_pylist():
                payload = from_png(data)
                facts = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload))
                for c, x in zip(cols, facts, strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[f.split()[0] for f in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    spark = docs.sparkSession
    folder = work_path(spark, "media")
    pack(docs.select("doc_id", "text"), folder)
    found = features(members(spark, folder))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
