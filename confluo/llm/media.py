"""Media columns: lossless images in archives, and a data source that reads them by byte range.

Semantics
---------
* A document's payload is its text in UTF-8 (null reads as empty), padded with zero
  bytes to a positive multiple of 64. It is stored as an 8-bit greyscale PNG of
  width 64, which also names the unpadded length. Equal texts give equal files.
* Images lie uncompressed in ZIP archives of about ``roll_bytes``.
* The data source ``media_archive`` plans byte ranges over the archives of a
  folder. A task reads the central directory of its archive and takes the
  members whose header begins in its range; each is read by offset and length,
  checked by CRC-32, and retried by itself. A member that keeps failing gives a row with
  ``error`` and no media; its neighbours are not affected. An archive without readable
  directory gives one row with ``error`` and nothing else.
* Batches of about ``batch_bytes`` leave through Arrow, so memory is bounded by a batch
  or by the largest member.

Edge cases: a null doc_id is kept as null, a doc_id that is no integer column is refused with
ValueError; rows that agree are stored twice; ties do not arise; an empty table gives an
empty folder and an empty result; extra columns are not stored, whatever their names; a very long text is one
member, held whole while it is written or decoded (about four times its bytes); an image that cannot be
decoded gives a row with ``error``.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from confluo.llm import files
from confluo.llm.names import integer_id

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_ARCHIVES"
SCHEMA = "archive string, member string, offset long, media binary, error string"
ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """8-bit greyscale PNG of the payload's bytes as samples, with the unpadded length as text."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate((np.zeros((len(samples), 1), np.uint8), samples), axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """Samples and stated length; ValueError when damaged or not of this kind."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, n_bytes, size = 8, [], -1, (0, 0)
    while at < len(media):
        if len(media) < at + 12 or len(media) < at + 12 + struct.unpack(">I", media[at : at + 4])[0]:
            raise ValueError("chunk is cut short")
        length, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + length]
        if struct.unpack(">I", media[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + data):
            raise ValueError("chunk checksum differs")
        if kind == b"IHDR":
            size = struct.unpack(">II", data[:8])
            if size[0] != WIDTH or not size[1] or data[8:] != b"\x08\0\0\0\0":
                raise ValueError(f"not 8-bit greyscale of width {WIDTH}")
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"tEXt" and data.startswith(b"Bytes\0"):
            n_bytes = int(data[6:])
        at += 12 + length
    if n_bytes < 0 or not size[0]:
        raise ValueError("no size")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered scan lines")
    return np.ascontiguousarray(lines[:, 1:]), n_bytes


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of which columns are brighter than the mean."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    share = counts[counts > 0] / samples.size
    columns = samples.sum(axis=0, dtype=np.int64)
    bits = int("".join("1" if c * WIDTH > columns.sum() else "0" for c in columns), 2)
    return f"mean={samples.mean():.4f};sd={samples.std():.4f};bits={abs(float(-(share * np.log2(share)).sum())):.4f};hash={bits:016x}"


def _store(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        held: io.BytesIO | None = None
        archive: zipfile.ZipFile | None = None
        n = 0

        def close():
            archive.close()
            name = files.attempt_name("media", ".zip")
            files.write(f"{folder}/{name}", held.getvalue())
            done.append((name, held.tell()))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    held = io.BytesIO()
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                raw = (text.as_py() or "").encode()
                archive.writestr(zipfile.ZipInfo(f"{n}/{'' if doc is None else doc}.png"), encode_png(padded(raw), len(raw)))
                n += 1
                if held.tell() >= roll:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["name", "size"])

    return run


def store(docs: DataFrame, roll_bytes: int = 32 << 20) -> str:
    """Write ``(doc_id, text)`` as archives of images; returns the folder.

    One job writes all archives side by side. The names and sizes of those that finished tasks wrote
    (one row for every ``roll_bytes``, not one per document) are a Parquet table
    in the folder, so files of repeated tasks are not read.
    """
    integer_id(docs, "doc_id")
    folder = files.folder(docs.sparkSession, "media")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(_store(folder, roll_bytes), "name string, size long").write.parquet(f"{folder}/{MANIFEST}")
    return folder


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        super().__init__((archive, start, end))
        self.archive, self.start, self.end = archive, start, end


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options split_bytes, batch_bytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.split = int(options.get("split_bytes", 16 << 20))
        self.batch = int(options.get("batch_bytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[Range]:
        system, path = files.file_system(self.folder)
        listed = [f.path for f in system.get_file_info(pafs.FileSelector(f"{path}/{MANIFEST}", allow_not_found=True)) if f.base_name.endswith(".parquet")]
        if listed:
            tables = [pq.read_table(system.open_input_file(x)) for x in listed]
            found = [pair for t in tables for pair in zip(t.column("name").to_pylist(), t.column("size").to_pylist(), strict=True)]
        else:
            found = [(f.base_name, f.size) for f in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".zip")]
        return [Range(f"{self.folder}/{x}", a, min(a + self.split, size)) for x, size in sorted(found) for a in range(0, size, self.split)]

    def _member(self, uri: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its own offset, in a connection of its own."""
        head = files.read(uri, info.header_offset, 30)
        if head[:4] != b"PK\3\4":
            raise OSError("no member header at this offset")
        skip = sum(struct.unpack("<HH", head[26:30]))
        data = files.read(uri, info.header_offset + 30 + skip, info.compress_size)
        if zlib.crc32(data) != info.CRC:
            raise OSError("member checksum differs")
        return data

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder has no range
            return
        system, path = files.file_system(partition.archive)
        rows, size = [], 0
        with system.open_input_file(path) as f:
            try:
                members = [m for m in zipfile.ZipFile(f).infolist() if partition.start <= m.header_offset < partition.end]
            except (zipfile.BadZipFile, OSError, ValueError, struct.error) as e:  # said once an archive
                members = []
                if not partition.start:
                    rows.append({"archive": partition.archive, "member": None, "offset": None, "media": None, "error": f"no central directory: {e}"})
            for info in sorted(members, key=lambda m: m.header_offset):
                media, error = None, None
                try:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    f.seek(info.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                    media = f.read(info.compress_size)
                    if head[:4] != b"PK\3\4" or zlib.crc32(media) != info.CRC:
                        raise OSError("member checksum differs")
                except (OSError, struct.error) as first:
                    media, error = None, str(first)
                    for _ in range(self.retries):
                        try:
                            media, error = self._member(partition.archive, info), None
                            break
                        except (OSError, struct.error) as again:
                            error = str(again)
                rows.append({"archive": partition.archive, "member": info.filename, "offset": info.header_offset, "media": media, "error": error})
                size += len(media or b"")
                if size >= self.batch:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, ARROW)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}
    for batch in batches:
        out = []
        for member, media, error in zip(batch.column("member").to_pylist(), batch.column("media"), batch.column("error").to_pylist(), strict=True):
            row: dict = {"doc_id": None, "error": error}
            media = media.as_py()
            if member is not None:
                doc = member.partition("/")[2].removesuffix(".png")
                row["doc_id"] = int(doc) if re.fullmatch(r"-?[0-9]+", doc) else None
            if media is not None:
                try:
                    samples, n = decode_png(media)
                    payload = samples.tobytes()
                    row |= {"n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}
                    row |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(samples)}
                except (ValueError, zlib.error, struct.error) as e:
                    row["error"] = str(e)
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, pa.schema(list(kinds.items())))


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Members of the archives in a folder: ``(archive, member, offset, media, error)``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


def features(media: DataFrame) -> DataFrame:
    """Decode images of ``load`` and compute digests and features."""
    return media.mapInArrow(
        _features,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string",
    )
