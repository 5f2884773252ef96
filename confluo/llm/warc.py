"""WARC archives: writing with chunked, segmented records and revisits; reading with reassembly.

Semantics
---------
* One record a row. The payload (null reads as empty) is framed as an HTTP
  response with chunked transfer encoding; a block of more than
  ``segment_bytes`` is cut into a first record and ``continuation`` records that
  name its identifier as origin, numbered from 1; the last one states the total length.
* Rows with equal payloads of at least ``revisit_bytes`` bytes share one ``response``, that of
  the largest page_id; the others become ``revisit`` records without payload.
* Reading groups segments by origin, orders them by number, checks that none is
  missing or double and that the lengths add up to the stated total, then decodes the
  chunk framing. What does not add up gives ``error`` and no payload instead
  of failing the job; so does an archive that is cut short or damaged: its error row has no more
  than the headers that could be read, and reading goes on at the next gzip member.

Edge cases: a page_id that is no integer column is refused with ValueError; a very long page is one
record in segments, held whole when it is written and when it is put together; null url is left out of the header; a null page_id is never the largest, so
it revisits an equal payload with an id, and is a response when there is none; rows that agree in the largest page_id are
all responses; an empty table gives no archives and an empty result; extra
columns of the input are not stored, whatever their names.

Archives are gzip members per record, in files of about ``roll_bytes``, below the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import files
from confluo.llm.names import integer_id
from confluo.plans.shared import materialize

VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id long, url string, type string, digest string, origin string, number int, total long, block binary, refers_to long, error string"
RECORD_ARROW = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("refers_to", pa.int64()), ("error", pa.string())]
)
PIECE = 1 << 16
GZIP = b"\x1f\x8b\x08"


def chunked(payload: bytes, chunk: int = 4096) -> bytes:
    """HTTP chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), chunk):
        piece = payload[k : k + chunk]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are skipped. ValueError when malformed."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(framed[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP response block, decoded."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in headers if v is not None] + [b"Content-Length: %d" % len(block)]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def records_of(page_id: int | None, url: str | None, payload: bytes, first: int | None, segment: int, sha1: bytes | None = None) -> Iterator[bytes]:
    """The records of one row; ``first`` is the page that a revisit refers to, ``sha1`` the digest of the payload."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    digest = "sha1:" + base64.b32encode(sha1 or hashlib.sha1(payload).digest()).decode()
    url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Target-URI", url), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Payload-Digest", digest), ("X-Page-Id", page_id)]
    if first is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", first)], HTTP)
        return
    block = HTTP + chunked(payload)
    pieces = [block[k : k + segment] for k in range(0, len(block), segment)]
    for k, piece in enumerate(pieces, 1):
        kind = [("WARC-Type", "response"), ("WARC-Record-ID", name)]
        if k > 1:
            kind = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", name)]
        cut = [("WARC-Segment-Number", k if len(pieces) > 1 else None), ("WARC-Segment-Total-Length", len(block) if k == len(pieces) > 1 else None)]
        yield record([*kind, *(common if k == 1 else common[:2]), *cut], piece)


def _write(folder: str, segment: int, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, []

        def close():
            if held:
                uri = f"{folder}/{files.attempt_name('pages', '.warc.gz')}"
                files.write(uri, b"".join(held))
                done.append(uri)

        for batch in batches:
            for page, url, payload, first, sha1 in zip(*(batch.column(k) for k in range(5)), strict=True):
                for data in records_of(page.as_py(), url.as_py(), payload.as_py() or b"", first.as_py(), segment, bytes.fromhex(sha1.as_py())):
                    held.append(data)
                    size += len(data)
                if size >= roll:
                    close()
                    held, size = [], 0
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    return run


def write_archives(pages: DataFrame, revisit_bytes: int = 1000, segment_bytes: int = 16384, roll_bytes: int = 16 << 20) -> DataFrame:
    """Write ``(page_id, url, html)`` as archives; returns the archives' names, one row each."""
    integer_id(pages, "page_id")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
        .where(F.octet_length("payload") >= revisit_bytes)
        .groupBy(F.sha1("payload").alias("_digest"))
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and first is not null")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # a revisit carries no payload to the writer
    marked = rows.join(first, rows.digest == F.col("_digest"), "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), F.when(again, F.col("first")).alias("first"), "digest"
    )
    folder = files.folder(pages.sparkSession, "warc")
    return materialize(marked.mapInArrow(_write(folder, segment_bytes, roll_bytes), "archive string"), "archives")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of every record; ValueError at the first damage."""
    for headers, block, error in scan(io.BytesIO(data)):
        if error is not None:
            raise ValueError(error)
        yield headers, block


def scan(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, error) of every record of an archive of gzip members or of a plain one.

    Holds one record and one piece of the stream. Damage gives an entry with ``error`` and the
    scan goes on at the next gzip member that it can make out.
    """
    data = stream.read(PIECE)
    while data:
        while len(data) < len(GZIP) and (more := stream.read(PIECE)):  # a member may begin at the very end of a piece
            data += more
        if data[:2] != GZIP[:2]:
            yield from _plain(data, stream)
            return
        member, parts, skip = zlib.decompressobj(31), [], 2
        try:
            parts.append(member.decompress(data))
            while not member.eof:
                more = stream.read(PIECE)
                if not more:
                    raise ValueError("archive is cut short")
                data, skip = more, 0
                parts.append(member.decompress(data))
            data = member.unused_data or stream.read(PIECE)
        except (zlib.error, ValueError) as e:
            yield {}, b"", str(e)
            at = data.find(GZIP, skip)
            while at < 0 and (more := stream.read(PIECE)):
                data = data[max(skip, len(data) - 2) :] + more
                at, skip = data.find(GZIP), 0
            data = data[at:] if at >= 0 else b""
            continue
        yield from _plain(b"".join(parts), io.BytesIO())


def _plain(data: bytes, stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Records of ``data`` and what follows it in the stream; the first damage ends it."""
    while True:
        data = data.lstrip(b"\r\n")
        end = data.find(b"\r\n\r\n")
        while end < 0:
            more = stream.read(PIECE)
            if not more:
                if data:
                    yield {}, b"", "record header is cut short"
                return
            data = (data + more).lstrip(b"\r\n")  # what is left of the gap between records
            end = data.find(b"\r\n\r\n")
        lines = data[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        if not lines[0].startswith("WARC/") or not re.fullmatch("[0-9]+", length):
            yield headers, b"", "record header without WARC version or content length"
            return
        size = int(length)
        parts, have = [data[end + 4 : end + 4 + size]], len(data) - end - 4
        rest = data[end + 4 + size :]
        while have < size:
            more = stream.read(PIECE)
            if not more:
                yield headers, b"", "record is cut short"
                return
            parts.append(more[: size - have])
            rest, have = more[size - have :], have + len(more)
        yield headers, b"".join(parts), None
        data = rest


def _digest(value: str | None) -> str | None:
    """Bare lower-case hex of a SHA-1 digest in base 32 or hex; digests of other kinds are not read."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return text.lower() if re.fullmatch("[0-9a-fA-F]{40}", text) else base64.b32decode(text).hex()


def _row(headers: dict[str, str], block: bytes, error: str | None, uri: str) -> dict:
    row: dict = {c: headers.get(h) for c, h in (("record_id", "warc-record-id"), ("url", "warc-target-uri"), ("type", "warc-type"))}
    row["origin"] = headers.get("warc-segment-origin-id") or row["record_id"]
    try:
        if error is not None:
            raise ValueError(error)
        for c, h in (("page_id", "x-page-id"), ("refers_to", "x-refers-to-page-id"), ("number", "warc-segment-number"), ("total", "warc-segment-total-length")):
            row[c] = int(headers[h]) if h in headers else None
        row |= {"digest": _digest(headers.get("warc-payload-digest")), "block": block}
    except ValueError as e:  # what is damaged stands by itself, not among the segments of a record
        row |= {"error": f"{uri}: {e}", "number": None}
    return row


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows, size = [], 0
            with files.opened(uri) as stream:
                for headers, block, error in scan(stream):
                    rows.append(_row(headers, block, error, uri))
                    size += len(block) + 1000
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)


def assembled(segments: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The block of numbered segments; ValueError unless they are 1..n and add up to ``total``."""
    segments = sorted(segments)
    if [n for n, _ in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments are missing or double")
    block = b"".join(b for _, b in segments)
    if len(block) != total:
        raise ValueError(f"segments have {len(block)} bytes, total length is {total}")
    return block


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last three columns (segments, total, error) to (payload, error); a response has the digest of what was read back."""
    for batch in batches:
        payloads, errors, digests = [], [], batch.column("digest").to_pylist()
        for k, (kind, parts, total, error) in enumerate(zip(batch.column("type").to_pylist(), batch.column("segments"), batch.column("total").to_pylist(), batch.column("error").to_pylist(), strict=True)):
            payload = None
            if error is None and kind != "revisit":
                try:
                    own = [(p["number"], p["block"]) for p in parts.as_py()]
                    block = own[0][1] if len(own) == 1 and own[0][0] is None else assembled([(n or 1, b) for n, b in own], total)
                    payload = payload_of(block) if kind in ("response", None) else block
                    stored, digests[k] = digests[k], hashlib.sha1(payload).hexdigest()
                    if stored is not None and stored != digests[k]:
                        error = f"payload has digest {digests[k]}, its header says {stored}"
                except ValueError as e:
                    error = str(e)
            payloads.append(payload)
            errors.append(error)
        at = batch.schema.get_field_index("digest")
        batch = batch.set_column(at, batch.schema.field(at), pa.array(digests, pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], [*batch.schema.names[:-3], "payload", "error"])


def read_archives(archives: DataFrame) -> DataFrame:
    """``(record_id, page_id, url, type, digest, refers_to, payload, error)`` of the archives named in column ``archive``.

    Only records in several segments are shuffled, by origin; a group is one record.
    """
    spark: SparkSession = archives.sparkSession
    spread = archives.select("archive").repartition(max(1, spark.sparkContext.defaultParallelism * 4))
    found = spread.mapInArrow(_read, RECORD)
    part = F.struct("number", "block")
    names = ["record_id", "page_id", "url", "type", "digest", "refers_to"]
    whole = found.where("number is null").select(*names, F.array(part).alias("segments"), "total", "error")
    pieces = found.where("number is not null")
    lead = F.col("type") != "continuation"
    joined = (
        pieces.groupBy("origin")
        .agg(
            *[F.max(F.when(lead, F.col(c))).alias(c) for c in names[1:]],
            F.collect_list(part).alias("segments"),
            F.max("total").alias("total"),
            F.max("error").alias("error"),
        )
        .select(F.col("origin").alias("record_id"), *names[1:], "segments", "total", "error")
    )
    return whole.unionByName(joined).mapInArrow(_decode, "record_id string, page_id long, url string, type string, digest string, refers_to long, payload binary, error string")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes``: revisits have that of the response that they name.

    ``refers_to`` is what the archive's revisit record says; it is an ``error`` when the largest
    page_id among the responses with its digest is another or there is none.
    """
    # the archives are parsed once; what is written holds no payload
    records = materialize(records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload"), "records")
    again = F.coalesce(F.col("type"), F.lit("")) == "revisit"
    wanted, rest = records.where(again), records.where(~again)
    first = rest.where("error is null").groupBy(F.col("digest").alias("_digest")).agg(F.max("page_id").alias("_first"), F.max("payload_bytes").alias("_bytes"))
    lost = F.when(~F.col("refers_to").eqNullSafe(F.col("_first")), F.lit("no response with this digest has the page that the revisit refers to"))
    named = wanted.join(first, wanted.digest == F.col("_digest"), "left").select(
        *[c for c in records.columns if c not in ("payload_bytes", "error")], F.col("_bytes").alias("payload_bytes"), F.coalesce("error", lost).alias("error")
    )
    return rest.unionByName(named)
