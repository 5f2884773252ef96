"""Archives and token files: round trips, damage, boundaries and awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from confluo.llm import files, media, tokens, warc
from confluo.llm.queries import PATTERN, TOKENIZERS, VOCABULARY


def test_chunked_framing_round_trip():
    for n in (0, 1, 4095, 4096, 4097, 20000):
        data = bytes(random.Random(n).randbytes(n))
        assert warc.dechunked(warc.chunked(data)) == data
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc", b"zz\r\nabc\r\n0\r\n\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def test_segments_are_verified():
    assert warc.assembled([(2, b"b"), (1, b"a")], 2) == b"ab"
    for parts, total in (([(1, b"a"), (3, b"c")], 2), ([(1, b"a"), (1, b"a")], 2), ([(1, b"a"), (2, b"b")], 3), ([(2, b"b")], 1)):
        with pytest.raises(ValueError):
            warc.assembled(parts, total)


def page_rows():
    big = "ü<p>" * 9000
    rows = [(1, "http://a", "x" * 1000), (2, "http://b\r\nX: y", "x" * 1000), (9, None, "x" * 1000), (3, "u", "y" * 999), (4, "u", "y" * 999), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big)]
    return rows + [(10, "u", "z" * 2000), (10, "u", "z" * 2000), (None, "u", "q" * 1500), (None, "u", "x" * 1000), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 3000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("type", F.lit("clash"))
    archives = warc.write_archives(df, segment_bytes=700)
    records = warc.read_archives(archives)
    assert sorted(hashlib.sha1(bytes(r.payload)).hexdigest() for r in records.where("type = 'response'").collect()) == sorted(r.digest for r in records.where("type = 'response'").collect())
    got = sorted(((r.page_id, r.type, r.payload_bytes, r.digest, r.refers_to, r.error) for r in warc.resolve_revisits(records).collect()), key=str)
    want = []
    best = {}
    for page, _, html in page_rows():
        b = (html or "").encode()
        if len(b) >= 1000 and page is not None:
            best[b] = max(best.get(b, page), page)
    for page, _, html in page_rows():
        b = (html or "").encode()
        first = best.get(b)
        revisit = first is not None and first != page
        want.append((page, "revisit" if revisit else "response", len(b), hashlib.sha1(b).hexdigest(), first if revisit else None, None))
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_lost_segment_is_an_error_not_a_crash(spark):
    body = b"k" * 5000
    records = list(warc.records_of(1, "u", body, None, 1000))
    uri = f"{files.folder(spark, 'broken')}/a.warc.gz"
    files.write(uri, b"".join(records[:2] + records[3:]))
    out = warc.read_archives(spark.createDataFrame([(uri,)], "archive string")).collect()
    assert len(out) == 1 and out[0].payload is None and "missing" in out[0].error


def test_payload_that_differs_from_its_digest_is_an_error(spark):
    records = [r for page in (1, 2) for r in warc.records_of(page, "u", b"k" * 3000, None, 1000)]
    headers, block = next(warc.parse(records[1]))
    names = {"warc-type": "WARC-Type", "warc-record-id": "WARC-Record-ID", "warc-segment-origin-id": "WARC-Segment-Origin-ID", "warc-segment-number": "WARC-Segment-Number"}
    records[1] = warc.record([(names[k], v) for k, v in headers.items() if k in names], block.replace(b"kk", b"kx", 1))
    uri = f"{files.folder(spark, 'changed')}/a.warc.gz"
    files.write(uri, b"".join(records))
    out = {r.page_id: r for r in warc.read_archives(spark.createDataFrame([(uri,)], "archive string")).collect()}
    assert len(out) == 2 and "digest" in out[1].error and out[2].error is None
    assert all(r.digest == hashlib.sha1(bytes(r.payload)).hexdigest() for r in out.values()) and out[1].digest != out[2].digest


def test_media_round_trip_and_independent_retries(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "x" * 64), (5, "é" * 5000), (5, "é" * 5000), (None, "nul\0 end\0"), (6, "y" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1))
    folder = media.store(df, roll_bytes=3000)
    out = media.features(media.load(spark, folder, split_bytes=1500, batch_bytes=2000)).collect()
    want = []
    for doc, text in rows:
        raw = (text or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((doc, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=str) == sorted(want, key=str)
    same = [r for r in out if r.doc_id == 5]
    assert same[0].media_sha256 == same[1].media_sha256 and same[0].feature == same[1].feature
    # damage one member: its row has an error, all others stay
    listing = media.load(spark, folder).where("member like '%/6.png'").first()
    data = bytearray(files.read(listing.archive))
    data[listing.offset + 60] ^= 255
    files.write(listing.archive, bytes(data))
    again = media.load(spark, folder, split_bytes=1500).collect()
    assert len(again) == len(rows) and [r.member.endswith("/6.png") for r in again if r.error] == [True]
    assert media.load(spark, media.store(df.limit(0))).count() == 0


def test_png_decoding_rejects_damage():
    samples = media.padded(b"hello")
    png = media.encode_png(samples, 5)
    back, n = media.decode_png(png)
    assert back.tobytes() == samples and n == 5
    with pytest.raises(ValueError):
        media.decode_png(png[:40] + b"?" + png[41:])


def test_separator_scan_across_blocks(spark):
    rng = np.random.default_rng(4)
    names, want = [], []
    folder = files.folder(spark, "flat")
    for k in range(4):
        lengths = rng.integers(0, 90, 60)
        if k == 3:
            lengths[10] = 5000
        ids = np.concatenate([np.concatenate((rng.integers(0, 9, n), [9])) for n in lengths]).astype("<u2")
        closed = k != 2
        if not closed:
            ids = ids[:-1]
        uri = f"{folder}/{k}.bin"
        files.write(uri, ids.tobytes())
        names.append((uri,))
        want += [(uri, i, int(n), closed or i < 59) for i, n in enumerate(lengths)]
    files.write(f"{folder}/empty.bin", b"")
    df = spark.createDataFrame([*names, (f"{folder}/empty.bin",)], "file string")
    for block, fan in ((7, 3), (64, 4), (1 << 20, 1024)):
        got = [tuple(r) for r in tokens.scan(df, 9, block, fan).collect()]
        assert sorted(got) == sorted(w for w in want if w[3] or w[2])


def test_token_counts_match_the_tokenizer(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "nul id"), (4, "<|endoftext|> is ordinary"), (4, "<|endoftext|> is ordinary"), (5, "wort " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("x"))
    with open(f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
        encoder = tokens._encoder(f.read(), PATTERN)
    got = tokens.count_tokens(df, f"{TOKENIZERS}/{VOCABULARY}", PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, len(encoder.encode_ordinary(t or ""))) for i, t in rows), key=str)
    assert tokens.count_tokens(df.limit(0), f"{TOKENIZERS}/{VOCABULARY}", PATTERN).count() == 0
