"""Token counts from flat, unindexed token files by a scan for separators.

Semantics
---------
* ``write_tokens`` encodes every text (null reads as empty) with a public
  byte-level BPE vocabulary and writes little-endian 16-bit identifiers, each document
  followed by the end-of-document identifier; nothing else is in the files. A
  manifest beside them says which document is the n-th of which file.
* ``scan`` counts the tokens of every document from the files alone: blocks of
  ``block_tokens`` are searched for separators in one vectorised comparison;
  each block reports the tokens before its first separator, the gaps between separators and
  what is left open behind the last one. A prefix scan over the blocks (within
  groups of ``fan`` blocks, then over groups) gives each block its first document's number
  and the tokens that earlier blocks left open.
* A tail without separator is a document with ``closed`` = false.

Edge cases: empty texts count 0; a null doc_id stays null, a doc_id that is no integer column is refused with
ValueError; repeated rows count each and ties do not arise; an empty
table gives no file and an empty result; extra columns are not stored, whatever their names; a very long
text is encoded whole by one task. A
single file of any size is scanned by many tasks; no window holds more than
``fan`` blocks or the groups of one file.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm import files
from confluo.llm.names import integer_id
from confluo.plans.shared import materialize

_encoders: dict[int, object] = {}


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    key = hash((ranks, pattern))
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def _write(folder: str, ranks, pattern: str, eod: int, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        uri, held, docs, size = None, [], [], 0
        end = np.array([eod], "<u2").tobytes()

        def close():
            files.write(uri, b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([uri] * len(docs), pa.string()), pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.int64())], ["file", "ordinal", "doc_id"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                uri = uri or f"{folder}/{files.attempt_name('tokens', '.bin')}"
                held += [np.asarray(encoder.encode_ordinary(text.as_py() or ""), "<u2").tobytes(), end]
                docs.append(doc)
                size += len(held[-2]) + 2
                if size >= roll:
                    yield close()
                    uri, held, docs, size = None, [], [], 0
        if uri:
            yield close()

    return run


def write_tokens(docs: DataFrame, vocabulary: str, pattern: str, eod: int = 50256, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write token files; returns the manifest ``(file, ordinal, doc_id)``."""
    integer_id(docs, "doc_id")
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file, about 1 MB
    folder = files.folder(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(_write(folder, ranks, pattern, eod, roll_bytes), "file string, ordinal long, doc_id long"), "manifest")


def _plan(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                size = files.size(uri)
                at = list(range(0, size, block_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(at), pa.string()), pa.array(range(len(at)), pa.int64()), pa.array(at, pa.int64()), pa.array([min(block_bytes, size - a) for a in at], pa.int64())], ["file", "block", "offset", "length"])

    return run


def separators(ids: np.ndarray, eod: int) -> tuple[int, int, np.ndarray, int]:
    """Separators in a block, tokens before the first, gaps between them, tokens behind the last."""
    at = np.flatnonzero(ids == eod)
    if not len(at):
        return 0, 0, at, len(ids)
    return len(at), int(at[0]), np.diff(at) - 1, len(ids) - 1 - int(at[-1])


def _search(eod: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [separators(np.frombuffer(files.read(u, o, n), "<u2"), eod) for u, o, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("file"),
                    batch.column("block"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.list_(pa.int64())),
                    pa.array([f[3] for f in found], pa.int64()),
                ],
                ["file", "block", "n", "head", "gaps", "tail"],
            )

    return run


def _prefix(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Exclusive scan: ``before`` separators and ``open`` tokens ahead of each row, ``sealed`` if a separator is among them."""
    line = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_g", F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(line))
    df = df.withColumn("_s", F.sum("tail").over(Window.partitionBy(*keys, "_g").orderBy(order)))
    return (
        df.withColumn("before", F.sum("n").over(line) - F.col("n"))
        .withColumn("open", F.coalesce(F.lag("_s").over(line), F.lit(0)))
        .withColumn("sealed", F.coalesce(F.lag("_g").over(line), F.lit(0)) > 0)
        .drop("_g", "_s")
    )


def scan(names: DataFrame, eod: int = 50256, block_tokens: int = 1 << 20, fan: int = 1024) -> DataFrame:
    """``(file, ordinal, n_tokens, closed)`` for every document of the files in column ``file``."""
    spark = names.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism * 4)
    planned = names.select("file").distinct().mapInArrow(_plan(2 * block_tokens), "file string, block long, offset long, length long")
    blocks = planned.repartition(tasks).mapInArrow(_search(eod), "file string, block long, n long, head long, gaps array<long>, tail long")
    blocks = materialize(blocks.withColumn("group", F.floor(F.col("block") / fan)), "blocks")
    inner = _prefix(blocks, ["file", "group"], "block")
    # what a group leaves open: everything behind its last separator
    last = F.max(F.struct("block", F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail")).alias("left")))
    groups = inner.groupBy("file", "group").agg(F.sum("n").alias("n"), last["left"].alias("tail"))
    outer = _prefix(groups, ["file"], "group").select("file", "group", F.col("before").alias("_before"), F.col("open").alias("_open"))
    placed = inner.join(outer, ["file", "group"]).select(
        "file",
        "block",
        "n",
        "gaps",
        "tail",
        (F.col("before") + F.col("_before")).alias("first"),
        F.when(F.col("sealed"), F.col("open")).otherwise(F.col("open") + F.col("_open")).alias("open"),
        "head",
    )
    each = placed.where("n > 0").select("file", "first", F.posexplode(F.concat(F.array(F.col("open") + F.col("head")), "gaps")).alias("place", "n_tokens"))
    closed = each.select("file", (F.col("first") + F.col("place")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    end = placed.groupBy("file").agg(F.max_by(F.struct((F.col("first") + F.col("n")).alias("ordinal"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail")).alias("n_tokens")), "block").alias("e"))
    return closed.unionByName(end.where("e.n_tokens > 0").select("file", "e.ordinal", "e.n_tokens", F.lit(False).alias("closed")))


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, eod: int = 50256) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row, counted from the written files."""
    manifest = write_tokens(docs, vocabulary, pattern, eod)
    return manifest.join(scan(manifest, eod), ["file", "ordinal"], "left").select("doc_id", "n_tokens")
