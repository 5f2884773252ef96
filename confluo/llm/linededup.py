"""Line dedup over overlapping three-line windows.

Semantics
---------
* Lines are the pieces between ``\\n``; a window is ``width`` consecutive lines
  of one document. Documents with fewer lines have no window and stay whole.
* Occurrences of a window are ordered by (doc_id, row hash, position), null
  doc_id first. The first one stays; every line that a later occurrence covers
  goes. Overlapping windows are judged on the input, so a run of more
  than ``width`` equal lines shrinks to its first one.
* Rows that agree in doc_id and text are one document: both rows get the same
  result. Null text gives null text and 0 lines; the empty text is one empty
  line. Empty tables give empty results. Extra columns stay; names of result
  columns are replaced.

Plan: the windows of a text are hashed once (128 bits of BLAKE2 over those of its lines) and
written; an aggregate with map-side combine finds the windows that occur twice or more and their first
occurrence. These are joined back: windows that hold a large share of all rows by broadcast
(a bounded number, ``plans.skew``), the others by a sort-merge join on the hash. The covered positions
are merged per document and joined to the documents.

A very long text is hashed whole by one task, which holds its lines and their hashes. Ties do not arise but
between rows that agree in doc_id and text, see above. Internal columns get names that the table does not have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.names import fresh, named, without
from confluo.plans.shared import materialize
from confluo.plans.skew import keyed_join

RESULT = ["n_lines", "n_removed", "kept_text"]


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, places, h1, h2 = [], [], [], [], []
            for i, r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if text.as_py() is None:
                    continue
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in text.as_py().encode().split(b"\n")]
                for p in range(len(digests) - width + 1):
                    d = hashlib.blake2b(b"".join(digests[p : p + width]), digest_size=16).digest()
                    ids.append(i)
                    rows.append(r)
                    places.append(p)
                    h1.append(int.from_bytes(d[:8], "little", signed=True))
                    h2.append(int.from_bytes(d[8:], "little", signed=True))
            for k in range(0, max(len(ids), 1), 50_000):
                s = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s], batch.column(0).type), pa.array(rows[s], pa.int64()), pa.array(places[s], pa.int32()), pa.array(h1[s], pa.int64()), pa.array(h2[s], pa.int64())],
                    ["doc_id", "row", "pos", "h1", "h2"],
                )

    return run


def repeated_positions(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, row, covered)``: per document the window starts that occurred earlier."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    windows = materialize(keyed.mapInArrow(_windows(width), f"doc_id {kind}, row long, pos int, h1 long, h2 long"), "windows")
    here = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", "pos")
    repeated = materialize(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first")).where("n > 1"), "repeated")
    joined = keyed_join(windows, repeated.drop("n"), repeated, ["h1", "h2"])
    return joined.where(here > F.col("first")).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("covered"))


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """Documents with ``n_lines, n_removed, kept_text``."""
    docs = without(docs, RESULT)
    key, other, row, covered, lines, gone = fresh([*docs.columns, *RESULT], "key", "id", "row", "covered", "lines", "gone")
    found = repeated_positions(docs, width).toDF(other, row, covered)
    every = F.array_distinct(F.flatten(F.transform(covered, lambda p: F.sequence(p, p + (width - 1)))))
    joined = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(found, (F.col(key) == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(other)), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n")
    n_removed = F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("long")
    placed = joined.select(*[named(c) for c in docs.columns], F.split("text", "\n", -1).alias(lines), every.alias(gone))
    return placed.select(
        *[named(c) for c in docs.columns],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        n_removed.alias("n_removed"),
        F.when(n_removed > 0, kept).otherwise(F.col("text")).alias("kept_text"),
    )
