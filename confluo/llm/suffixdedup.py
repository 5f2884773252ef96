"""Repeated byte strings across documents by a depth-limited radix sort of suffixes.

Semantics
---------
* Texts are UTF-8 bytes (null reads as empty). A byte is removed when it is
  covered by a ``width``-byte string of its document that also starts in a
  document with a smaller doc_id. Strings never cross documents, overlaps
  count, and all is judged on the input.
* Per row: ``n_bytes``, ``spans`` (maximal removed runs, as start and end
  bytes) and ``kept`` (the remaining bytes; a cut may fall inside a character).
* doc_id must be an integer column (else ValueError). Rows that agree in doc_id, the only ties, never remove from each other. Rows without doc_id
  stay whole and count as nobody's predecessor. Empty and short texts stay
  whole, empty tables give empty results, extra columns of any name can be carried, and names of
  result columns are replaced. A very long text makes its block longer than ``block_bytes``; one task
  holds it whole, with about 40 bytes a byte of text.

Method
------
Only suffixes that can be repeated are sorted, and only to ``width`` bytes:

1. Documents are dealt to blocks of about ``block_bytes`` by a hash of the row.
   This is the only time that texts are shuffled; the three uses share the
   exchange.
2. The first digit of a suffix is the smallest hash among the ``gram``-byte strings
   in its first ``width`` bytes. It is a function of those bytes, so equal
   strings share it, and neighbouring suffixes mostly share it too, so they
   travel as one run. Each block reports its distinct digits once, however
   many copies it holds; digits that occur in two documents are answered.
3. Runs under answered digits send their bytes, once per block for equal ones, to
   the digit's bucket. There suffixes are ordered by most-significant-digit passes
   of eight bytes; groups of one drop out, and the groups after ``width`` bytes are
   exactly the repeated strings. Each learns its smallest doc_id.
4. Blocks get back, per distinct run, which of its strings start in which
   smaller document, and cut their documents.

A passage in a third of all documents therefore costs a bucket one entry a
block, not one a document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from confluo.llm.bytesops import BASE, U64, gather, merge_runs, mix, slow_hashes, utf8, word_hashes
from confluo.llm.names import integer_id, numbered, without

RESULT = ["n_bytes", "spans", "kept"]
CHUNK = 1 << 17
LONGEST_RUN = 64
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class Block:
    """The documents of one block in a fixed order, and their runs of suffixes."""

    def __init__(self, table: pa.Table, width: int, gram: int):
        ids = table.column("_id").to_pylist()
        texts = table.column("_text").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k] or b""))
        self.order = order
        self.known = np.array([ids[k] is not None for k in order], bool)
        self.ids = np.array([ids[k] if ids[k] is not None else 0 for k in order], np.int64)
        self.data, self.offsets = utf8(pa.array([texts[k] for k in order], pa.large_binary()))
        self.width = width
        digits, starts, lengths = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        last = np.repeat(np.where(self.known, self.offsets[1:], 0), np.diff(self.offsets))  # no suffix of unnamed rows
        for a in range(0, len(self.data) - width + 1, CHUNK):
            b = min(a + CHUNK, len(self.data) - width + 1)
            least = _least(self.data[a : b + width - 1], width, gram)
            inside = np.arange(a, b) + width <= last[a:b]
            new = np.ones(b - a, bool)
            new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
            edge = self.offsets[(self.offsets > a) & (self.offsets < b)]
            new[edge - a] = True
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, b - a))
            good = inside[first]
            first, length = first[good], length[good]
            parts = -(-length // LONGEST_RUN)
            if len(parts) and parts.max() > 1:
                nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                first, whole = np.repeat(first, parts) + nth * LONGEST_RUN, np.repeat(length, parts)
                length = np.minimum(whole - nth * LONGEST_RUN, LONGEST_RUN)
            digits.append(least[first])
            starts.append(first + a)
            lengths.append(length)
        self.digit, self.start, self.length = map(np.concatenate, (digits, starts, lengths))
        self.end = self.start + self.length + width - 1
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1

    def same(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs ordered by their bytes' hash, and the group of each in that order."""
        every = runs
        for hashes in (word_hashes, slow_hashes):  # the second where different strings share the first
            key = hashes(self.data, self.start[every], self.end[every])
            order = np.lexsort((every, key, self.digit[every]))
            runs, key, digit = every[order], key[order], self.digit[every][order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (digit[1:] != digit[:-1]))) if len(runs) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            lead = runs[new][group] if len(runs) else runs
            if not (self.length[runs] != self.length[lead]).any() and not (gather(self.data, self.start[runs], self.end[runs]) != gather(self.data, self.start[lead], self.end[lead])).any():
                return runs, group
        raise ValueError("different strings share 128 bits of two hashes")


def _least(data: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For every start of a ``width``-byte string the smallest hash of the ``gram``-byte strings in it."""
    power, span, done, taken = data.astype(U64) + U64(1), 1, None, 0
    left = gram
    while left:
        if left & 1:
            if done is None:
                done, taken = power, span
            else:
                n = len(power) - taken
                done = done[:n] + power[taken:] * U64(pow(BASE, taken, 1 << 64))
                taken += span
        left >>= 1
        if left:
            power = power[:-span] + power[span:] * U64(pow(BASE, span, 1 << 64))
            span *= 2
    hashes = mix(done[: len(data) - gram + 1])
    count, reach = width - gram + 1, 1
    least = hashes
    while reach * 2 <= count:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    n = len(data) - width + 1
    return np.minimum(least[:n], least[count - reach : count - reach + n])


def _pack(values: np.ndarray) -> bytes:
    """The low six bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(parts: list[bytes]) -> np.ndarray:
    six = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").reshape(-1)


def _bucket(digits: np.ndarray, buckets: int) -> np.ndarray:
    return ((digits >> U64(48)) % U64(buckets)).astype(np.int64) if buckets <= 1 << 16 else (mix(digits) % U64(buckets)).astype(np.int64)


def _cuts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_values):
        return []
    first = np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1))
    return list(zip(first.tolist(), np.append(first[1:], len(sorted_values)).tolist(), strict=True))


def _report(width: int, gram: int, buckets: int):
    """Step 2, in a block: its distinct digits, apart by whether two of its documents have them."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(table, width, gram)
        name = table.column("block")[0].as_py()
        ids = block.ids[block.doc]
        order = np.lexsort((ids, block.digit))
        digit, ids = block.digit[order], ids[order]
        out: dict[str, list] = {"bucket": [], "block": [], "one": [], "many": []}
        if len(digit):
            first = np.flatnonzero(np.concatenate(([True], digit[1:] != digit[:-1])))
            many = ids[first] != ids[np.append(first[1:], len(ids)) - 1]
            digit = digit[first]
            to = _bucket(digit, buckets)
            order = np.argsort(to, kind="stable")
            digit, many, to = digit[order], many[order], to[order]
            for a, b in _cuts(to):
                out["bucket"].append(int(to[a]))
                out["block"].append(name)
                out["one"].append(_pack(digit[a:b][~many[a:b]]))
                out["many"].append(_pack(digit[a:b][many[a:b]]))
        return pa.table(out, schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("one", pa.binary()), ("many", pa.binary())]))

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Step 2, in a bucket: to each block its digits that two documents have."""
    names = table.column("block").to_pylist()
    one, many = table.column("one").to_pylist(), table.column("many").to_pylist()
    digits = _unpack([x for pair in zip(one, many, strict=True) for x in pair])
    sizes = np.array([[len(x) // 6, len(y) // 6] for x, y in zip(one, many, strict=True)], np.int64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(names)), sizes.sum(axis=1))
    local = np.repeat(np.tile([False, True], len(names)), sizes.reshape(-1))
    values, inverse, counts = np.unique(digits, return_inverse=True, return_counts=True)
    hot = counts > 1
    hot[inverse.reshape(-1)[local]] = True
    take = hot[inverse.reshape(-1)]
    digits, owner = digits[take], owner[take]
    out: dict[str, list] = {"block": [], "digits": []}
    for a, b in _cuts(owner):
        out["block"].append(names[owner[a]])
        out["digits"].append(_pack(digits[a:b]))
    return pa.table(out, schema=pa.schema([("block", pa.int64()), ("digits", pa.binary())]))


def _send(width: int, gram: int, buckets: int):
    """Step 3, in a block: the bytes of its distinct runs under answered digits."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("run", pa.binary()), ("length", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("data", pa.binary())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return schema.empty_table()
        block = Block(docs, width, gram)
        name = docs.column("block")[0].as_py()
        hot = np.unique(_unpack(answers.column("digits").to_pylist()))
        digit = block.digit & U64((1 << 48) - 1)
        spot = np.minimum(np.searchsorted(hot, digit), len(hot) - 1)
        runs, group = block.same(np.flatnonzero(hot[spot] == digit))
        out: dict[str, list] = {x: [] for x in schema.names}
        if len(runs):
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            ids = block.ids[block.doc[runs]]
            low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
            lead = runs[first]
            to = _bucket(block.digit[lead], buckets)
            order = np.argsort(to, kind="stable")
            lead, low, high, to = lead[order], low[order], high[order], to[order]
            for a, b in _cuts(to):
                out["bucket"].append(int(to[a]))
                out["block"].append(name)
                out["run"].append(lead[a:b].astype("<u4").tobytes())
                out["length"].append(block.length[lead[a:b]].astype(np.uint8).tobytes())
                out["low"].append(low[a:b].tobytes())
                out["high"].append(high[a:b].tobytes())
                out["data"].append(zlib.compress(gather(block.data, block.start[lead[a:b]], block.end[lead[a:b]]).tobytes(), 1))
        return pa.table(out, schema=schema)

    return run


def radix_groups(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """MSD radix sort of the strings ``data[s : s + width]``: those that occur twice or more, and their group.

    Each pass orders what is left of every group by the next eight bytes.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    live = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for depth in range(0, width, 8):
        digit = words[starts[live] + depth].astype(np.uint64)
        if width - depth < 8:
            digit >>= U64(8 * (8 - (width - depth)))
        order = np.lexsort((digit, group)) if depth else np.argsort(digit, kind="stable")
        digit, group, live = digit[order], group[order], live[order]
        new = np.concatenate(([True], (digit[1:] != digit[:-1]) | (group[1:] != group[:-1]))) if len(live) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        keep = np.bincount(group, minlength=1)[group] > 1 if len(live) else new
        live, group = live[keep], group[keep]
    return live, group


def _sort(width: int):
    """Step 3, in a bucket: order the suffixes, find each repeated string's smallest document."""
    schema = pa.schema([("block", pa.int64()), ("run", pa.binary()), ("first", pa.binary()), ("count", pa.binary()), ("low", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        names = table.column("block").to_pylist()
        parts = {c: table.column(c).to_pylist() for c in ("run", "length", "low", "high", "data")}
        run_, low, high = (np.frombuffer(b"".join(parts[c]), t) for c, t in (("run", "<u4"), ("low", np.int64), ("high", np.int64)))
        length = np.frombuffer(b"".join(parts["length"]), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(names)), [len(x) // 4 for x in parts["run"]])
        data = np.frombuffer(b"".join(map(zlib.decompress, parts["data"])), np.uint8)
        size = length + width - 1
        start = np.cumsum(size) - size
        # equal runs of several blocks are one run to sort
        key = word_hashes(data, start, start + size)
        _, lead, same = np.unique(key, return_index=True, return_inverse=True)
        same = same.reshape(-1)
        if (length != length[lead][same]).any() or (data != gather(data, start[lead][same], (start + size)[lead][same])).any():
            lead = same = np.arange(len(key))
        least = np.full(len(lead), np.iinfo(np.int64).max)
        np.minimum.at(least, same, low)
        first = np.cumsum(length[lead]) - length[lead]
        inner = np.arange(int(length[lead].sum())) - np.repeat(first, length[lead])
        of = np.repeat(np.arange(len(lead)), length[lead])
        suffix = start[lead][of] + inner
        best = least[of]
        live, group = radix_groups(data, suffix, width)
        if len(live):
            smallest = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, group, best[live])
            best[live] = smallest[group]
        # pieces of a run whose strings share their smallest document
        new = np.concatenate(([True], (best[1:] != best[:-1]) | (of[1:] != of[:-1])))
        piece = np.flatnonzero(new)
        count = np.diff(np.append(piece, len(best)))
        per = np.bincount(of[piece], minlength=len(lead))
        at = np.cumsum(per) - per
        mine = per[same]
        row = np.repeat(np.arange(len(run_)), mine)
        pick = np.arange(int(mine.sum())) + np.repeat(at[same] - (np.cumsum(mine) - mine), mine)
        use = best[piece[pick]] < high[row]
        row, pick = row[use], pick[use]
        out: dict[str, list] = {x: [] for x in schema.names}
        for a, b in _cuts(owner[row]):
            out["block"].append(names[owner[row[a]]])
            out["run"].append(run_[row[a:b]].tobytes())
            out["first"].append(inner[piece[pick[a:b]]].astype(np.uint8).tobytes())
            out["count"].append(count[pick[a:b]].astype(np.uint8).tobytes())
            out["low"].append(best[piece[pick[a:b]]].tobytes())
        return pa.table(out, schema=schema)

    return run


def _cut(width: int, gram: int, schema: pa.Schema):
    """Step 4, in a block: the removed spans and what remains."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        block = Block(docs, width, gram)
        n = len(block.order)
        spans: list[list] = [[] for _ in range(n)]
        if found.num_rows:
            parts = {c: b"".join(found.column(c).to_pylist()) for c in ("run", "first", "count", "low")}
            lead = np.frombuffer(parts["run"], "<u4").astype(np.int64)
            first, count = (np.frombuffer(parts[c], np.uint8).astype(np.int64) for c in ("first", "count"))
            low = np.frombuffer(parts["low"], np.int64)
            order = np.argsort(lead, kind="stable")
            lead, first, count, low = lead[order], first[order], count[order], low[order]
            runs, group = block.same(np.flatnonzero(np.isin(block.digit, block.digit[np.unique(lead)])))
            of = np.full(len(block.digit), -1, np.int64)
            of[runs] = group
            kind = of[lead]
            by = np.argsort(kind, kind="stable")
            kind, first, count, low = kind[by], first[by], count[by], low[by]
            a, b = np.searchsorted(kind, group), np.searchsorted(kind, group, side="right")
            each = b - a
            row = np.repeat(runs, each)
            pick = np.arange(int(each.sum())) + np.repeat(a - (np.cumsum(each) - each), each)
            use = low[pick] < block.ids[block.doc[row]]
            row, pick = row[use], pick[use]
            begin = block.start[row] + first[pick] + block.doc[row]  # a gap between documents
            left, right = merge_runs(begin, begin + count[pick] + width - 1)
            doc = np.searchsorted(block.offsets[:-1] + np.arange(n), left, side="right") - 1
            for d, x, y in zip(doc.tolist(), left.tolist(), right.tolist(), strict=True):
                base = int(block.offsets[d]) + d
                spans[d].append({"start": x - base, "end": y - base})
        raw = block.data.tobytes()
        kept = []
        for d in range(n):
            at, text = 0, raw[block.offsets[d] : block.offsets[d + 1]]
            pieces = []
            for s in spans[d]:
                pieces.append(text[at : s["start"]])
                at = s["end"]
            kept.append(b"".join([*pieces, text[at:]]))
        carried = docs.drop_columns(["block", "_id", "_text"]).take(pa.array(block.order))
        arrays = [c.combine_chunks() for c in carried.columns]
        return pa.table([*arrays, pa.array(np.diff(block.offsets)), pa.array(spans, pa.list_(SPAN)), pa.array(kept, pa.binary())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 16, carry: list[str] | None = None, block_bytes: int = 2 << 20) -> DataFrame:
    """The ``carry`` columns of ``docs`` (default all but text) with ``n_bytes, spans, kept``."""
    integer_id(docs, "doc_id")
    docs = without(docs, RESULT)
    carry = [c for c in docs.columns if c != "text"] if carry is None else carry
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, buckets = max(1, -(-total // block_bytes)), max(1, -(-total // (2 * block_bytes)))
    carried, fields = numbered(docs, carry)
    texts = docs.select(
        *carried,
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("long").alias("block"),
        F.col("doc_id").cast("long").alias("_id"),
        F.col("text").cast("binary").alias("_text"),
    )
    ends = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    final = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(ends)), T.StructField("kept", T.BinaryType())])
    reports = texts.groupBy("block").applyInArrow(_report(width, gram, buckets), "bucket long, block long, one binary, many binary")
    answers = reports.groupBy("bucket").applyInArrow(_answer, "block long, digits binary")
    sent = (
        texts.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_send(width, gram, buckets), "bucket long, block long, run binary, length binary, low binary, high binary, data binary")
    )
    found = sent.groupBy("bucket").applyInArrow(_sort(width), "block long, run binary, first binary, count binary, low binary")
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cut(width, gram, to_arrow_schema(final)), final).toDF(*carry, *RESULT)
