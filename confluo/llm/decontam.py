"""Benchmark decontamination with suffix arrays over the training text.

Semantics
---------
* A-Z are lower-cased; words are runs of digits, a-z and bytes above ASCII.
* A window is ``window`` consecutive words of a benchmark item; an item of
  fewer words is one window of all its words; an item without words has none.
* A document word inside any occurrence of a window is hit. A document is
  contaminated when ``n_hit > 0`` and ``ratio * n_hit >= n_words``.
* Per document: ``n_words``, ``n_hit``, ``items`` (per item with an occurring
  window: item_id, longest verbatim match and where it lies in document and
  item) and ``contaminated``.

Method: each task turns its documents into shards of word identifiers and
builds a suffix array per shard, over the suffixes that can hold a whole window
(prefix doubling to the length of the longest item). All benchmark suffixes are
then binary-searched in it together, one word deeper at a time. Words are
matched by 64-bit hash and, for everything that was hit, compared byte by byte.

The benchmark is dealt into blocks of about ``block_bytes`` of text by a hash of its rows. Tasks
build the blocks and write them to the shared folder; every task that scans documents reads the blocks
one after the other, each once for ``held_bytes`` of documents, and merges what they hit in a document. So a
benchmark of any size takes one scan of the documents and no shuffle of them; one block is in memory at a time.

Edge cases: null text has no words; documents without words are clean; null
item_id reads as ``null``; rows that agree in item_id are one item; repeated rows are judged alike; of equally
long longest matches of an item the first in the document is named; an empty
benchmark hits nothing; an empty table gives an empty result. Extra columns of any name
stay; names of result columns are replaced. A very long text is a shard by itself in one task, with
some 60 bytes a byte of text; one item longer than ``block_bytes`` is a block by itself.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.llm import files
from confluo.llm.bytesops import ALNUM, ASCII_LOWER, blocks, gather, merge_runs, slow_hashes, utf8, word_hashes, word_spans
from confluo.llm.names import numbered, set_aside, without
from confluo.plans.shared import materialize

RESULT = ["n_words", "runs", "items", "n_hit", "contaminated"]
ITEM = pa.struct([("item_id", pa.string()), ("n_words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())])
RUN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
HITS = "n_words long, runs array<struct<start:long,end:long>>, items array<struct<item_id:string,n_words:long,doc_word:long,item_word:long>>"


class TestSuffixes:
    """Word identifiers of one benchmark block and its window suffixes."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        data = ASCII_LOWER[data]
        starts, ends, first = word_spans(data, offsets, ALNUM)
        self.words = data
        for self.exact in (False, True):  # two benchmark words that share their quick hash call for the slow one
            self.hashes, one, inverse = np.unique(self.hash(data, starts, ends), return_index=True, return_inverse=True)
            inverse = inverse.reshape(-1)
            self.word_start, self.word_end = starts[one], ends[one]
            if not ((ends - starts) != (self.word_end - self.word_start)[inverse]).any() and not (gather(data, starts, ends) != gather(data, self.word_start[inverse], self.word_end[inverse])).any():
                break
        self.ids = ids
        counts = np.diff(first)
        self.longest = int(counts.max(initial=0))
        item = np.repeat(np.arange(len(ids)), counts)
        place = np.arange(len(starts)) - np.repeat(first[:-1], counts)
        need = np.minimum(window, counts)[item]
        rest = counts[item] - place
        own = rest >= need
        self.tokens = np.concatenate((inverse.astype(np.int64) + 1, np.zeros(1, np.int64)))
        self.start = np.flatnonzero(own)
        self.item, self.place, self.need, self.rest = item[own], place[own], need[own], rest[own]
        self.shortest = int(self.need.min(initial=window))

    def hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (slow_hashes if self.exact else word_hashes)(data, starts, ends)


def _suffix_array(tokens: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """``positions`` ordered by the words that follow, up to ``depth`` words or the first 0."""
    rank = tokens.copy()
    order, width = positions[np.argsort(tokens[positions], kind="stable")], 1
    while width < depth:
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - width] = rank[width:]
        ahead[rank == 0] = 0
        high = int(rank.max()) + 1
        key = rank * high + ahead
        live = np.flatnonzero(rank)
        values, inverse = np.unique(key[live], return_inverse=True)
        fresh = np.zeros(len(rank), np.int64)
        fresh[live] = inverse.reshape(-1) + 1
        rank = fresh
        order = positions[np.argsort(rank[positions], kind="stable")]
        width *= 2
        if len(values) == len(live):
            break
    return order


def _bound(words: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """For every query the bound of ``wanted`` in ``words[low:high]``, by simultaneous bisection."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) >> 1
        at = words[mid]
        up = at <= wanted[open_] if right else at < wanted[open_]
        low[open_[up]] = mid[up] + 1
        high[open_[~up]] = mid[~up]
    return low


def _search(test: TestSuffixes, tokens: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per occurrence of a window: query and position; and per query the longest match and one place of it."""
    low = np.zeros(len(test.start), np.int64)
    high = np.full(len(test.start), len(order), np.int64)
    longest = np.zeros(len(test.start), np.int64)
    where = np.zeros(len(test.start), np.int64)
    hit_low, hit_high = low.copy(), low.copy()
    live = np.arange(len(test.start)) if len(order) else np.zeros(0, np.int64)
    depth = 0
    while len(live):
        words = tokens[np.minimum(order + depth, len(tokens) - 1)]
        wanted = test.tokens[test.start[live] + depth]
        a = _bound(words, low[live], high[live], wanted, False)
        b = _bound(words, a, high[live], wanted, True)
        found = b > a
        live = live[found]
        low[live], high[live] = a[found], b[found]
        depth += 1
        longest[live], where[live] = depth, order[low[live]]
        full = live[test.need[live] == depth]
        hit_low[full], hit_high[full] = low[full], high[full]
        live = live[test.rest[live] > depth]
    counts = hit_high - hit_low
    query = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    position = order[np.arange(int(counts.sum())) + np.repeat(hit_low - first, counts)]
    return query, position, longest, where


def _extend(test: TestSuffixes, tokens: np.ndarray, query: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Length of the verbatim match at each occurrence, beyond the window to the item's end."""
    length = test.need[query].copy()
    live = np.flatnonzero(test.rest[query] > length)
    while len(live):
        same = tokens[np.minimum(position[live] + length[live], len(tokens) - 1)] == test.tokens[test.start[query[live]] + length[live]]
        live = live[same]
        length[live] += 1
        live = live[test.rest[query[live]] > length[live]]
    return length


def _shard(test: TestSuffixes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list], list[list]]:
    """n_words, hit runs and items of the documents of one shard."""
    data = ASCII_LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM)
    counts = np.diff(first)
    n = len(counts)
    runs: list[list] = [[] for _ in range(n)]
    items: list[list] = [[] for _ in range(n)]
    if not len(starts) or not len(test.start):
        return counts, runs, items
    hashes = test.hash(data, starts, ends)
    place = np.minimum(np.searchsorted(test.hashes, hashes), len(test.hashes) - 1)
    known = test.hashes[place] == hashes
    base = first[:-1] + np.arange(n)  # a 0 after each document keeps matches inside it
    doc = np.repeat(np.arange(n), counts)
    at = np.arange(len(starts)) + doc
    while True:
        tokens = np.zeros(len(starts) + n, np.int64)
        tokens[at] = np.where(known, place + 1, 0)
        breaks = np.flatnonzero(tokens == 0)
        ahead = breaks[np.searchsorted(breaks, np.arange(len(tokens)))] - np.arange(len(tokens))
        positions = np.flatnonzero(ahead >= test.shortest)
        order = _suffix_array(tokens, positions, test.longest)
        query, position, _, _ = _search(test, tokens, order)
        if not len(query):
            return counts, runs, items
        left, right = merge_runs(position, position + test.need[query])
        covered = np.concatenate([np.arange(a, b) for a, b in zip(left, right, strict=True)])
        word = covered - np.searchsorted(base, covered, side="right") + 1
        # exact comparison of every word that was hit; a false hash match is taken out and the shard searched again
        mine = gather(data, starts[word], ends[word])
        length = (ends - starts)[word]
        theirs_start, theirs_end = test.word_start[place[word]], test.word_end[place[word]]
        wrong = length != theirs_end - theirs_start
        if not wrong.any():
            differs = mine != gather(test.words, theirs_start, theirs_end)
            wrong = np.add.reduceat(differs, np.cumsum(length) - length) > 0
        if not wrong.any():
            break
        known[word[wrong]] = False
    owner = np.searchsorted(base, left, side="right") - 1
    for d, a, b in zip(owner.tolist(), left.tolist(), right.tolist(), strict=True):
        runs[d].append({"start": a - int(base[d]), "end": b - int(base[d])})
    length = _extend(test, tokens, query, position)
    owner = np.searchsorted(base, position, side="right") - 1
    item = test.item[query]
    ranked = np.lexsort((position, -length, item, owner))
    owner, item = owner[ranked], item[ranked]
    best = ranked[np.concatenate(([True], (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])))]
    for q, p, m in zip(query[best].tolist(), position[best].tolist(), length[best].tolist(), strict=True):
        d = int(np.searchsorted(base, p, side="right")) - 1
        items[d].append({"item_id": test.ids[test.item[q]], "n_words": m, "doc_word": p - int(base[d]), "item_word": int(test.place[q])})
    return counts, runs, items


def _merged(found: list[tuple[list, list]]) -> tuple[list, list]:
    """Runs and items of one document over all blocks: maximal runs, and of each item the longest match."""
    every = [r for runs, _ in found for r in runs]
    left, right = merge_runs(np.array([r["start"] for r in every], np.int64), np.array([r["end"] for r in every], np.int64))
    best: dict[str, dict] = {}
    for item in sorted((i for _, items in found for i in items), key=lambda i: (-i["n_words"], i["doc_word"], i["item_word"])):
        best.setdefault(item["item_id"], item)
    return [{"start": a, "end": b} for a, b in zip(left.tolist(), right.tolist(), strict=True)], [best[k] for k in sorted(best)]


def _scan(uris: list[str], shard_bytes: int, held_bytes: int):
    """Last column is the text; the others are carried. Batches are held up to ``held_bytes`` only if there are several blocks."""

    def judged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [utf8(batch.column(batch.num_columns - 1)) for batch in held]
        counts = [np.zeros(batch.num_rows, np.int64) for batch in held]
        found: list[dict[int, list]] = [{} for _ in held]
        for uri in uris:
            test = _block(uri, len(uris) == 1)
            for (data, offsets), n_words, hits in zip(texts, counts, found, strict=True):
                for i, j in blocks(offsets, shard_bytes):
                    n_words[i:j], runs, items = _shard(test, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    for d in [d for d, r in enumerate(runs) if r]:
                        hits.setdefault(i + d, []).append((runs[d], items[d]))
        for batch, n_words, hits in zip(held, counts, found, strict=True):
            whole = [_merged(hits[d]) if d in hits else ([], []) for d in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_words), pa.array([w[0] for w in whole], pa.list_(RUN)), pa.array([w[1] for w in whole], pa.list_(ITEM))],
                [*batch.schema.names[:-1], *RESULT[:3]],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(uris) == 1 or size >= held_bytes:
                yield from judged(held)
                held, size = [], 0
        yield from judged(held)

    return run


_kept: dict[str, TestSuffixes] = {}


def _block(uri: str, keep: bool) -> TestSuffixes:
    """A block from the shared folder; a worker keeps the only one of a benchmark."""
    if uri in _kept:
        return _kept[uri]
    test = pickle.loads(files.read(uri))
    if keep:
        _kept.clear()
        _kept[uri] = test
    return test


def _build(folder: str, window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(set(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True)), key=lambda r: (r[0], r[1] or ""))
        uri = f"{folder}/{files.attempt_name('block', '.pickle')}"
        files.write(uri, pickle.dumps(TestSuffixes([r[0] for r in rows], [r[1] for r in rows], window), pickle.HIGHEST_PROTOCOL))
        return pa.table({"uri": [uri]})

    return run


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[str]:
    """The files of the blocks, one name for every ``block_bytes`` of benchmark text; one at least."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    folder = files.folder(benchmark.sparkSession, "benchmark")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    found = materialize(dealt.groupBy("block").applyInArrow(_build(folder, window), "uri string"), "blocks")
    uris = sorted(r.uri for r in found.collect())
    if not uris:
        uris = [f"{folder}/none"]
        files.write(uris[0], pickle.dumps(TestSuffixes([], [], window)))
    return uris


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    ratio: int = 20,
    carry: list[str] | None = None,
    block_bytes: int = 8 << 20,
    shard_bytes: int = 4 << 20,
    held_bytes: int = 64 << 20,
) -> DataFrame:
    """``docs`` (its ``carry`` columns, default all) with ``n_words, runs, items, n_hit, contaminated``."""
    docs = without(docs, RESULT)
    carry = list(docs.columns) if carry is None else carry
    carried, fields = numbered(docs, carry)
    uris = benchmark_blocks(benchmark, window, block_bytes)
    kinds = T.StructType.fromDDL(HITS).fields
    found = docs.select(*carried, F.col("text").cast("string").alias("_text")).mapInArrow(_scan(uris, shard_bytes, held_bytes), T.StructType([*fields, *kinds]))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    found = found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("n_words")))
    return found.toDF(*carry, *RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, ratio: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their own columns."""
    docs, back = set_aside(docs, RESULT)
    return find_matches(docs, benchmark, window, ratio).where(~F.col("contaminated")).select(*back)
