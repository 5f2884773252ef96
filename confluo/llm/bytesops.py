"""Vectorised byte and word primitives shared by the text operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 18

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def word_table(separators: list[tuple[int, int]]) -> np.ndarray:
    """Byte classifier: True inside a word; ``separators`` are inclusive byte ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: [^\x20\x09-\x0D]
SPACED = word_table([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = word_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string/binary column and the n + 1 row offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word (n + 1 entries). Words never cross rows."""
    inside = table[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> np.ndarray:
    powers = np.empty(n, U64)
    powers[:1] = 1
    np.cumprod(np.full(max(n - 1, 0), BASE, U64), out=powers[1:])
    return powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes: its polynomial at ``BASE``, then scrambled with its length.

    Works through ``PIECE`` bytes at a time, so that one very long text or word needs no more beside it.
    """
    lengths = ends - starts
    sums = np.zeros(len(starts), U64)
    for k in np.flatnonzero(lengths > PIECE).tolist():
        powers, factor, acc = _powers(PIECE), 1, 0
        for at in range(int(starts[k]), int(ends[k]), PIECE):
            part = data[at : min(at + PIECE, int(ends[k]))].astype(U64) + U64(1)
            acc = (acc + factor * int((part * powers[: len(part)]).sum())) % (1 << 64)
            factor = factor * pow(BASE, len(part), 1 << 64) % (1 << 64)
        sums[k] = acc
    short = np.flatnonzero((lengths <= PIECE) & (lengths > 0))
    upto = np.cumsum(lengths[short])
    at = 0
    while at < len(short):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 4 * PIECE, side="right")))
        rows = short[at:to]
        own = lengths[rows]
        first = np.cumsum(own) - own
        inner = np.arange(int(own.sum())) - np.repeat(first, own)
        values = (data[inner + np.repeat(starts[rows], own)].astype(U64) + U64(1)) * _powers(int(own.max()))[inner]
        sums[rows] = np.add.reduceat(values, first)
        at = to
    return mix(sums + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def slow_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2 of every word's bytes, for the case that two words share their quick hash."""
    raw = data.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], U64)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the given spans, concatenated."""
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    return data[np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)]


def merge_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs (touching intervals join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return starts[new], ends[last]
