"""Language identification with interpolated Kneser-Ney character models.

Semantics
---------
* Text is lower-cased; a run of characters that are no letters reads as one
  space. Every position with its three predecessors is a 4-gram; a document
  starts behind three spaces. What is a letter is decided on the whole code point; then
  it takes 16 bits: letters of the first two planes each have a place of their own (those of
  the second where the first has none), the ideographs of further planes share those of the first.
* One model per language: interpolated Kneser-Ney of order 4 down to 1 over the
  counts of *all* training documents. The n-gram arrays are sorted by a 64-bit
  hash (a bijection of the packed characters) and searched by bisection.
* Prediction: the language of lowest cross-entropy in bits per character.
  ``score`` is the softmax of the negative cross-entropies at a temperature
  fitted on training documents. ``rejected``: no text or letter, or the
  cross-entropy lies beyond what calibration saw for that language at that
  length (mean + ``z`` times the spread of documents and of single characters).

Bounds: no count is dropped. The 4-grams are dealt by their two middle characters to parts of at most
``max_cells`` n-gram x language cells, as many as the corpus needs. Executors build the parts, each
beside the others, and write them to the shared folder; tasks that score read them one after the
other, once for ``held_bytes`` of documents, and add up what they find. Orders 4 and 3 of an n-gram lie in one part, and
each part has the pairs of characters and single ones of all. A pair is never split, so
the bound is exceeded where one pair alone has more. The driver holds the number of cells for each of 4,093 residues of
pairs, and the continuation counts of pairs (at most the square of the alphabet a language) on their way to the
shared folder. Temperature and rejection are fitted on all training documents, from sums per language.

Edge cases: null text, empty text and text without letters are ``und`` with
score 0 and rejected; rows without lang or doc_id are not learned from;
without any training document everything is ``und``; rows are judged one by
one, so repeated rows agree; of languages with equal cross-entropy the first by code point
is predicted; a very long text is scored whole in one task, with some 50 bytes a character; extra columns of
any name stay, names of result columns are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.llm import files
from confluo.llm.bytesops import U64, mix
from confluo.llm.names import numbered, without
from confluo.plans.shared import materialize

RESULT = ["lang_pred", "score", "entropy", "rejected"]
CHARS = 1 << 18
ORDER = 4
#: Residues of the two middle characters; a part of the model is a range of them.
RESIDUES = 4093
TEMPERATURES = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
IDEOGRAPHS = range(0x4E00, 0xA000)
_places: list[np.ndarray] = []


def _place_table() -> np.ndarray:
    """16 bits for each code point: 0 for what is no letter, never 0 for a lower-case letter."""
    if not _places:
        table = np.zeros(0x110000, np.uint16)
        letters = np.array([c for c in range(len(table)) if chr(c).isalpha() and chr(c).lower() == chr(c)])
        basic, wide = letters[letters <= 0xFFFF], letters[letters > 0xFFFF]
        table[basic] = basic
        free = np.setdiff1d(np.arange(1, 1 << 16), basic)
        own = wide[wide < 0x20000][: len(free)]
        table[own] = free[: len(own)]
        rest = wide[len(own) :]
        table[rest] = IDEOGRAPHS.start + np.arange(len(rest)) % len(IDEOGRAPHS)
        _places.append(table)
    return _places[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of the texts and how many each text has."""
    joined = "\0".join((t or "").replace("\0", " ") for t in texts).lower() + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    stops = np.flatnonzero(codes == 0)
    codes = _place_table()[codes]
    letter = codes != 0
    before = np.empty_like(letter)
    before[0] = False
    before[1:] = letter[:-1]
    keep = letter | before  # a space after each word, and none before the first
    keep[stops] = before[stops]
    upto = np.cumsum(keep)
    ends = upto[stops]
    sizes = np.diff(np.concatenate(([0], ends)))
    kept = codes[keep].astype(U64)
    place = np.arange(len(kept)) - np.repeat(ends - sizes, sizes)
    packed = kept.copy()
    for back in range(1, ORDER):
        earlier = np.zeros(len(kept), U64)
        earlier[back:] = kept[:-back] if len(kept) > back else kept[:0]
        earlier[place < back] = 0
        packed |= earlier << U64(16 * back)
    return packed, sizes


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= CHARS:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of one task, merged in memory and let go when large."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        values, inverse = np.unique(codes, return_inverse=True)
        return values, np.bincount(inverse.reshape(-1), counts, len(values)).astype(np.int64)

    def flush():
        for lang, parts in held.items():
            values, counts = merged(parts)
            for k in range(0, len(values), 100_000):
                v, c = values[k : k + 100_000], counts[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v), pa.string()), pa.array(v.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts, strict=True):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            for i, j in _blocks(own):
                codes, _ = grams(own[i:j])
                values, counts = np.unique(codes, return_counts=True)
                held.setdefault(lang, []).append((values, counts))
                size += len(values)
        if size > 2_000_000:
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            size = sum(len(p[0][0]) for p in held.values())
            if size > 1_500_000:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _residue(codes: np.ndarray) -> np.ndarray:
    return (codes >> U64(16) & U64(0xFFFFFFFF)) % U64(RESIDUES)


def _ranges(sizes: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges that cover all residues, each of at most ``most`` rows or one residue."""
    out, start, held = [], 0, 0
    for r in range(RESIDUES):
        n = sizes.get(r, 0)
        if held and held + n > most:
            out.append((start, r))
            start, held = r, 0
        held += n
    return [*out, (start, RESIDUES)]


@dataclass
class Level:
    """One order of one language: n-gram weights, and per context its total and number of followers."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    followers: np.ndarray


def _level(codes: np.ndarray, counts: np.ndarray) -> Level:
    contexts, inverse = np.unique(codes >> U64(16), return_inverse=True)
    inverse = inverse.reshape(-1)
    totals = np.bincount(inverse, counts, len(contexts))
    followers = np.bincount(inverse, minlength=len(contexts)).astype(float)
    keys, hashed = mix(codes), mix(contexts)
    a, b = np.argsort(keys), np.argsort(hashed)
    return Level(keys[a], counts[a].astype(float), hashed[b], totals[b], followers[b])


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


@dataclass
class Part:
    """All languages: their levels, and the bits of every 4-gram of this part under each of them."""

    langs: list[str]
    levels: list[list[Level]]
    letters: int
    discount: float = 0.75
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    bits: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def entropy(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Bits of 4-grams under language k, by interpolation from the lowest order."""
        p = np.full(len(codes), 1.0 / (self.letters + 1))
        for order in range(1, ORDER + 1):
            level = self.levels[k][order - 1]
            if not len(level.keys):
                continue
            part = codes & U64((1 << (16 * order)) - 1) if order < ORDER else codes
            at, there = _find(level.keys, mix(part))
            count = np.where(there, level.counts[at], 0.0)
            at, there = _find(level.contexts, mix(part >> U64(16)))
            total, followers = level.totals[at], level.followers[at]
            lower = np.maximum(count - self.discount, 0) / total + self.discount * followers / total * p
            p = np.where(there, lower, p)
        return -np.log2(p)

    def score(self, texts: list[str | None], within: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The share that the 4-grams ``within`` a range of residues have in the bits per character of each text
        under each language, and its number of 4-grams."""
        out, sizes = np.full((len(texts), len(self.langs)), np.nan), np.zeros(len(texts), np.int64)
        for i, j in _blocks(texts):
            codes, n = grams(texts[i:j])
            sizes[i:j] = n
            some = np.flatnonzero(n)
            if not len(some):
                continue
            mine = slice(None)
            if within != (0, RESIDUES):
                residues = _residue(codes)
                mine = np.flatnonzero((residues >= within[0]) & (residues < within[1]))
            at, there = _find(self.keys, mix(codes[mine]))
            missing, inverse = np.unique(codes[mine][~there], return_inverse=True)
            first = (np.cumsum(n) - n)[some]
            bits = np.zeros(len(codes))
            for k in range(len(self.langs)):
                known = self.bits[at, k].astype(float)
                if len(missing):
                    known[~there] = self.entropy(missing, k)[inverse.reshape(-1)]
                bits[mine] = known
                out[i + some, k] = np.add.reduceat(bits, first) / n[some]
        return out, sizes


_kept: dict[str, Part] = {}


def load(uri: str, keep: bool = False) -> Part:
    """A part from the shared folder; a worker keeps the only one of a model."""
    if uri in _kept:
        return _kept[uri]
    part = pickle.loads(files.read(uri))
    if keep:
        _kept.clear()
        _kept[uri] = part
    return part


@dataclass
class Model:
    """Languages, where their parts lie (file and range of residues), and what calibration found."""

    langs: list[str]
    parts: list[tuple[str, int, int]]
    temperature: float = 1.0
    mean: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    noise: float = 3.0
    z: float = 6.0

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and its number of 4-grams."""
        if not self.parts:
            return np.full((len(texts), 0), np.nan), np.zeros(len(texts), np.int64)
        out, sizes = 0.0, np.zeros(len(texts), np.int64)
        for uri, low, high in self.parts:
            own, sizes = load(uri, len(self.parts) == 1).score(texts, (low, high))
            out = out + own
        return out, sizes

    def scored(self, batches: Iterator[pa.RecordBatch], text: int, held_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Batches with their scores; several are held together when there is more than one part to read."""
        held, size = [], 0

        def judged():
            bits, n = self.score([t for b in held for t in b.column(text).to_pylist()])
            ends = np.cumsum([b.num_rows for b in held])
            for b, end in zip(held, ends.tolist(), strict=True):
                yield b, bits[end - b.num_rows : end], n[end - b.num_rows : end]

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(self.parts) < 2 or size >= held_bytes:
                yield from judged()
                held, size = [], 0
        if held:
            yield from judged()


def _arrays(counts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not counts.num_rows:
        return np.zeros(0, str), np.zeros(0, U64), np.zeros(0, np.int64)
    return counts.column("lang").to_numpy(zero_copy_only=False).astype(str), counts.column("gram").to_numpy().view(U64), counts.column("n").to_numpy()


def build(counts: pa.Table, pairs: pa.Table, discount: float = 0.75) -> Part:
    """Kneser-Ney levels per language from ``(lang, gram, n)`` of a part and, as ``pairs``, the
    continuation counts of order 2 over all parts."""
    names, codes, n = _arrays(counts)
    pair_names, pair_codes, pair_n = _arrays(pairs)
    langs = sorted(set(pair_names.tolist()))
    levels = []
    for lang in langs:
        own, weight = codes[names == lang], n[names == lang]
        stack = [_level(own, weight)]
        own, weight = np.unique(own & U64((1 << 48) - 1), return_counts=True)  # continuation counts
        stack.append(_level(own, weight))
        own, weight = pair_codes[pair_names == lang], pair_n[pair_names == lang]
        stack.append(_level(own, weight))
        own, weight = np.unique(own & U64(0xFFFF), return_counts=True)
        stack.append(_level(own, weight))
        levels.append(stack[::-1])
    part = Part(langs, levels, len(np.unique(pair_codes & U64(0xFFFF))), discount)
    every = np.unique(codes)
    hashed = mix(every)
    order = np.argsort(hashed)
    part.keys = hashed[order]
    part.bits = np.stack([part.entropy(every, k).astype(np.float32)[order] for k in range(len(langs))], axis=1)
    return part


def _build(folder: str, pairs: str, ranges: list[tuple[int, int]]):
    """Write one part; its file is named by the attempt, so only what a finished task returned is read."""

    def run(table: pa.Table) -> pa.Table:
        low, high = ranges[table.column("part")[0].as_py()]
        with pa.ipc.open_stream(files.read(pairs)) as reader:
            part = build(table, reader.read_all())
        uri = f"{folder}/{files.attempt_name(f'part-{low}', '.pickle')}"
        files.write(uri, pickle.dumps(part, pickle.HIGHEST_PROTOCOL))
        return pa.table({"uri": [uri], "low": [low], "high": [high]})

    return run


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id's text leaves no remainder; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of smallest hash. A threshold on the hash first leaves about twice as
    many, so that the one task that orders them sees a bounded number however many partitions there are."""
    n = rows.count()
    h = F.xxhash64(key)
    if n > 2 * most:
        rows = rows.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * most / n))
    return rows.orderBy(F.pmod(h, F.lit(1 << 40)), key).limit(most)


def train(docs: DataFrame, max_cells: int = 2_000_000, z: float = 6.0, held_bytes: int = 64 << 20) -> Model:
    """Fit on every row of ``(doc_id, lang, text)`` with lang and text."""
    spark = docs.sparkSession
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counted = rows.mapInArrow(_count, "lang string, gram long, n long")
    table = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    triples = table.select("lang", F.col("gram").bitwiseAND(F.lit((1 << 48) - 1)).alias("gram")).distinct()
    pairs = triples.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 32) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    langs = sorted(set(pairs.column("lang").to_pylist()))
    residue = F.pmod(F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(RESIDUES))
    ranges = _ranges({r.r: r.c for r in table.groupBy(residue.alias("r")).agg(F.count(F.lit(1)).alias("c")).collect()}, max(1, max_cells // max(1, len(langs))))
    folder = files.folder(spark, "langid")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pairs.schema) as out:
        out.write_table(pairs)
    files.write(f"{folder}/pairs", sink.getvalue().to_pybytes())
    dealt = spark.createDataFrame([(r, k) for k, (low, high) in enumerate(ranges) for r in range(low, high)], "r long, part int")
    parts = table.withColumn("r", residue).join(F.broadcast(dealt), "r").drop("r")
    parts = materialize(parts.groupBy("part").applyInArrow(_build(folder, f"{folder}/pairs", ranges), "uri string, low long, high long"), "parts")
    model = Model(langs, sorted((tuple(r) for r in parts.collect()), key=lambda p: p[1]), z=z)
    shipped = spark.sparkContext.broadcast(model)
    sums = rows.mapInArrow(_deviations(shipped, held_bytes), "lang string, n long, bits double, squares double, losses array<double>")
    losses = [F.sum(F.col("losses")[i]).alias(f"loss{i}") for i in range(len(TEMPERATURES))]
    return _calibrated(model, sums.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("bits").alias("bits"), F.sum("squares").alias("squares"), *losses).collect())  # one row a language


def _deviations(model, held_bytes: int):
    """Per batch and language: documents, sum and sum of squares of their own bits, and the loss at each temperature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        at = {lang: k for k, lang in enumerate(m.langs)}
        for batch, bits, n in m.scored(batches, 1, held_bytes):
            own = np.array([at.get(lang, -1) for lang in batch.column(0).to_pylist()])
            some = (n > 0) & (own >= 0)
            own, bits = own[some], bits[some]
            if not len(own):
                continue
            mine = bits[np.arange(len(own)), own]
            sums = [np.bincount(own, w, len(m.langs)) for w in (mine, mine**2)]
            low = bits.min(axis=1)
            losses = [np.bincount(own, np.log(np.exp(-t * (bits - low[:, None])).sum(axis=1)) + t * (mine - low), len(m.langs)) for t in TEMPERATURES]
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.langs, pa.string()), pa.array(np.bincount(own, minlength=len(m.langs))), *map(pa.array, sums), pa.array(list(np.stack(losses, axis=1)), pa.list_(pa.float64()))],
                ["lang", "n", "bits", "squares", "losses"],
            )

    return run


def _calibrated(model: Model, seen: list) -> Model:
    """Temperature by likelihood on a grid; mean and spread of each language's own documents."""
    rows = {r["lang"]: r for r in seen if r["n"]}
    model.mean, model.spread = [0.0] * len(model.langs), [1.0] * len(model.langs)
    if not rows:
        return model
    loss = [sum(r[f"loss{i}"] for r in rows.values()) for i in range(len(TEMPERATURES))]
    model.temperature = TEMPERATURES[int(np.argmin(loss))]
    for k, lang in enumerate(model.langs):
        r = rows[lang]
        model.mean[k] = r["bits"] / r["n"]
        model.spread[k] = max(0.15, max(0.0, r["squares"] / r["n"] - model.mean[k] ** 2) ** 0.5) if r["n"] > 1 else 0.5
    return model


def _predict(model, text: int, held_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, bits, n in m.scored(batches, text, held_bytes):
            some = np.flatnonzero(n) if m.langs else np.zeros(0, np.int64)
            pred, score, best = np.full(len(n), "und", object), np.zeros(len(n)), np.full(len(n), np.nan)
            rejected = np.ones(len(n), bool)
            if len(some):
                k = bits[some].argmin(axis=1)
                low = bits[some].min(axis=1)
                pred[some] = np.array(m.langs, object)[k]
                score[some] = 1.0 / np.exp(-m.temperature * (bits[some] - low[:, None])).sum(axis=1)
                best[some] = low
                rejected[some] = low > np.array(m.mean)[k] + m.z * (np.array(m.spread)[k] + m.noise / np.sqrt(n[some]))
            carried = [batch.column(c) for c in range(batch.num_columns) if c != text]
            names = [c for c in batch.schema.names if c != batch.schema.names[text]]
            yield pa.RecordBatch.from_arrays(
                [*carried, pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(best, pa.float64(), mask=np.isnan(best)), pa.array(rejected)], [*names, *RESULT]
            )

    return run


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None, held_bytes: int = 64 << 20) -> DataFrame:
    """The ``carry`` columns (default all) with ``lang_pred, score, entropy, rejected``."""
    docs = without(docs, RESULT)
    carry = list(docs.columns) if carry is None else carry
    carried, fields = numbered(docs, carry)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kinds = T.StructType.fromDDL("lang_pred string, score double, entropy double, rejected boolean").fields
    judged = docs.select(*carried, F.col("text").cast("string").alias("_scored")).mapInArrow(_predict(shipped, len(carry), held_bytes), T.StructType([*fields, *kinds]))
    return judged.toDF(*carry, *RESULT)
