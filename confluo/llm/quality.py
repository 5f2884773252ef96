"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Semantics
---------
* Grades are integers in order, worst first. One weight vector over hashed features is
  shared by all thresholds: ``P(grade > k) = sigmoid(w . x - theta_k)`` with
  ``theta_0 <= theta_1 <= ...``.
* Features are the distinct lower-cased words of the whole text, the share of each kind of
  punctuation and of capitals on a logarithmic scale, hashed into
  ``2 ** bits`` places; a feature is present or absent.
* Per row: ``expected_grade``, ``tail`` (probability of grade >= ``tail_from``) and ``above``
  (probability of more than each grade but the last), for selection at any of them.

Bounds: the model is fitted on at most ``max_rows`` rated rows, those with the smallest
hash of doc_id. Which features count is decided from their numbers per grade (``2 ** bits`` rows a grade), summed
in the cluster; the driver gets only those features of the rated rows. The weights are ``2 ** bits`` numbers of 4 bytes;
scoring covers every row.

Edge cases: null and empty text have no words and get what the thresholds alone
say; rows without grade are not learned from; several ratings of one document each
count; without ratings every grade is equally likely; repeated rows agree; an
empty table gives an empty result; of several ratings with one hash the smaller doc_id counts first; a very long
text is scored whole in one task, with some 40 bytes a byte of text; extra columns of any name stay, names of result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.llm.bytesops import ALNUM, ASCII_LOWER, U64, blocks, mix, utf8, word_hashes, word_spans
from confluo.llm.langid import by_hash
from confluo.llm.names import numbered, without
from confluo.plans.shared import materialize

RESULT = ["expected_grade", "tail", "above"]
MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n0123456789", np.uint8)


def hashed_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows, one after the other, and how many each row has."""
    starts, ends, first = word_spans(ASCII_LOWER[data], offsets, ALNUM)
    places = (word_hashes(ASCII_LOWER[data], starts, ends) >> U64(64 - bits)).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    size = np.maximum(np.diff(offsets), 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    kind = np.full(256, -1)
    kind[MARKS] = np.arange(len(MARKS))
    kind[65:91] = len(MARKS)
    slot = kind[data]
    some = slot >= 0
    counts = np.bincount(row[some] * (len(MARKS) + 1) + slot[some], minlength=(len(offsets) - 1) * (len(MARKS) + 1)).reshape(-1, len(MARKS) + 1)
    r, k = np.nonzero(counts)
    level = np.floor(np.log2(counts[r, k] * 1024 / size[r])).astype(np.int64)
    marked = (mix(k.astype(U64) * U64(64) + (level + 32).astype(U64) + U64(1 << 40)) >> U64(64 - bits)).astype(np.int64)
    pair = np.unique(np.concatenate((rows, r)) << bits | np.concatenate((places, marked)))
    return pair & ((1 << bits) - 1), np.bincount(pair >> bits, minlength=len(offsets) - 1)


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def above(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) per row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -50, 50)))

    def score(self, data: np.ndarray, offsets: np.ndarray, tail_from: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places, n = hashed_features(data, offsets, self.bits)
        s = np.bincount(np.repeat(np.arange(len(n)), n), self.weights[places], len(n))
        over = self.above(s)
        steps = np.diff(np.array(self.grades, float))
        tail = over[:, self.grades.index(tail_from) - 1] if self.grades.index(tail_from) else np.ones(len(n))
        return self.grades[0] + over @ steps, tail, over


def _loss(v: np.ndarray, y: np.ndarray, rows: np.ndarray, local: np.ndarray, n_used: int, prior: float) -> tuple[float, np.ndarray]:
    """Negative log-posterior of the cumulative-link model and its gradient; v = weights, first threshold, log gaps."""
    w, base, gaps = v[:n_used], v[n_used], v[n_used + 1 :]
    theta = base + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    s = np.bincount(rows, w[local], len(y))
    over = 1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -50, 50)))
    padded = np.concatenate((np.ones((len(y), 1)), over, np.zeros((len(y), 1))), axis=1)
    each = np.arange(len(y))
    high, low = padded[each, y], padded[each, y + 1]
    p = np.maximum(high - low, 1e-12)
    g_s = high + low - 1
    slope = padded * (1 - padded)
    g_theta = np.array([-((y == k) * slope[:, k + 1] / p - (y == k + 1) * slope[:, k + 1] / p).sum() for k in range(len(theta))])
    g_w = np.bincount(local, g_s[rows], n_used) + w / prior
    g_gaps = np.cumsum(g_theta[::-1])[::-1][1:] * np.exp(gaps)
    return float(-np.log(p).sum() + (w * w).sum() / (2 * prior)), np.concatenate((g_w, [g_theta.sum()], g_gaps))


def _minimise(f, v: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, grad = f(v)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for ds, dg in reversed(past):
            alphas.append(ds @ q / (ds @ dg))
            q -= alphas[-1] * dg
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).sum())
        for (ds, dg), a in zip(past, reversed(alphas), strict=True):
            q += ds * (a - dg @ q / (ds @ dg))
        slope, rate = -(grad @ q), 1.0
        for _ in range(25):
            fresh_value, fresh_grad = f(v - rate * q)
            if fresh_value <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        ds, dg = -rate * q, fresh_grad - grad
        if ds @ dg > 1e-10:
            past = [*past[1 - memory :], (ds, dg)]
        done = value - fresh_value < 1e-6 * max(1.0, abs(value))
        v, value, grad = v + ds, fresh_value, fresh_grad
        if done:
            break
    return v


def screened(counts: np.ndarray, n_rows: np.ndarray, rare: int = 5, screen: float = 4.0) -> np.ndarray:
    """Which features count, from rows per grade and feature and rows per grade.

    Not those that fewer than ``rare`` rows have, nor those whose rows at no threshold differ from all
    rows by ``screen`` standard errors.
    """
    count, strong = counts.sum(axis=0), np.zeros(counts.shape[1], bool)
    for k in range(len(n_rows) - 1):
        p = n_rows[k + 1 :].sum() / n_rows.sum()
        over = counts[k + 1 :].sum(axis=0)
        strong |= np.abs(over - count * p) >= screen * np.sqrt(np.maximum(count, 1) * p * (1 - p))
    return strong & (count >= rare)


def fit(grade: np.ndarray, places: np.ndarray, n: np.ndarray, bits: int, rounds: int = 80, prior: float = 10.0) -> Ordinal:
    """Maximum a posteriori weights of the given features (``n`` per row) under a normal prior; other weights are 0."""
    grades = sorted(set(grade.tolist()))
    if len(grades) < 2:
        grades = grades or [0]
        grades = [grades[0] - 1, *grades] if grades[0] > 0 else [*grades, grades[0] + 1]
        return Ordinal(grades, np.zeros(1 << bits), np.zeros(1), bits)
    y = np.searchsorted(grades, grade)
    share = np.cumsum(np.bincount(y))[:-1] / len(y)
    start = np.log(share / (1 - share))
    rows = np.repeat(np.arange(len(y)), n)
    used, local = np.unique(places, return_inverse=True)
    local = local.reshape(-1)
    # thresholds are a first one and positive gaps, so their order holds throughout
    v = np.concatenate((np.zeros(len(used)), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))))
    v = _minimise(lambda x: _loss(x, y, rows, local, len(used), prior), v, rounds)
    weights = np.zeros(1 << bits)
    weights[used] = v[: len(used)]
    return Ordinal(grades, weights, v[len(used)] + np.concatenate(([0.0], np.cumsum(np.exp(v[len(used) + 1 :])))), bits)


def _hash(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets, 1 << 20):
                places, n = hashed_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                cuts = np.concatenate(([0], np.cumsum(n)))
                own = [places[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own, pa.binary())], ["grade", "places"])

    return run


def train(docs: DataFrame, ratings: DataFrame, bits: int = 18, max_rows: int = 20_000) -> Ordinal:
    """Fit on ``docs(doc_id, text)`` joined with ``ratings(doc_id, grade)``."""
    rated = ratings.where("grade is not null").select(F.col("doc_id").alias("_id"), F.col("grade").cast("long").alias("grade"))
    rated = by_hash(rated, "_id", max_rows)
    # at most max_rows ids and grades: their bound allows a broadcast, so no text is shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(rated), F.col("doc_id") == F.col("_id")).select("grade", "text")
    seen = materialize(rows.mapInArrow(_hash(bits), "grade long, places binary"), "rated")
    n_rows = {r.grade: r.n for r in seen.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    grades = sorted(n_rows)
    counts = np.zeros((max(1, len(grades)), 1 << bits))
    table = seen.mapInArrow(_tally(bits), "grade long, place int, n long").groupBy("grade", "place").agg(F.sum("n").alias("n")).toArrow()
    counts[np.searchsorted(grades, table.column("grade").to_numpy()), table.column("place").to_numpy()] = table.column("n").to_numpy()
    strong = seen.sparkSession.sparkContext.broadcast(screened(counts, np.array([n_rows[g] for g in grades])))
    few = seen.mapInArrow(_strong(strong), "grade long, places binary").toArrow()
    parts, grade = few.column("places").to_pylist(), few.column("grade").to_numpy()
    # one order, whatever order the rows came in
    order = sorted(range(len(parts)), key=lambda k: (grade[k], parts[k]))
    places = np.frombuffer(b"".join(parts[k] for k in order), "<u4").astype(np.int32)
    return fit(grade[order], places, np.array([len(parts[k]) // 4 for k in order], np.int64), bits)


def _tally(bits: int):
    """Per task the rows of each grade that have each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for grade, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.setdefault(grade, np.zeros(1 << bits, np.int64))[np.frombuffer(places.as_buffer(), "<u4")] += 1
        for grade, own in counts.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), grade)), pa.array(some.astype(np.int32)), pa.array(own[some])], ["grade", "place", "n"])

    return run


def _strong(mask):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.frombuffer(p.as_buffer(), "<u4") for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[mask.value[p]].tobytes() for p in every], pa.binary())], ["grade", "places"])

    return run


def _score(model, carry: int, tail_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            data, offsets = utf8(batch.column(carry))
            for i, j in blocks(offsets, 1 << 20):
                grade, tail, over = m.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tail_from)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:carry], pa.array(grade), pa.array(tail), pa.array(list(over), pa.list_(pa.float64()))], [*part.schema.names[:carry], *RESULT])

    return run


def score(docs: DataFrame, model: Ordinal, tail_from: int = 1, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default all) with ``expected_grade`` and ``tail``."""
    docs = without(docs, RESULT)
    carry = list(docs.columns) if carry is None else carry
    carried, fields = numbered(docs, carry)
    tail_from = tail_from if tail_from in model.grades else model.grades[-1]
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kinds = T.StructType.fromDDL("expected_grade double, tail double, above array<double>").fields
    scored = docs.select(*carried, F.col("text").cast("string").alias("_scored")).mapInArrow(_score(shipped, len(carry), tail_from), T.StructType([*fields, *kinds]))
    return scored.toDF(*carry, *RESULT)
