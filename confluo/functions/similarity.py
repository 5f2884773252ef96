"""String similarity in whole percent: ratio, token_sort_ratio and token_set_ratio.

All three first replace what is no letter or digit by a space, lower-case and trim.
``ratio`` is ``200 * LCS / (|a| + |b|)``, rounded half up; an empty side gives 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE = re.compile(r"[\W_]+")


def process(text: str | None) -> str:
    return NOISE.sub(" ", text or "").lower().strip()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over Python integers."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    return (200 * lcs(a, b) * 2 + len(a) + len(b)) // (2 * (len(a) + len(b)))


def ratio(a: str | None, b: str | None) -> int:
    return _ratio(process(a), process(b))


def token_sort_ratio(a: str | None, b: str | None) -> int:
    return _ratio(*(" ".join(sorted(process(x).split())) for x in (a, b)))


def token_set_ratio(a: str | None, b: str | None) -> int:
    x, y = set(process(a).split()), set(process(b).split())
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    left, right = (" ".join([both, *sorted(s)]).strip() for s in (x - y, y - x))
    return max(_ratio(both, left), _ratio(both, right), _ratio(left, right))


FUNCTIONS: dict[str, Callable[[str | None, str | None], int]] = {
    "ratio": ratio,
    "token_sort_ratio": token_sort_ratio,
    "token_set_ratio": token_set_ratio,
}


def similarity(algorithm: str) -> Callable[[Column, Column], Column]:
    """An Arrow-batched column function; raises ValueError for an unknown algorithm."""
    if algorithm not in FUNCTIONS:
        raise ValueError(f'match: unknown algorithm "{algorithm}" - use {", ".join(FUNCTIONS)}')
    one = FUNCTIONS[algorithm]

    @F.pandas_udf("int")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    return score


def normal_form(algorithm: str) -> Callable[[Column], Column]:
    """An Arrow-batched column function: the string that ``ratio`` or ``token_sort_ratio`` compares."""
    one = process if algorithm == "ratio" else lambda x: " ".join(sorted(process(x).split()))

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in texts], dtype="object")

    return form


def processed(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")))


def upper_bound(algorithm: str, a: Column, b: Column) -> Column:
    """No pair of strings of these processed lengths scores above this.

    The common subsequence cannot be longer than the shorter side. Token sets have
    no such bound beyond being empty or not.
    """
    if algorithm == "token_set_ratio":
        return F.when((a > 0) & (b > 0), F.lit(100)).otherwise(F.lit(0))
    total = a + b
    return F.when(total > 0, F.floor(200.0 * F.least(a, b) / total + 0.5)).otherwise(F.lit(0))


def ratio_expression(a: Column, b: Column) -> Column:
    """``ratio`` of processed strings as one Catalyst expression (dynamic programming over arrays).

    Slower than the vectorised function; kept as an independent cross-check.
    """
    left, right = F.split(processed(a), ""), F.split(processed(b), "")
    zero = F.transform(F.sequence(F.lit(0), F.size(right)), lambda _: F.lit(0))

    def row(previous: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            same = F.element_at(right, j) == c
            best = F.when(same, F.element_at(previous, j) + 1).otherwise(F.greatest(F.element_at(previous, j + 1), F.element_at(done, -1)))
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(right)), F.array(F.lit(0)), cell)

    length = F.element_at(F.aggregate(left, zero, row), -1)
    total = F.length(processed(a)) + F.length(processed(b))
    return F.when((F.length(processed(a)) == 0) | (F.length(processed(b)) == 0), F.lit(0)).otherwise(F.floor(200.0 * length / total + 0.5).cast("int"))
