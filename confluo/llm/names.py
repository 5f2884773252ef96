"""Column names: internal ones that no table has, and tables with any names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fresh(taken: Sequence[str], *wanted: str) -> tuple[str, ...]:
    """Names like the ``wanted`` ones that differ, in any case, from those ``taken`` and from each other."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        k, own = 0, name
        while own.lower() in used:
            k, own = k + 1, f"{name}_{k}"
        used.add(own.lower())
        out.append(own)
    return tuple(out)


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def without(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """``docs`` less the columns of these names in any case."""
    lower = {n.lower() for n in names}
    return docs.select(*[named(c) for c in docs.columns if c.lower() not in lower])


def numbered(docs: DataFrame, columns: Sequence[str]) -> tuple[list[Column], list[T.StructField]]:
    """The columns under the names c0, c1, ..., for steps in Python that add columns of their own; and their fields."""
    return [named(c).alias(f"c{k}") for k, c in enumerate(columns)], [T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(columns)]


def set_aside(docs: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of these names under others, and the selection that gives all columns their names back."""
    lower = {n.lower() for n in names}
    own = [c for c in docs.columns if c.lower() in lower]
    other = dict(zip(own, fresh([*docs.columns, *names], *[f"own_{c}" for c in own]), strict=True))
    return docs.select(*[named(c).alias(other.get(c, c)) for c in docs.columns]), [named(other.get(c, c)).alias(c) for c in docs.columns]


def integer_id(docs: DataFrame, column: str) -> None:
    """ValueError, before any job, where an operator orders or stores identifiers as integers and these are none."""
    kind = docs.schema[column].dataType
    if not isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.NullType):
        raise ValueError(f"{column} must be an integer column, it is {kind.simpleString()}")
