"""Clean: shape lifted records, give them an IRI and mark their source.

A clean function takes the lifted DataFrame and returns one with the columns
``record`` (IRI), optionally ``target_schema`` and ``match_string``, and fields
(scalars, arrays of scalars, or structs one level deep).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.config import Source
from confluo.functions.terms import PIPELINE, encode_for_uri

Clean = Callable[[DataFrame], DataFrame]
RESERVED = ("record", "target_schema", "match_string")


def is_scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, T.StructType | T.ArrayType | T.MapType)


def record_iri(name: str, key: Column, kind: str = "") -> Column:
    """``<pipeline namespace><source>-<encoded key>``; ``kind`` sets entities of one source apart."""
    return F.concat(F.lit(f"{PIPELINE}{name}-{kind}"), encode_for_uri(key.cast("string")))


def default_clean(lifted: DataFrame, source: Source) -> DataFrame:
    """Records are the rows that have the key; all their literal (scalar) fields are copied, nested ones are not."""
    if source.key is None:
        raise ValueError(f"clean: {source.name} has no clean function and no :iriSource field")
    scalars = [f.name for f in lifted.schema.fields if is_scalar(f.dataType) and f.name not in RESERVED]
    return lifted.where(F.col(source.key.column).isNotNull()).select(record_iri(source.name, F.col(source.key.column)).alias("record"), *[F.col(f"`{c}`") for c in scalars])


def split_entities(rows: DataFrame, parts: list[tuple[Column, str, list[Column], list[Column]]]) -> DataFrame:
    """Several entities from each denormalised row: (record, schema, columns, required); repeated keys collapse.

    An entity is made only where all its required columns are present.
    """
    out: DataFrame | None = None
    for record, schema, columns, required in parts:
        part = rows
        for column in required:
            part = part.where(column.isNotNull())
        part = part.select(record.alias("record"), F.lit(schema).alias("target_schema"), *columns).distinct()
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
