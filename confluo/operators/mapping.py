"""Map: project cleaned records onto target predicates as facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.config import Federation, Mapping, Source
from confluo.functions.terms import FACTS, FROM_SOURCE, MATCH_STRING, RDF_TYPE, TERM, XSD, fact_columns, iri_term, literal

Transform = Callable[[DataFrame], DataFrame]
NAMES = [c.split()[0] for c in FACTS.split(", ")]
DATATYPES = {T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "double", T.FloatType: "double", T.BooleanType: "boolean", T.DecimalType: "decimal"}


def _field_type(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def not_blank(value: Column) -> Column:
    """Neither null nor white space only, whatever the datatype."""
    return F.regexp_replace(value.cast("string"), r"\s+", "") != ""


def routed(cleaned: DataFrame, target: str | None) -> DataFrame:
    """Records without a schema tag, or tagged with this mapping's target."""
    if target is None or "target_schema" not in cleaned.columns:
        return cleaned
    return cleaned.where(F.col("target_schema").isNull() | (F.col("target_schema") == target))


def direct_fields(fed: Federation, mapping: Mapping, source: Source) -> list[tuple[str, str]]:
    """(column, predicate) of the mapping's fields that need no transform."""
    columns = {f.iri: f.column for f in source.fields}
    out = []
    for fm in mapping.fields:
        if fm.via is None:
            for s in fm.sources:
                for t in fm.targets:
                    field = fed.field(t)
                    if s in columns and field is not None:
                        out.append((columns[s], field.predicate))
    return out


def _literal_fact(fact: Callable[..., Column], predicate: str, datatype: Column) -> Callable[[Column], Column]:
    return lambda v: fact(predicate, v, "literal", datatype)


def direct_facts(cleaned: DataFrame, fed: Federation, mapping: Mapping) -> DataFrame | None:
    """Type, source and field facts of every routed record; None when nothing maps directly.

    Fields unpivot inside one row by an exploded array, so the source is scanned once.
    """
    source = fed.source(mapping.source)
    pairs = direct_fields(fed, mapping, source)
    if not pairs:
        return None
    schema = fed.schema(mapping.target) if mapping.target else None
    rows = routed(cleaned, mapping.target)
    none = F.lit(None).cast("string")

    def fact(predicate: str, value: Column, kind: str, datatype: Column = none) -> Column:
        return F.struct(F.lit(predicate).alias("predicate"), value.cast("string").alias("value"), F.lit(kind).alias("kind"), datatype.cast("string").alias("datatype"))

    facts = [F.array(fact(FROM_SOURCE, F.lit(mapping.source), "iri"))]
    if schema is not None:
        facts.append(F.array(fact(RDF_TYPE, F.lit(schema.target_class), "iri")))
    for column, predicate in pairs:
        kind = _field_type(rows.schema, column)
        if kind is None:
            continue
        element = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if isinstance(element, T.StructType | T.MapType | T.ArrayType):
            continue  # not a literal
        datatype = F.lit(XSD + DATATYPES[type(element)]) if type(element) in DATATYPES else none
        values = F.col(column) if isinstance(kind, T.ArrayType) else F.array(F.col(column))
        facts.append(F.transform(values, _literal_fact(fact, predicate, datatype)))
    exploded = rows.select("record", F.explode(F.concat(*facts)).alias("f"))
    return exploded.where((F.col("f.kind") == "iri") | not_blank(F.col("f.value"))).select(
        "record", "f.predicate", "f.value", "f.kind", "f.datatype", none.alias("lang"), F.lit(mapping.source).alias("source")
    )


def match_strings(cleaned: DataFrame, source: str) -> DataFrame | None:
    if "match_string" not in cleaned.columns:
        return None
    rows = cleaned.where(F.col("match_string").isNotNull())
    return rows.select(*fact_columns(F.col("record"), F.lit(MATCH_STRING), literal(F.col("match_string")), F.lit(source)))


def relationship_facts(cleaned: DataFrame, links: DataFrame, fed: Federation, mapping: Mapping) -> list[DataFrame]:
    """Links ``(record, predicate, to)`` become target predicates when both ends carry the right schema tag."""
    out = []
    if "target_schema" not in cleaned.columns:
        return out
    tags = cleaned.select("record", "target_schema").distinct()
    for r in mapping.relationships:
        field = fed.field(r.to_field)
        if field is None or mapping.target is None:
            continue
        start = tags.where(F.col("target_schema") == mapping.target).select("record")
        end = tags.where(F.col("target_schema") == r.to_schema).select(F.col("record").alias("to"))
        ends = links.where(F.col("predicate") == r.source_predicate).join(start, "record", "left_semi").join(end, "to", "left_semi")
        out.append(ends.select(*fact_columns(F.col("record"), F.lit(field.predicate), iri_term(F.col("to")), F.lit(mapping.source))))
    return out


def map_sources(
    cleaned: dict[str, DataFrame],
    fed: Federation,
    transforms: dict[tuple[str, str], Transform] | None = None,
    links: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """The mapped facts of all sources, as a set.

    ``cleaned`` and ``links`` go by source name; ``transforms`` by (source name, via) give
    facts from the cleaned records for mappings that are not direct.
    """
    transforms, links = transforms or {}, links or {}
    parts: list[DataFrame] = []
    for mapping in fed.mappings:
        source = fed.source(mapping.source)
        if source is None or source.name not in cleaned:
            continue
        rows = cleaned[source.name]
        parts.append(direct_facts(rows, fed, mapping))
        for via in sorted({f.via for f in mapping.fields if f.via}):
            if (source.name, via) not in transforms:
                raise ValueError(f"map: no transform {via} for source {source.name}")
            made = transforms[source.name, via](rows)
            have = {c: F.col(c) if c in made.columns else F.lit({"kind": "literal", "source": mapping.source}.get(c)) for c in NAMES}
            parts.append(made.select(*[c.cast("string").alias(n) for n, c in have.items()]))
        if source.name in links:
            parts += relationship_facts(rows, links[source.name], fed, mapping)
    for iri in dict.fromkeys(m.source for m in fed.mappings):
        source = fed.source(iri)
        if source is not None and source.name in cleaned:
            parts.append(match_strings(cleaned[source.name], iri))
    parts = [p for p in parts if p is not None]
    if not parts:
        raise ValueError("map: no mapping applies to any source")
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["record", "predicate", *TERM, "source"])
