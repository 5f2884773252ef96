"""Exports of selected fields: CSV, JSON, JSON-LD, Turtle and the target schema."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.config import Federation
from confluo.functions import turtle
from confluo.functions.terms import COMMON_PREFIXES, IDENTIFIER, compact

Exporter = Callable[[DataFrame], DataFrame | bytes]


def field_offer(spark: SparkSession, fed: Federation, final: DataFrame, prefixes: dict[str, str] = COMMON_PREFIXES) -> DataFrame:
    """Declared target predicates that have data, without the identifier: ``(predicate, label)``."""
    rows = list({f.predicate: (f.predicate, compact(f.predicate, prefixes)) for f in fed.fields if f.predicate != IDENTIFIER}.values())
    return spark.createDataFrame(rows, "predicate string, label string").join(final.select("predicate").distinct(), "predicate", "left_semi")


def selected(final: DataFrame, predicates: list[str]) -> DataFrame:
    return final.where(F.col("predicate").isin(predicates))


def wide(final: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row a subject with data: ``iri`` and per field (predicate to label) its values joined by ``; ``."""
    cells = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("predicate") == p, F.col("value")))), "; ").alias(label) for p, label in fields.items()]
    return selected(final, list(fields)).groupBy(F.col("entity_iri").alias("iri")).agg(*cells)


def csv_escape(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\n\r]'), quoted).otherwise(value)


def csv_lines(final: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``(iri, line)``: quoted only where needed."""
    rows = wide(final, fields)
    return rows.select("iri", F.concat_ws(",", *[csv_escape(F.col(f"`{c}`")) for c in ["iri", *fields.values()]]).alias("line"))


def csv_header(fields: dict[str, str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n\r') else c for c in ["iri", *fields.values()])


def json_string(value: Column) -> Column:
    """A JSON string literal."""
    return F.substring(F.to_json(F.struct(value.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6)


def json_objects(final: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``(iri, json)``: absent fields left out, one value as scalar, several as array."""
    rows = selected(final, list(fields)).groupBy("entity_iri", "predicate").agg(F.array_sort(F.collect_list("value")).alias("v"))
    text = F.when(F.size("v") == 1, json_string(F.col("v")[0])).otherwise(F.concat(F.lit("["), F.array_join(F.transform("v", json_string), ","), F.lit("]")))
    order = F.element_at(F.create_map(*[F.lit(x) for k, p in enumerate(fields) for x in (p, k)]), F.col("predicate"))
    label = F.element_at(F.create_map(*[F.lit(x) for p, c in fields.items() for x in (p, c)]), F.col("predicate"))
    pair = F.struct(order.alias("k"), F.concat(json_string(label), F.lit(":"), text).alias("t"))
    whole = rows.groupBy("entity_iri").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    head = F.concat(F.lit('{"iri":'), json_string(F.col("entity_iri")))
    return whole.select(F.col("entity_iri").alias("iri"), F.concat(head, F.lit(","), F.array_join(F.transform("p", lambda x: x["t"]), ","), F.lit("}")).alias("json"))


def jsonld_objects(final: DataFrame, predicates: list[str]) -> DataFrame:
    """``(iri, json)``: expanded JSON-LD, one node an entity."""
    typed = F.col("datatype").isNotNull() & F.col("lang").isNull()
    value = (
        F.when(F.col("kind") == "iri", F.concat(F.lit('{"@id":'), json_string(F.col("value")), F.lit("}")))
        .when(F.col("lang").isNotNull(), F.concat(F.lit('{"@value":'), json_string(F.col("value")), F.lit(',"@language":'), json_string(F.col("lang")), F.lit("}")))
        .when(typed, F.concat(F.lit('{"@value":'), json_string(F.col("value")), F.lit(',"@type":'), json_string(F.col("datatype")), F.lit("}")))
        .otherwise(F.concat(F.lit('{"@value":'), json_string(F.col("value")), F.lit("}")))
    )
    rows = selected(final, predicates).withColumn("_v", value).groupBy("entity_iri", "predicate").agg(F.array_sort(F.collect_list("_v")).alias("v"))
    part = F.concat(json_string(F.col("predicate")), F.lit(":["), F.array_join("v", ","), F.lit("]"))
    whole = rows.withColumn("_p", part).groupBy("entity_iri").agg(F.array_sort(F.collect_list("_p")).alias("p"))
    return whole.select(F.col("entity_iri").alias("iri"), F.concat(F.lit('{"@id":'), json_string(F.col("entity_iri")), F.lit(","), F.array_join("p", ","), F.lit("}")).alias("json"))


def write(final: DataFrame, fields: dict[str, str], fmt: str, path: str, prefixes: dict[str, str] = COMMON_PREFIXES) -> None:
    """Write the selected fields as ``csv``, ``json`` (lines), ``jsonld`` (lines) or ``ttl`` files."""
    if fmt == "csv":
        wide(final, fields).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "jsonld"):
        rows = json_objects(final, fields) if fmt == "json" else jsonld_objects(final, list(fields))
        rows.select("json").write.mode("overwrite").text(path)
    elif fmt == "ttl":
        turtle.write(selected(final, list(fields)), path, prefixes)
    else:
        raise ValueError(f"export: unknown format {fmt} - use csv, json, jsonld, ttl")


def schema_overview(spark: SparkSession, fed: Federation, prefixes: dict[str, str] = COMMON_PREFIXES) -> DataFrame:
    """``(schema, targetClass, relationships)``."""
    links: dict[str, list[str]] = {}
    for m in fed.mappings:
        for r in m.relationships:
            to, field = fed.schema(r.to_schema), fed.field(r.to_field)
            if to and field and m.target:
                text = f"{compact(field.predicate, prefixes)} -> {to.label or to.iri}"
                links.setdefault(m.target, []).append(text)
    rows = [(s.label or s.iri, compact(s.target_class, prefixes), "; ".join(dict.fromkeys(links.get(s.iri, [])))) for s in fed.schemas]
    return spark.createDataFrame(rows, "schema string, targetClass string, relationships string")


def schema_fields(spark: SparkSession, fed: Federation, schema: str, prefixes: dict[str, str] = COMMON_PREFIXES) -> DataFrame:
    """``(predicate, multiValued, resolveOverride)`` of one target schema."""
    rows = [(compact(f.predicate, prefixes), "true" if f.multi_valued else "", fed.resolve.overrides.get(f.predicate, "")) for f in fed.schema(schema).fields]
    return spark.createDataFrame(rows, "predicate string, multiValued string, resolveOverride string")


def dump_schemas(spark: SparkSession, fed: Federation, path: str) -> None:
    """overview and one table per schema as CSV below ``path``."""
    schema_overview(spark, fed).coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(path, "overview"))
    for s in fed.schemas:
        schema_fields(spark, fed, s.iri).coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(path, (s.label or s.iri).replace("/", "_")))


class Exporters:
    """Instance plug-ins by name; each gets the final facts."""

    def __init__(self):
        self.by_name: dict[str, Exporter] = {}

    def add(self, name: str, exporter: Exporter) -> None:
        self.by_name[name] = exporter

    def run(self, name: str, final: DataFrame) -> DataFrame | bytes:
        if name not in self.by_name:
            raise ValueError(f"export: no exporter {name} - have {', '.join(sorted(self.by_name)) or 'none'}")
        return self.by_name[name](final)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
