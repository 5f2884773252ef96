"""Merge: rewrite records to entities, as a set of facts and with provenance per statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.functions.terms import MATCH_STRING


def rewritten(mapped: DataFrame, clusters: DataFrame) -> DataFrame:
    """Facts under their entity, with the record they came from; ``clusters`` is ``(entity_iri, member)``.

    Facts of records in no cluster go; IRI objects that are clustered records become entities.
    """
    of = clusters.select(F.col("member").alias("record"), "entity_iri")
    to = clusters.select(F.col("member").alias("_member"), F.col("entity_iri").alias("_entity"))
    facts = mapped.where(F.col("predicate") != MATCH_STRING).join(of, "record")
    facts = facts.join(to, (F.col("kind") == "iri") & (F.col("value") == F.col("_member")), "left")
    return facts.withColumn("value", F.coalesce("_entity", "value")).drop("_member", "_entity")


def provenance(mapped: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per source statement: what it says about the entity, and the record it was derived from."""
    return rewritten(mapped, clusters).select("entity_iri", "predicate", "value", "kind", "datatype", "lang", "record", "source")


def merged(provenance_rows: DataFrame) -> DataFrame:
    """The distinct statements of all members of each entity."""
    return provenance_rows.select("entity_iri", "predicate", "value", "kind", "datatype", "lang").distinct()
