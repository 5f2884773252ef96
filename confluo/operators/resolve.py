"""Resolve: settle conflicting values per entity and predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.config import STRATEGIES, ResolveRule
from confluo.functions.terms import FROM_SOURCE, IDENTIFIER, TERM, collated

EXCLUDED = [IDENTIFIER, FROM_SOURCE]
COLUMNS = ["entity_iri", "predicate", *TERM]


def alphabetic_first(facts: DataFrame) -> DataFrame:
    """One row a group: the smallest value in locale order, ties by bytes."""
    term = F.struct(*TERM)
    order = F.struct(collated(F.col("value")), "value", "kind", F.coalesce("datatype", F.lit("")), F.coalesce("lang", F.lit("")))
    return facts.groupBy("entity_iri", "predicate").agg(F.min_by(term, order).alias("t")).select("entity_iri", "predicate", *[f"t.{c}" for c in TERM])


def concatenate_all(facts: DataFrame) -> DataFrame:
    """One plain literal a group: the distinct values in code point order, joined by comma and space."""
    joined = F.array_join(F.array_sort(F.collect_set("value")), ", ")
    none = F.lit(None).cast("string")
    return facts.groupBy("entity_iri", "predicate").agg(joined.alias("value")).select("entity_iri", "predicate", "value", F.lit("literal").alias("kind"), none.alias("datatype"), none.alias("lang"))


def keep_all(facts: DataFrame) -> DataFrame:
    """One row a distinct value."""
    rest = F.min(F.struct("kind", "datatype", "lang")).alias("r")
    return facts.groupBy("entity_iri", "predicate", "value").agg(rest).select("entity_iri", "predicate", "value", "r.kind", "r.datatype", "r.lang")


BY_NAME = dict(zip(STRATEGIES, (alphabetic_first, concatenate_all, keep_all), strict=True))


def resolve(merged: DataFrame, rule: ResolveRule = ResolveRule()) -> DataFrame:
    """The final facts. Predicates are dealt to their strategy when the plan is made, so each branch is one aggregation."""
    for name in [rule.default, *rule.overrides.values()]:
        if name not in BY_NAME:
            raise ValueError(f"unknown resolve strategy {name} - use {', '.join(BY_NAME)}")
    facts = merged.where(~F.col("predicate").isin(EXCLUDED)).select(*COLUMNS)
    special: dict[str, list[str]] = {}
    for predicate, name in rule.overrides.items():
        special.setdefault(name, []).append(predicate)
    rest = facts.where(~F.col("predicate").isin(list(rule.overrides))) if rule.overrides else facts
    parts = [BY_NAME[rule.default](rest)]
    parts += [BY_NAME[name](facts.where(F.col("predicate").isin(own))) for name, own in sorted(special.items())]
    return reduce(DataFrame.unionByName, parts)
