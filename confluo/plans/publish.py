"""What a run publishes: its tables as Parquet snapshots, its graphs as Turtle, its steps as p-plan journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.config import Federation
from confluo.functions import turtle
from confluo.functions.terms import COMMON_PREFIXES, PIPELINE, RDF, RDF_TYPE, XSD, local_name

# Vocabularies of provenance and of plans.
PROV = "http://www.w3.org/ns/prov#"
PLAN = "http://purl.org/net/p-plan#"


def _term(value: Column, kind: str = "iri", datatype: str | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [value.cast("string").alias("value"), F.lit(kind).alias("kind"), (F.lit(XSD + datatype) if datatype else none).alias("datatype"), none.alias("lang")]


def _facts(rows: DataFrame, subject: Column, predicate: str, *term: Column) -> DataFrame:
    return rows.select(subject.cast("string").alias("entity_iri"), F.lit(predicate).alias("predicate"), *term)


def match_facts(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """The cluster log as facts: clusters with members, and per matching pair its evidence, scores rounded for display."""
    v = PIPELINE
    node = F.concat(F.lit("_:e"), F.substring(F.sha1(F.concat_ws("\n", "rule", "a", "b", F.col("manual").cast("string"))), 1, 20))
    evidence = pairs.withColumn("node", node)
    computed = evidence.where(~F.col("manual"))
    each = computed.select("node", F.posexplode("scores").alias("place", "s")).select(F.concat("node", F.lit("c"), F.col("place")).alias("part"), "node", "s")
    decimal = lambda c, digits: F.format_string(f"%.{digits}f", c)
    parts = [
        _facts(clusters.select("entity_iri").distinct(), F.col("entity_iri"), RDF_TYPE, *_term(F.lit(v + "MatchCluster"))),
        _facts(clusters, F.col("entity_iri"), v + "hasMember", *_term(F.col("member"))),
        _facts(evidence, F.col("entity_iri"), v + "hasMatchEvidence", *_term(F.substring("node", 3, 99), "bnode")),
        _facts(evidence, F.col("node"), RDF_TYPE, *_term(F.lit(v + "MatchEvidence"))),
        _facts(evidence, F.col("node"), v + "pair", *_term(F.col("a"))),
        _facts(evidence, F.col("node"), v + "pair", *_term(F.col("b"))),
        _facts(evidence.where("manual"), F.col("node"), v + "viaManualMatch", *_term(F.lit("true"), "literal", "boolean")),
        _facts(computed, F.col("node"), v + "aggregateScore", *_term(decimal(F.col("aggregate"), 3), "literal", "decimal")),
        _facts(computed, F.col("node"), v + "similarityAlgorithm", *_term(F.col("algorithm"), "literal")),
        _facts(each, F.col("node"), v + "onCriterion", *_term(F.substring("part", 3, 99), "bnode")),
        _facts(each, F.col("part"), v + "on", *_term(F.col("s.on"))),
        _facts(each, F.col("part"), v + "similarity", *_term(decimal(F.col("s.similarity"), 3), "literal", "decimal")),
        _facts(each, F.col("part"), v + "weight", *_term(decimal(F.col("s.weight"), 2), "literal", "decimal")),
        _facts(each, F.col("part"), v + "valueA", *_term(F.col("s.value_a"), "literal")),
        _facts(each, F.col("part"), v + "valueB", *_term(F.col("s.value_b"), "literal")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def provenance_lines(provenance: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``(line)``: per source statement a reifier of the merged statement that names the record it was derived from."""
    triple = F.concat_ws(" ", turtle.iri_text(F.col("entity_iri"), prefixes), turtle.iri_text(F.col("predicate"), prefixes), turtle.term_text(prefixes))
    return provenance.select(F.concat(F.lit("[] rdf:reifies <<( "), triple, F.lit(" )>>; prov:wasDerivedFrom "), turtle.iri_text(F.col("record"), prefixes), F.lit(".")).alias("line"))


def history_lines(history: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``(line)``: one statement a revision and event, each with a nested node of entity and members."""
    members = F.array_join(F.transform("members", lambda m: turtle.iri_text(m, prefixes)), ", ")
    event = F.concat(F.lower(F.substring("event", 1, 1)), F.substring("event", 2, 99))
    head = F.concat(F.lit("cdp:revision-"), F.col("revision"), F.lit(" a cdp:Revision; prov:atTime "), F.date_format("at_time", "'\"'yyyy-MM-dd'T'HH:mm:ss.SSS'Z\"'"), F.lit("^^xsd:dateTime; cdp:"))
    return history.select(F.concat(head, event, F.lit(" [ cdp:entity "), turtle.iri_text(F.col("entity_iri"), prefixes), F.lit("; cdp:member "), members, F.lit(" ].")).alias("line"))


def _write_lines(lines: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    spark = lines.sparkSession
    spark.createDataFrame([(turtle.header(prefixes).rstrip("\n") + "\n",)], "line string").union(lines).write.mode("overwrite").text(path)


def step_iri(step: str) -> str:
    """``fetch-alpha`` to ``fetchAlpha``, ``map`` to ``mapStep``."""
    kind, _, name = step.partition("-")
    return kind + name[0].upper() + name[1:] if name else f"{kind}Step"


def journal_turtle(fed: Federation, rows: list[tuple], kinds: tuple[str, ...]) -> str:
    """The p-plan statements of the steps of these kinds, in the order they ran."""
    of = {s.name: local_name(s.iri) for s in fed.sources}
    out = turtle.header({"": PIPELINE, "p-plan": PLAN})
    for step, kind, source, after, *_ in rows:
        if kind in kinds:
            parts = [f":{step_iri(step)} a :{kind.capitalize()}, p-plan:Step"]
            parts += [f":fromSource :{of.get(source, source)}"] if source else []
            parts += ["p-plan:isPrecededBy " + ", ".join(f":{step_iri(a)}" for a in after)] if after else []
            out += "; ".join(parts) + " .\n"
    return out


def write_graphs(result, folder: str) -> None:
    """mapped, matches, merged, provenance, final, identity and history as Turtle below ``folder``."""
    cdf = result.federation.rules[0].namespace
    prefixes = {**COMMON_PREFIXES, "cdp": PIPELINE, "cdf": cdf}
    turtle.write(result.mapped, f"{folder}/mapped", prefixes, "record")
    turtle.write(match_facts(result.clusters, result.pairs), f"{folder}/matches", prefixes)
    turtle.write(result.merged, f"{folder}/merged", prefixes)
    _write_lines(provenance_lines(result.provenance, prefixes), f"{folder}/provenance", {**prefixes, "prov": PROV, "rdf": RDF})
    turtle.write(result.final, f"{folder}/final", {**COMMON_PREFIXES, "cdf": cdf})
    if result.federation.harvesting:
        turtle.write(_facts(result.registry, F.col("entity_iri"), PIPELINE + "hasMember", *_term(F.col("member"))), f"{folder}/identity", prefixes)
        _write_lines(history_lines(result.history, prefixes), f"{folder}/history", {**prefixes, "prov": PROV, "xsd": XSD})


__all__ = ["history_lines", "journal_turtle", "match_facts", "provenance_lines", "step_iri", "write_graphs"]
