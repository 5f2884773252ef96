"""Terms, names and namespaces: helpers for plain Python and for columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces of configuration vocabulary, records and common predicates.
PIPELINE = "https://civic-data.de/pipeline#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SCHEMA = "http://schema.org/"
FOAF = "http://xmlns.com/foaf/0.1/"
DCT = "http://purl.org/dc/terms/"

RDF_TYPE = RDF + "type"
IDENTIFIER = SCHEMA + "identifier"
FROM_SOURCE = PIPELINE + "fromSource"
TARGET_SCHEMA = PIPELINE + "targetSchema"
MATCH_STRING = PIPELINE + "matchString"
COMMON_PREFIXES = {"schema": SCHEMA, "foaf": FOAF, "dct": DCT}

#: Schema of a fact table: one row a statement, the value always as text with its term kind beside it.
FACTS = "record string, predicate string, value string, kind string, datatype string, lang string, source string"
TERM = ["value", "kind", "datatype", "lang"]


def local_name(iri: str) -> str:
    """What follows the last ``#`` or ``/``."""
    return re.split(r"[#/]", iri)[-1]


def local_name_of(iri: Column) -> Column:
    return F.regexp_replace(iri, r"^.*[#/]", "")


def source_name(iri: str) -> str:
    """Local name without the suffix ``Source``; names the source's folder."""
    name = local_name(iri)
    return name[: -len("Source")] if name.endswith("Source") else name


def format_family(iri: str) -> str:
    """The code of a file type without what follows an underscore: ``RDF`` of ``.../RDF_TURTLE``."""
    return local_name(iri).partition("_")[0]


def compact(iri: str, prefixes: dict[str, str]) -> str:
    """The IRI with the longest base that it starts with written as its prefix."""
    bases = {base: prefix for prefix, base in prefixes.items() if iri.startswith(base)}
    longest = max(bases, key=len, default="")
    return f"{bases[longest]}:{iri.removeprefix(longest)}" if bases else iri


def shrink_column(iri: Column, prefixes: dict[str, str]) -> Column:
    """``compact`` of a column."""
    ordered = sorted(prefixes.items(), key=lambda p: -len(p[1]))
    cases = [F.when(iri.startswith(base), F.concat(F.lit(f"{prefix}:"), F.substring(iri, F.lit(len(base) + 1), F.length(iri)))) for prefix, base in ordered]
    return F.coalesce(*cases, iri)


def encode_for_uri(text: Column) -> Column:
    """Percent-encode everything but letters, digits and ``-_.~``."""
    encoded = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    return encoded


def collated(text: Column) -> Column:
    """Locale order for sorting and minima; cast back to string for output."""
    return F.collate(text, "UNICODE")


def literal(value: Column) -> dict[str, Column]:
    none = F.lit(None).cast("string")
    return {"value": value.cast("string"), "kind": F.lit("literal"), "datatype": none, "lang": none}


def iri_term(value: Column) -> dict[str, Column]:
    none = F.lit(None).cast("string")
    return {"value": value.cast("string"), "kind": F.lit("iri"), "datatype": none, "lang": none}


def fact_columns(record: Column, predicate: Column, term: dict[str, Column], source: Column) -> list[Column]:
    named = {"record": record, "predicate": predicate, **term, "source": source}
    return [c.cast("string").alias(n) for n, c in named.items()]
