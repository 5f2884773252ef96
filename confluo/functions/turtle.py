"""Turtle: a reader for configuration documents and a column formatter for exports."""

from __future__ import annotations

import re
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.terms import RDF, RDF_TYPE, XSD, collated, shrink_column


class Term(NamedTuple):
    kind: str  # iri, bnode, literal
    value: str
    datatype: str | None = None
    lang: str | None = None


Triple = tuple[Term, str, Term]

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<dir>@prefix|@base|(?i:prefix|base)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[\w.-]*\w)
    |(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?<!\.))
    |(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w%:\\-](?:[\w.%:\\-]*[\w%:\\-])?)?)
    |(?P<word>a\b|true\b|false\b)
    |(?P<mark>\^\^|[;,.\[\]()])""",
    re.X | re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    return re.sub(
        r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)",
        lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1]),
        text,
        flags=re.S,
    )


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                line = text.count("\n", 0, at) + 1
                raise ValueError(f"turtle: unexpected {text[at : at + 20]!r} in line {line}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.fresh = 0, {}, "", 0
        self.triples: list[Triple] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if mark is not None and token[1] != mark or token[0] == "end":
            raise ValueError(f"turtle: expected {mark or 'a term'}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def iri(self, raw: str) -> str:
        value = _unescape(raw[1:-1])
        return value if re.match(r"[A-Za-z][\w+.-]*:", value) else self.base + value

    def name(self, raw: str) -> str:
        prefix, _, local = raw.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"turtle: unknown prefix {prefix}:")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def blank(self) -> Term:
        self.fresh += 1
        return Term("bnode", f"b{self.fresh}")

    def term(self) -> Term:
        kind, raw = self.take()
        if kind == "iri":
            return Term("iri", self.iri(raw))
        if kind == "name":
            return Term("iri", self.name(raw))
        if kind == "bnode":
            return Term("bnode", raw[2:])
        if kind in ("text", "long"):
            value = _unescape(raw[3:-3] if kind == "long" else raw[1:-1])
            if self.peek()[0] == "lang":
                return Term("literal", value, RDF + "langString", self.take()[1][1:].lower())
            if self.peek()[1] == "^^":
                self.take()
                return Term("literal", value, self.term().value)
            return Term("literal", value, XSD + "string")
        if kind == "num":
            local = "double" if re.search("[eE]", raw) else "decimal" if "." in raw else "integer"
            return Term("literal", raw, XSD + local)
        if raw in ("true", "false"):
            return Term("literal", raw, XSD + "boolean")
        if raw == "[":
            node = self.blank()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node
        if raw == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            head = Term("iri", RDF + "nil")
            for item in reversed(items):
                node = self.blank()
                self.triples += [(node, RDF + "first", item), (node, RDF + "rest", head)]
                head = node
            return head
        raise ValueError(f"turtle: unexpected {raw!r}")

    def properties(self, subject: Term) -> None:
        while True:
            kind, raw = self.peek()
            predicate = RDF_TYPE if raw == "a" and kind == "word" else None
            if predicate:
                self.take()
            else:
                predicate = self.term().value
            while True:
                self.triples.append((subject, predicate, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                if self.peek()[1] in (".", "]", "") or self.peek()[1] == ";":
                    continue
                break
            else:
                return
            if self.peek()[1] in (".", "]"):
                return

    def run(self) -> list[Triple]:
        while self.peek()[0] != "end":
            kind, raw = self.peek()
            if kind == "dir":
                self.take()
                if raw.lstrip("@").lower() == "prefix":
                    prefix = self.take()[1].rstrip(":")
                    self.prefixes[prefix] = self.iri(self.take()[1])
                else:
                    self.base = self.iri(self.take()[1])
                if raw[0] == "@":
                    self.take(".")
                continue
            subject = self.term()
            if self.peek()[1] != ".":
                self.properties(subject)
            self.take(".")
        return self.triples


def parse(text: str) -> list[Triple]:
    """The triples of a Turtle document, in order; ValueError names what does not parse."""
    return _Reader(text).run()


class Graph:
    """Lookups over parsed triples, in document order."""

    def __init__(self, triples: list[Triple]):
        self.triples = triples
        self._of: dict[tuple[str, str], list[Term]] = defaultdict(list)
        for s, p, o in triples:
            if o not in self._of[s.value, p]:
                self._of[s.value, p].append(o)

    def objects(self, subject: str, predicate: str) -> list[str]:
        return [o.value for o in self._of.get((subject, predicate), [])]

    def first(self, subject: str, predicate: str) -> str | None:
        return next(iter(self.objects(subject, predicate)), None)

    def terms(self, subject: str, predicate: str) -> list[Term]:
        return self._of.get((subject, predicate), [])

    def subjects_of_type(self, kind: str) -> list[str]:
        return list(dict.fromkeys(s.value for s, p, o in self.triples if p == RDF_TYPE and o.value == kind))

    def pairs(self, predicate: str) -> list[tuple[str, str]]:
        return list(dict.fromkeys((s.value, o.value) for s, p, o in self.triples if p == predicate))


PLAIN = r"^[A-Za-z][A-Za-z0-9-]*:[A-Za-z_0-9][A-Za-z0-9_-]*$"


def escape_literal(value: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def iri_text(iri: Column, prefixes: dict[str, str]) -> Column:
    """Prefixed where the local part allows it, else in angle brackets; blank nodes (``_:``) as they are."""
    short = shrink_column(iri, prefixes)
    return F.when(((short != iri) & short.rlike(PLAIN)) | iri.startswith("_:"), short).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def term_text(prefixes: dict[str, str]) -> Column:
    """The term columns value, kind, datatype and lang as Turtle."""
    quoted = F.concat(F.lit('"'), escape_literal(F.col("value")), F.lit('"'))
    typed = F.col("datatype").isNotNull() & ~F.col("datatype").isin(XSD + "string", RDF + "langString")
    return (
        F.when(F.col("kind") == "iri", iri_text(F.col("value"), prefixes))
        .when(F.col("kind") == "bnode", F.concat(F.lit("_:"), F.col("value")))
        .when(F.col("lang").isNotNull(), F.concat(quoted, F.lit("@"), F.col("lang")))
        .when(typed, F.concat(quoted, F.lit("^^"), iri_text(F.col("datatype"), prefixes)))
        .otherwise(quoted)
    )


def blocks(statements: DataFrame, prefixes: dict[str, str], subject: str = "entity_iri") -> DataFrame:
    """``(subject, block)``: one Turtle block per subject, type first, then by predicate.

    A block is bounded by one subject's statements; ordering across blocks is the writer's.
    """
    predicate = F.when(F.col("predicate") == RDF_TYPE, F.lit("a")).otherwise(iri_text(F.col("predicate"), prefixes))
    lines = (
        statements.select(subject, "predicate", "value", "kind", "datatype", "lang")
        .distinct()
        .withColumn("_o", term_text(prefixes))
        .groupBy(subject, "predicate")
        .agg(F.array_sort(F.collect_list("_o")).alias("_objects"))
        .select(subject, F.struct((F.col("predicate") != RDF_TYPE).alias("later"), F.col("predicate"), F.concat_ws(" ", predicate, F.concat_ws(", ", "_objects")).alias("line")).alias("_line"))
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x["line"]), ";\n    ")
    return lines.groupBy(subject).agg(body.alias("_body")).select(
        F.col(subject).alias("subject"), F.concat(iri_text(F.col(subject), prefixes), F.lit(" "), F.col("_body"), F.lit(".")).alias("block")
    )


def header(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {p}: <{base}>.\n" for p, base in prefixes.items()) + "\n"


def write(statements: DataFrame, path: str, prefixes: dict[str, str], subject: str = "entity_iri") -> None:
    """Turtle text files at ``path``, ordered by subject in locale order; every file starts with the prefixes only once, in the first."""
    spark = statements.sparkSession
    ordered = blocks(statements, prefixes, subject).orderBy(collated(F.col("subject")), "subject").select("block")
    spark.createDataFrame([(header(prefixes).rstrip("\n") + "\n",)], "block string").union(ordered).write.mode("overwrite").text(path)


def document(statements: DataFrame, prefixes: dict[str, str], subject: str = "entity_iri") -> str:
    """The whole document as one string; for small results such as configurations and tests."""
    rows = blocks(statements, prefixes, subject).orderBy(collated(F.col("subject")), "subject").toLocalIterator()
    return header(prefixes) + "".join(r.block + "\n" for r in rows)
