"""SPARQL over a fact table, compiled to DataFrame plans.

``query(text, triples)`` takes ``(s, p, o, kind, datatype, lang)`` and optional named graphs.
Every variable is one column holding a term ``struct<value, kind, datatype, lang>``, so
patterns become equi-joins on shared variables, OPTIONAL a left join, MINUS and
NOT EXISTS anti-joins, and modifiers their DataFrame counterparts; Catalyst does the
rest. SELECT gives term columns, ASK a boolean, CONSTRUCT and DESCRIBE triples,
INSERT ... WHERE the triples to insert.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.terms import RDF, RDF_TYPE, XSD, encode_for_uri
from confluo.plans.shared import materialize

TERM_TYPE = "struct<value:string,kind:string,datatype:string,lang:string>"
NUMERIC = [XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<var>[?$]\w+)
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:\w+)
    |(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<name>(?:[A-Za-z][\w-]*)?:(?:[\w%-](?:[\w.%-]*[\w%-])?)?)
    |(?P<word>[A-Za-z_][\w]*)
    |(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*/|^?+!=<>-])""",
    re.X,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"sparql: unexpected {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: str
    kind: str = "iri"
    datatype: str | None = None
    lang: str | None = None


@dataclass
class Path:
    op: str  # iri, inverse, sequence, alternative, star, plus, maybe, not
    parts: list


def backwards(path: Path) -> Path:
    """The path that leads from what ``path`` reaches to where it starts."""
    if path.op == "inverse":
        return path.parts[0]
    if path.op in ("iri", "not"):
        return Path("inverse", [path])
    parts = [backwards(p) for p in path.parts]
    return Path(path.op, parts[::-1] if path.op == "sequence" else parts)


class Parser:
    """Recursive descent into nested tuples: patterns by kind, expressions as (operator, arguments)."""

    def __init__(self, text: str):
        self.t, self.i, self.prefixes, self.fresh = _tokens(text), 0, {"rdf": RDF, "xsd": XSD}, 0

    def peek(self, ahead: int = 0) -> str:
        return self.t[self.i + ahead][1] if self.i + ahead < len(self.t) else ""

    def kind(self) -> str:
        return self.t[self.i][0] if self.i < len(self.t) else "end"

    def word(self, *words: str) -> bool:
        """Take the next token if it is one of the words, whatever the case."""
        if self.kind() in ("word", "mark") and self.peek().upper() in words:
            self.i += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.word(mark):
            raise ValueError(f"sparql: expected {mark}, found {self.peek() or 'the end'}")

    def take(self) -> tuple[str, str]:
        if self.i >= len(self.t):
            raise ValueError("sparql: unexpected end")
        self.i += 1
        return self.t[self.i - 1]

    def new(self) -> Var:
        self.fresh += 1
        return Var(f"_b{self.fresh}")

    def iri(self, raw: str) -> str:
        if raw[0] == "<":
            return raw[1:-1]
        prefix, _, local = raw.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"sparql: unknown prefix {prefix}:")
        return self.prefixes[prefix] + local

    def parse(self) -> dict:
        while self.word("PREFIX"):
            prefix = self.take()[1].rstrip(":")
            self.prefixes[prefix] = self.take()[1][1:-1]
        if self.peek().upper() == "SELECT":
            return self.select() | {"form": "select"}
        if self.word("ASK"):
            self.word("WHERE")
            return {"form": "ask", "where": self.group()}
        if self.word("CONSTRUCT"):
            template = self.template()
            self.word("WHERE")
            return {"form": "construct", "template": template, "where": self.group()} | self.modifiers()
        if self.word("INSERT"):
            self.need("{")
            self.i -= 1
            template = self.template()
            self.need("WHERE")
            return {"form": "construct", "template": template, "where": self.group()}
        if self.word("DESCRIBE"):
            about = []
            while self.kind() in ("var", "iri", "name"):
                about.append(self.term())
            where = None
            if self.word("WHERE") or self.peek() == "{":
                where = self.group()
            return {"form": "describe", "about": about, "where": where}
        raise ValueError(f"sparql: no query form at {self.peek()!r}")

    def template(self) -> list:
        self.need("{")
        out: list = []
        while not self.word("}"):
            if self.word("GRAPH"):
                self.term()
                out += self.template()
            else:
                self.triples(out)
                self.word(".")
        return out

    def select(self) -> dict:
        self.need("SELECT")
        distinct = self.word("DISTINCT") or self.word("REDUCED")
        items: list | None = []
        if self.word("*"):
            items = None
        else:
            while self.kind() == "var" or self.peek() == "(":
                if self.kind() == "var":
                    v = self.take()[1][1:]
                    items.append((("var", v), v))
                else:
                    items.append(self.as_item())
        self.word("WHERE")
        return {"distinct": distinct, "items": items, "where": self.group()} | self.modifiers()

    def as_item(self) -> tuple:
        self.need("(")
        e = self.expression()
        self.need("AS")
        name = self.take()[1][1:]
        self.need(")")
        return e, name

    def modifiers(self) -> dict:
        m: dict = {"group": None, "having": [], "order": [], "limit": None, "offset": None, "values": None}
        while True:
            if self.word("GROUP"):
                self.need("BY")
                m["group"] = []
                while self.kind() == "var" or self.peek() == "(" or self.kind() == "word" and self.peek(1) == "(" and self.peek().upper() not in ("HAVING",):
                    if self.kind() == "var":
                        v = self.take()[1][1:]
                        m["group"].append((("var", v), v))
                    elif self.peek() == "(":
                        m["group"].append(self.as_item())
                    else:
                        m["group"].append((self.expression(), self.new().name))
            elif self.word("HAVING"):
                while self.peek() == "(":
                    m["having"].append(self.primary())
            elif self.word("ORDER"):
                self.need("BY")
                while self.kind() == "var" or self.peek() == "(" or self.peek().upper() in ("ASC", "DESC") or self.kind() == "word" and self.peek(1) == "(":
                    down = self.word("DESC")
                    if not down:
                        self.word("ASC")
                    m["order"].append((self.primary(), down))
            elif self.word("LIMIT"):
                m["limit"] = int(self.take()[1])
            elif self.word("OFFSET"):
                m["offset"] = int(self.take()[1])
            elif self.word("VALUES"):
                m["values"] = self.values()
            else:
                return m

    def values(self) -> tuple:
        names = []
        if self.word("("):
            while not self.word(")"):
                names.append(self.take()[1][1:])
            many = True
        else:
            names, many = [self.take()[1][1:]], False
        rows = []
        self.need("{")
        while not self.word("}"):
            if many:
                self.need("(")
                row = []
                while not self.word(")"):
                    row.append(None if self.word("UNDEF") else self.term())
                rows.append(row)
            else:
                rows.append([None if self.word("UNDEF") else self.term()])
        return "values", names, rows

    def group(self) -> list:
        self.need("{")
        if self.peek().upper() == "SELECT":
            inner = self.select()
            self.need("}")
            return [("sub", inner)]
        out: list = []
        bgp: list = []

        def flush():
            nonlocal bgp
            if bgp:
                out.append(("bgp", bgp))
                bgp = []

        while not self.word("}"):
            if self.word("OPTIONAL"):
                flush()
                out.append(("optional", self.group()))
            elif self.word("MINUS"):
                flush()
                out.append(("minus", self.group()))
            elif self.word("FILTER"):
                negate = False
                if self.word("NOT"):
                    negate = True
                if self.word("EXISTS"):
                    out.append(("exists", self.group(), negate))
                else:
                    out.append(("filter", self.primary()))
            elif self.word("BIND"):
                flush()
                out.append(("bind", *self.as_item()))
            elif self.word("VALUES"):
                flush()
                out.append(self.values())
            elif self.word("GRAPH"):
                flush()
                name = self.term()
                out.append(("graph", name, self.group()))
            elif self.word("SERVICE"):
                raise ValueError("sparql: SERVICE is not supported; register a source reader instead")
            elif self.peek() == "{":
                flush()
                branches = [self.group()]
                while self.word("UNION"):
                    branches.append(self.group())
                out.append(("union", branches) if len(branches) > 1 else ("group", branches[0]))
            elif not self.word("."):
                self.triples(bgp)
        flush()
        return out

    def triples(self, out: list) -> None:
        subject = self.node(out)
        if self.peek() in (".", "}"):
            return
        self.properties(subject, out)

    def properties(self, subject, out: list) -> None:
        while True:
            predicate = Var(self.take()[1][1:]) if self.kind() == "var" else self.path()
            while True:
                out.append((subject, predicate, self.node(out)))
                if not self.word(","):
                    break
            if not self.word(";"):
                return
            while self.word(";"):
                pass
            if self.peek() in (".", "}", "]"):
                return

    def node(self, out: list):
        if self.word("["):
            node = self.new()
            if not self.word("]"):
                self.properties(node, out)
                self.need("]")
            return node
        return self.term()

    def term(self):
        kind, raw = self.take()
        if kind == "var":
            return Var(raw[1:])
        if kind in ("iri", "name"):
            return Const(self.iri(raw))
        if kind == "bnode":
            return Var("_" + raw[2:])
        if kind == "text":
            value = re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), raw[1:-1])
            if self.kind() == "lang":
                return Const(value, "literal", None, self.take()[1][1:].lower())
            if self.word("^^"):
                datatype = self.term().value
                return Const(value, "literal", None if datatype == XSD + "string" else datatype)
            return Const(value, "literal")
        if raw in "+-" and self.kind() == "num":
            number = self.term()
            return Const(("-" if raw == "-" else "") + number.value, "literal", number.datatype)
        if kind == "num":
            return Const(raw, "literal", XSD + ("double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"))
        if raw.lower() in ("true", "false"):
            return Const(raw.lower(), "literal", XSD + "boolean")
        raise ValueError(f"sparql: unexpected {raw!r}")

    # property paths
    def path(self) -> Path:
        parts = [self.path_sequence()]
        while self.word("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alternative", parts)

    def path_sequence(self) -> Path:
        parts = [self.path_step()]
        while self.word("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("sequence", parts)

    def path_step(self) -> Path:
        if self.word("^"):
            return Path("inverse", [self.path_step()])
        if self.word("!"):
            inside = []
            if self.word("("):
                while not self.word(")"):
                    inside.append(self.path_one())
                    self.word("|")
            else:
                inside = [self.path_one()]
            return Path("not", inside)
        step = self.path_one()
        for mark, op in (("*", "star"), ("+", "plus"), ("?", "maybe")):
            if self.word(mark):
                return Path(op, [step])
        return step

    def path_one(self) -> Path:
        if self.word("("):
            inner = self.path()
            self.need(")")
            return inner
        if self.kind() == "word" and self.peek() == "a":
            self.take()
            return Path("iri", [RDF_TYPE])
        return Path("iri", [self.term().value])

    # expressions
    def expression(self):
        left = self.conjunction()
        while self.word("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.word("&&"):
            left = ("and", left, self.comparison())
        return left

    def comparison(self):
        left = self.sum()
        for mark in ("=", "!=", "<=", ">=", "<", ">"):
            if self.word(mark):
                return (mark, left, self.sum())
        negate = self.peek().upper() == "NOT" and self.peek(1).upper() == "IN"
        if negate:
            self.i += 1
        if self.word("IN"):
            self.need("(")
            options = []
            while not self.word(")"):
                options.append(self.expression())
                self.word(",")
            return ("not", ("in", left, options)) if negate else ("in", left, options)
        return left

    def sum(self):
        left = self.product()
        while self.peek() in ("+", "-"):
            left = (self.take()[1], left, self.product())
        return left

    def product(self):
        left = self.unary()
        while self.peek() in ("*", "/"):
            left = (self.take()[1], left, self.unary())
        return left

    def unary(self):
        if self.word("!"):
            return ("not", self.unary())
        if self.word("-"):
            return ("-", ("const", Const("0", "literal", XSD + "integer")), self.unary())
        return self.primary()

    def primary(self):
        if self.word("("):
            e = self.expression()
            self.need(")")
            return e
        if self.kind() == "var":
            return ("var", self.take()[1][1:])
        if self.kind() == "word" and self.peek().lower() not in ("true", "false"):
            name = self.take()[1].upper()
            if name in ("EXISTS", "NOT"):
                if name == "NOT":
                    self.need("EXISTS")
                raise ValueError("sparql: EXISTS is supported as a FILTER of its own")
            self.need("(")
            distinct = self.word("DISTINCT")
            args, separator = [], " "
            if self.word("*"):
                args = ["*"]
                self.need(")")
                return ("call", name, args, distinct, separator)
            while not self.word(")"):
                if self.word(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    separator = self.term().value
                    continue
                args.append(self.expression())
                self.word(",")
            return ("call", name, args, distinct, separator)
        term = self.term()
        if isinstance(term, Const) and term.kind == "iri" and self.word("("):
            arg = self.expression()
            self.need(")")
            return ("cast", term.value, arg)
        return ("const", term)


def term_column(value: Column, kind: str | Column = "literal", datatype: str | Column | None = None, lang: str | Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(value.cast("string").alias("value"), as_column(kind).cast("string").alias("kind"), as_column(datatype).cast("string").alias("datatype"), as_column(lang).cast("string").alias("lang"))
    return F.when(value.isNotNull(), made).cast(TERM_TYPE)


def _const(c: Const) -> Column:
    return term_column(F.lit(c.value), c.kind, c.datatype, c.lang)


class E:
    """A compiled expression: a column and how to read it (term, bool, num, str)."""

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind

    def text(self) -> Column:
        return self.column["value"] if self.kind == "term" else self.column.cast("string")

    def number(self) -> Column:
        return self.column["value"].try_cast("double") if self.kind == "term" else self.column.try_cast("double") if self.kind == "str" else self.column.cast("double")

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.column
        if self.kind == "num":
            return self.column != 0
        if self.kind == "str":
            return self.column != ""
        c = self.column
        return F.when(c["datatype"] == XSD + "boolean", c["value"] == "true").when(c["datatype"].isin(NUMERIC), c["value"].try_cast("double") != 0).when(c["kind"] == "literal", c["value"] != "")

    def term(self) -> Column:
        if self.kind == "term":
            return self.column
        if self.kind == "bool":
            return term_column(self.column, "literal", XSD + "boolean")
        if self.kind == "num":
            whole = self.column.cast("double") == F.floor(self.column.cast("double"))
            text = F.when(whole, self.column.cast("decimal(38,0)").cast("string")).otherwise(self.column.cast("string"))
            return term_column(text, "literal", F.when(whole, F.lit(XSD + "integer")).otherwise(F.lit(XSD + "decimal")))
        return term_column(self.column)

    def is_number(self) -> Column:
        if self.kind == "num":
            return F.lit(True)
        return F.coalesce(self.column["datatype"].isin(NUMERIC), F.lit(False)) if self.kind == "term" else F.lit(False)


def _compare(op: str, a: E, b: E) -> Column:
    numbers = {"=": a.number() == b.number(), "!=": a.number() != b.number(), "<": a.number() < b.number(), ">": a.number() > b.number(), "<=": a.number() <= b.number(), ">=": a.number() >= b.number()}[op]
    if op in ("=", "!="):
        x, y = a.term(), b.term()
        same = (x["value"] == y["value"]) & (x["kind"] == y["kind"]) & x["lang"].eqNullSafe(y["lang"]) & x["datatype"].eqNullSafe(y["datatype"])
        other = same if op == "=" else ~same
    else:
        x, y = a.text(), b.text()
        other = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    return F.when(a.is_number() & b.is_number(), numbers).otherwise(other)


def _part(fn: Callable[[Column], Column]) -> Callable[[list[E]], E]:
    return lambda a: E(fn(a[0].term()["value"].try_cast("timestamp")), "num")


def _kind_is(*kinds: str) -> Callable[[list[E]], E]:
    return lambda a: E(a[0].term()["kind"].isin(*kinds), "bool")


def _zone(a: list[E]) -> Column:
    return F.regexp_extract(a[0].text(), r"(Z|[+-]\d\d:\d\d)$", 1)


def _like_first(out: Column, first: E) -> E:
    """A string result keeps the first argument's language."""
    t = first.term()
    return E(term_column(out, "literal", F.when(t["lang"].isNotNull(), t["datatype"]), t["lang"]), "term")


def _regex_flags(args: list[E], at: int, flags: list) -> Column:
    pattern = args[at].text()
    return F.concat(F.lit(f"(?{flags[0]})"), pattern) if flags and flags[0] else pattern


def _locate(needle: Column, text: Column) -> Column:
    return F.call_function("locate", needle, text)


FUNCTIONS: dict[str, Callable[[list[E]], E]] = {
    "STR": lambda a: E(a[0].text(), "str"),
    "LANG": lambda a: E(F.when(a[0].term()["kind"] == "literal", F.coalesce(a[0].term()["lang"], F.lit(""))), "str"),
    "DATATYPE": lambda a: E(term_column(F.when(a[0].term()["kind"] == "literal", F.when(a[0].term()["lang"].isNotNull(), RDF + "langString").otherwise(F.coalesce(a[0].term()["datatype"], F.lit(XSD + "string")))), "iri"), "term"),
    "ISIRI": _kind_is("iri"),
    "ISURI": _kind_is("iri"),
    "ISBLANK": _kind_is("bnode"),
    "ISLITERAL": _kind_is("literal"),
    "ISNUMERIC": lambda a: E(a[0].is_number() & a[0].number().isNotNull(), "bool"),
    "IRI": lambda a: E(term_column(a[0].text(), "iri"), "term"),
    "URI": lambda a: E(term_column(a[0].text(), "iri"), "term"),
    "BNODE": lambda a: E(term_column(a[0].text() if a else F.expr("uuid()"), "bnode"), "term"),
    "STRDT": lambda a: E(term_column(a[0].text(), "literal", a[1].text()), "term"),
    "STRLANG": lambda a: E(term_column(a[0].text(), "literal", None, F.lower(a[1].text())), "term"),
    "SAMETERM": lambda a: E(a[0].term() == a[1].term(), "bool"),
    "BOUND": lambda a: E(a[0].column.isNotNull(), "bool"),
    "STRLEN": lambda a: E(F.char_length(a[0].text()), "num"),
    "SUBSTR": lambda a: _like_first(F.substring(a[0].text(), a[1].number().cast("int"), a[2].number().cast("int") if len(a) > 2 else F.char_length(a[0].text())), a[0]),
    "UCASE": lambda a: _like_first(F.upper(a[0].text()), a[0]),
    "LCASE": lambda a: _like_first(F.lower(a[0].text()), a[0]),
    "STRSTARTS": lambda a: E(F.startswith(a[0].text(), a[1].text()), "bool"),
    "STRENDS": lambda a: E(F.endswith(a[0].text(), a[1].text()), "bool"),
    "CONTAINS": lambda a: E(F.contains(a[0].text(), a[1].text()), "bool"),
    "STRBEFORE": lambda a: E(F.when(F.contains(a[0].text(), a[1].text()), F.substring(a[0].text(), F.lit(1), _locate(a[1].text(), a[0].text()) - 1)).otherwise(F.lit("")), "str"),
    "STRAFTER": lambda a: E(F.when(F.contains(a[0].text(), a[1].text()), F.substring(a[0].text(), _locate(a[1].text(), a[0].text()) + F.char_length(a[1].text()), F.char_length(a[0].text()))).otherwise(F.lit("")), "str"),
    "CONCAT": lambda a: E(F.concat(*[x.text() for x in a]), "str"),
    "ENCODE_FOR_URI": lambda a: E(encode_for_uri(a[0].text()), "str"),
    "LANGMATCHES": lambda a: E(F.when(a[1].text() == "*", a[0].text() != "").otherwise((F.lower(a[0].text()) == F.lower(a[1].text())) | F.startswith(F.lower(a[0].text()), F.concat(F.lower(a[1].text()), F.lit("-")))), "bool"),
    "ABS": lambda a: E(F.abs(a[0].number()), "num"),
    "ROUND": lambda a: E(F.floor(a[0].number() + 0.5), "num"),
    "CEIL": lambda a: E(F.ceil(a[0].number()), "num"),
    "FLOOR": lambda a: E(F.floor(a[0].number()), "num"),
    "RAND": lambda a: E(F.rand(), "num"),
    "NOW": lambda a: E(term_column(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "literal", XSD + "dateTime"), "term"),
    "YEAR": _part(F.year),
    "MONTH": _part(F.month),
    "DAY": _part(F.day),
    "HOURS": _part(F.hour),
    "MINUTES": _part(F.minute),
    "SECONDS": _part(F.second),
    "TZ": lambda a: E(_zone(a), "str"),
    "TIMEZONE": lambda a: E(term_column(F.when(_zone(a) == "Z", F.lit("PT0S")).when(_zone(a) != "", F.concat(F.when(F.startswith(_zone(a), F.lit("-")), F.lit("-")).otherwise(F.lit("")), F.lit("PT"), F.substring(_zone(a), 2, 2).cast("int").cast("string"), F.lit("H"))), "literal", XSD + "dayTimeDuration"), "term"),
    "MD5": lambda a: E(F.md5(a[0].text()), "str"),
    "SHA1": lambda a: E(F.sha1(a[0].text()), "str"),
    "SHA256": lambda a: E(F.sha2(a[0].text(), 256), "str"),
    "SHA384": lambda a: E(F.sha2(a[0].text(), 384), "str"),
    "SHA512": lambda a: E(F.sha2(a[0].text(), 512), "str"),
    "UUID": lambda a: E(term_column(F.concat(F.lit("urn:uuid:"), F.expr("uuid()")), "iri"), "term"),
    "STRUUID": lambda a: E(F.expr("uuid()"), "str"),
}


def compile_expression(e, scope: Callable[[str], Column]) -> E:
    op = e[0]
    if op == "var":
        return E(scope(e[1]), "term")
    if op == "const":
        return E(_const(e[1]), "term")
    sub = lambda x: compile_expression(x, scope)
    if op in ("or", "and"):
        a, b = sub(e[1]).truth(), sub(e[2]).truth()
        return E(a | b if op == "or" else a & b, "bool")
    if op == "not":
        return E(~sub(e[1]).truth(), "bool")
    if op in ("=", "!=", "<", ">", "<=", ">="):
        return E(_compare(op, sub(e[1]), sub(e[2])), "bool")
    if op == "in":
        return E(reduce(lambda x, y: x | y, [_compare("=", sub(e[1]), sub(o)) for o in e[2]], F.lit(False)), "bool")
    if op in ("+", "-", "*", "/"):
        a, b = sub(e[1]).number(), sub(e[2]).number()
        return E({"+": a + b, "-": a - b, "*": a * b}[op] if op != "/" else F.try_divide(a, b), "num")
    if op == "cast":
        a, kind = sub(e[2]), e[1].rpartition("#")[2]
        if kind in ("integer", "int", "long"):
            return E(a.number().cast("long"), "num")
        if kind in ("decimal", "double", "float"):
            return E(a.number(), "num")
        if kind == "boolean":
            return E(F.when(a.text().isin("true", "1"), True).when(a.text().isin("false", "0"), False), "bool")
        if kind == "string":
            return E(a.text(), "str")
        if kind == "dateTime":
            return E(term_column(F.when(a.text().try_cast("timestamp").isNotNull(), a.text()), "literal", XSD + "dateTime"), "term")
        raise ValueError(f"sparql: unknown cast {e[1]}")
    name, args = e[1], e[2]
    if name == "IF":
        return E(F.when(sub(args[0]).truth(), sub(args[1]).term()).otherwise(sub(args[2]).term()), "term")
    if name == "COALESCE":
        return E(F.coalesce(*[sub(a).term() for a in args]), "term")
    if name in ("REGEX", "REPLACE"):
        flags = [args[-1][1].value] if len(args) > (2 if name == "REGEX" else 3) else []
        own = [sub(a) for a in args]
        pattern = _regex_flags(own, 1, flags)
        if name == "REGEX":
            return E(F.regexp_like(own[0].text(), pattern), "bool")
        return _like_first(F.regexp_replace(own[0].text(), pattern, own[2].text()), own[0])
    if name in FUNCTIONS:
        return FUNCTIONS[name]([sub(a) for a in args])
    raise ValueError(f"sparql: unknown function {name}")


def _aggregates_in(e) -> list:
    if not isinstance(e, tuple):
        return []
    if e[0] == "call" and e[1] in AGGREGATES:
        return [e]
    return [x for part in e[1:] for y in (part if isinstance(part, list) else [part]) for x in _aggregates_in(y)]


def _aggregate(e, scope) -> E:
    _, name, args, distinct, separator = e
    if args == ["*"]:
        return E(F.count(F.lit(1)), "num")
    a = compile_expression(args[0], scope)
    if name == "COUNT":
        return E(F.count_distinct(a.term()) if distinct else F.count(a.term()), "num")
    if name in ("SUM", "AVG"):
        n = a.number()
        if name == "SUM":
            return E(F.coalesce(F.sum_distinct(n) if distinct else F.sum(n), F.lit(0.0)), "num")
        return E(F.avg(n), "num")
    if name in ("MIN", "MAX"):
        key = F.struct(F.when(a.is_number(), a.number()).alias("n"), a.text().alias("t"))
        return E((F.min_by if name == "MIN" else F.max_by)(a.term(), F.when(a.text().isNotNull(), key)), "term")
    if name == "SAMPLE":
        return E(F.min(a.term()), "term")
    values = F.collect_set(a.text()) if distinct else F.collect_list(a.text())
    return E(F.array_join(F.array_sort(values), separator), "str")


class Compiler:
    """Patterns to DataFrames with one term column per variable."""

    def __init__(self, triples: DataFrame, graphs: dict[str, DataFrame] | None = None):
        self.base, self.graphs, self.n = triples, graphs or {}, 0

    def terms(self, triples: DataFrame) -> DataFrame:
        plain = F.when((F.col("datatype") != XSD + "string") & F.col("lang").isNull(), F.col("datatype"))
        # a plain string and an xsd:string are the same term; a language stands for its datatype
        return triples.select("s", "p", term_column(F.col("o"), F.col("kind"), plain, F.col("lang")).alias("o"))

    def fresh(self) -> str:
        self.n += 1
        return f"_t{self.n}"

    def subject(self, column: Column) -> Column:
        bnode = F.startswith(column, F.lit("_:"))
        return term_column(column, F.when(bnode, F.lit("bnode")).otherwise(F.lit("iri")))

    def pairs(self, path: Path, triples: DataFrame, start: str | None = None) -> DataFrame:
        """``(a, b)`` terms that the path connects; ``start`` bounds closures to one first node."""
        if path.op == "iri":
            return triples.where(F.col("p") == path.parts[0]).select(self.subject(F.col("s")).alias("a"), F.col("o").alias("b"))
        if path.op == "not":
            banned = [p.parts[0] for p in path.parts if p.op == "iri"]
            return triples.where(~F.col("p").isin(banned)).select(self.subject(F.col("s")).alias("a"), F.col("o").alias("b"))
        if path.op == "inverse":
            return self.pairs(path.parts[0], triples).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if path.op == "sequence":
            out = self.pairs(path.parts[0], triples, start)
            for p in path.parts[1:]:
                step = self.pairs(p, triples).select(F.col("a").alias("_m"), F.col("b").alias("_e"))
                out = out.join(step, F.col("b") == F.col("_m")).select("a", F.col("_e").alias("b"))
            return out
        if path.op == "alternative":
            return reduce(DataFrame.unionByName, [self.pairs(p, triples) for p in path.parts])
        step = self.pairs(path.parts[0], triples).distinct()
        nodes = triples.select(self.subject(F.col("s")).alias("a")).union(triples.select("o")).distinct()
        zero = nodes.select("a", F.col("a").alias("b"))
        if start is not None:
            zero = zero.where(F.col("a")["value"] == start)
        if path.op == "maybe":
            return step.unionByName(zero).distinct()
        step = materialize(step, "path")
        edges = step.select(F.col("a").alias("_m"), F.col("b").alias("_e"))
        found = frontier = materialize(step.where(F.col("a")["value"] == start) if start is not None else step, "path")
        while not frontier.isEmpty():
            ahead = frontier.join(edges, F.col("b") == F.col("_m")).select("a", F.col("_e").alias("b")).distinct()
            frontier = materialize(ahead.join(found, ["a", "b"], "left_anti"), "path")
            found = found.unionByName(frontier)
        return found.unionByName(zero).distinct() if path.op == "star" else found

    def pattern(self, triple, triples: DataFrame) -> DataFrame:
        s, p, o = triple
        if isinstance(p, Var):
            rows = triples.select(self.subject(F.col("s")).alias("a"), term_column(F.col("p"), "iri").alias("m"), F.col("o").alias("b"))
        else:
            if p.op == "iri" and isinstance(s, Const):
                triples = triples.where(F.col("s") == s.value)
            if isinstance(o, Const) and not isinstance(s, Const) and p.op in ("plus", "star", "maybe", "sequence"):
                # bounded at its end: walk backwards from there
                rows = self.pairs(backwards(p), triples, o.value).select(F.col("b").alias("a"), F.col("a").alias("b"))
            else:
                rows = self.pairs(p, triples, s.value if isinstance(s, Const) and p.op != "iri" else None)
        parts = [(s, "a"), (p, "m"), (o, "b")] if isinstance(p, Var) else [(s, "a"), (o, "b")]
        seen: dict[str, str] = {}
        for term, column in parts:
            if isinstance(term, Const):
                c = F.col(column)
                rows = rows.where((c["value"] == term.value) & (c["kind"] == term.kind) & c["lang"].eqNullSafe(F.lit(term.lang)) & c["datatype"].eqNullSafe(F.lit(term.datatype)))
            elif term.name in seen:
                rows = rows.where(F.col(column) == F.col(seen[term.name]))
            else:
                seen[term.name] = column
        return rows.select(*[F.col(c).alias(v) for v, c in seen.items()]) if seen else rows.select(F.lit(1).alias("_one")).limit(1).drop("_one")

    def join(self, left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
        """Join on shared variables; a variable unbound on either side is compatible with anything.

        Rows where such a variable is bound and rows where it is not are joined apart, so every join is
        by equality on what is bound on both sides.
        """
        if left is None:
            return right
        shared = [c for c in left.columns if c in right.columns]
        mine, other = getattr(left, "_loose", set()), getattr(right, "_loose", set())
        loose = mine | other
        columns = [*left.columns, *[c for c in right.columns if c not in shared]]
        added = set(columns[len(left.columns) :]) if how == "left" else set()
        split = next((c for c in shared if c in mine or (c in other and how == "inner")), None)
        if split is not None:
            stored = self._loosened(materialize(left, "optional"), mine)
            out = None
            for unbound in [False, True] if split in mine else [False]:
                for missing in [False, True] if split in other and how == "inner" else [False]:
                    l, r = stored, right
                    if split in mine:
                        l = self._loosened(l.where(F.col(split).isNull() if unbound else F.col(split).isNotNull()), mine - {split})
                    if split in other and how == "inner":
                        r = self._loosened(r.where(F.col(split).isNull() if missing else F.col(split).isNotNull()), other - {split})
                    if unbound:
                        l = self._loosened(l.drop(split), mine - {split})
                    elif missing:
                        r = self._loosened(r.drop(split), other - {split})
                    part = self.join(l, r, how).select(*columns)
                    out = part if out is None else out.unionByName(part)
            return self._loosened(out, loose | added)
        names = {c: self.fresh() for c in shared}
        renamed = right.withColumnsRenamed(names)
        test: Column | None = None
        for c, r in names.items():
            t = F.col(c) == F.col(r)
            if c in loose:
                t = t | F.col(r).isNull()
            test = t if test is None else test & t
        out = left.crossJoin(renamed) if test is None and how == "inner" else left.join(renamed, F.lit(True) if test is None else test, how)
        out = out.select(*[F.coalesce(F.col(c), F.col(names[c])).alias(c) if c in names and c in loose else F.col(c) for c in columns])
        return self._loosened(out, loose | added)

    @staticmethod
    def _loosened(df: DataFrame, loose: set[str]) -> DataFrame:
        df._loose = loose
        return df

    @staticmethod
    def connected(triples: list, bound: set[str]) -> list:
        """The patterns in an order in which each shares a variable with what is bound before it, if there is one."""
        rest, out, bound = list(triples), [], set(bound)
        while rest:
            names = [{t.name for t in triple if isinstance(t, Var)} for triple in rest]
            k = next((k for k, n in enumerate(names) if not bound or not n or n & bound), 0)
            bound |= names[k]
            out.append(rest.pop(k))
        return out

    def group(self, elements: list, triples: DataFrame) -> DataFrame:
        out: DataFrame | None = None
        filters = []
        for el in elements:
            kind = el[0]
            if kind == "bgp":
                for triple in self.connected(el[1], set(out.columns) if out is not None else set()):
                    out = self.join(out, self.pattern(triple, triples))
            elif kind == "optional":
                inner_filters = [e for e in el[1] if e[0] == "filter"]
                own = self.group([e for e in el[1] if e[0] != "filter"], triples)
                if inner_filters and out is not None:
                    # the condition of a left join sees both sides
                    tag = self.fresh()
                    left = out.withColumn(tag, F.monotonically_increasing_id())
                    left._loose = getattr(out, "_loose", set())
                    left = self._keep(materialize(left, "optional"), left)
                    both = self.join(left, own)
                    for f in inner_filters:
                        both = self._keep(both.where(self.truth(f[1], both)), both)
                    hits = self._keep(both.select(tag, *[F.col(c) for c in both.columns if c not in left.columns]), both)
                    extra = [c for c in hits.columns if c != tag]
                    out2 = left.join(hits, tag, "left").drop(tag)
                    out2._loose = getattr(left, "_loose", set()) | set(extra)
                    out = out2
                else:
                    out = self.join(out, own, "left") if out is not None else own
            elif kind == "union":
                parts = [self.group(b, triples) for b in el[1]]
                every = list(dict.fromkeys(c for p in parts for c in p.columns))
                loose = {c for p in parts for c in every if c not in p.columns} | {c for p in parts for c in getattr(p, "_loose", set())}
                union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
                union._loose = loose
                out = self.join(out, union)
            elif kind == "group":
                out = self.join(out, self.group(el[1], triples))
            elif kind == "sub":
                out = self.join(out, self.select(el[1], triples))
            elif kind == "graph":
                out = self.join(out, self.graph(el[1], el[2]))
            elif kind == "minus":
                other = self.group(el[1], triples)
                shared = [c for c in out.columns if c in other.columns] if out is not None else []
                if shared:
                    out = self._keep(out.join(other.select(*shared).distinct(), shared, "left_anti"), out)
            elif kind == "bind":
                out = self._one() if out is None else out
                out = self._keep(out.withColumn(el[2], compile_expression(el[1], self.scope(out)).term()), out)
            elif kind == "values":
                out = self.join(out, self.values(el))
            else:
                filters.append(el)
        out = self._one() if out is None else out
        for f in filters:
            if f[0] == "filter":
                out = self._keep(out.where(self.truth(f[1], out)), out)
            else:
                other = self.group(f[1], triples)
                shared = [c for c in out.columns if c in other.columns]
                how = "left_anti" if f[2] else "left_semi"
                right = other.select(*shared).distinct() if shared else other.limit(1)
                out = self._keep(out.join(right, shared, how) if shared else out.join(right, F.lit(True), how), out)
        return out

    def _keep(self, df: DataFrame, like: DataFrame) -> DataFrame:
        df._loose = getattr(like, "_loose", set())
        return df

    def _one(self) -> DataFrame:
        return self.base.sparkSession.range(1).drop("id")

    def scope(self, df: DataFrame) -> Callable[[str], Column]:
        return lambda v: F.col(v) if v in df.columns else F.lit(None).cast(TERM_TYPE)

    def truth(self, e, df: DataFrame) -> Column:
        return compile_expression(e, self.scope(df)).truth()

    def graph(self, name, elements) -> DataFrame:
        if isinstance(name, Const):
            if name.value not in self.graphs:
                raise ValueError(f"sparql: no graph {name.value}")
            return self.group(elements, self.terms(self.graphs[name.value]))
        parts = [self.group(elements, self.terms(g)).withColumn(name.name, _const(Const(n))) for n, g in self.graphs.items()]
        return reduce(DataFrame.unionByName, parts)

    def values(self, el) -> DataFrame:
        _, names, rows = el
        spark = self.base.sparkSession
        data = [tuple(None if t is None else (t.value, t.kind, t.datatype, t.lang) for t in r) for r in rows]
        out = spark.createDataFrame(data, ", ".join(f"`{n}` {TERM_TYPE}" for n in names))
        out._loose = {n for k, n in enumerate(names) if any(r[k] is None for r in rows)}
        return out

    def select(self, q: dict, triples: DataFrame) -> DataFrame:
        rows = self.group(q["where"], triples)
        if q["values"]:
            rows = self.join(rows, self.values(q["values"]))
        items = q["items"]
        aggregated = q["group"] is not None or (items and any(_aggregates_in(e) for e, _ in items))
        if aggregated:
            keys = [compile_expression(e, self.scope(rows)).term().alias(n) for e, n in (q["group"] or [])]
            calls = list(dict.fromkeys(repr(a) for e, _ in (items or []) for a in _aggregates_in(e)))
            found = {repr(a): a for e, _ in (items or []) for a in _aggregates_in(e)} | {repr(a): a for h in q["having"] for a in _aggregates_in(h)} | {repr(a): a for e, _ in q["order"] for a in _aggregates_in(e)}
            names, columns = {}, []
            for key in dict.fromkeys([*calls, *found]):
                names[key] = self.fresh()
                columns.append(_aggregate(found[key], self.scope(rows)).term().alias(names[key]))
            rows = rows.groupBy(*keys).agg(*columns) if columns else rows.select(*keys).distinct()

            def replaced(e):
                if isinstance(e, tuple):
                    if repr(e) in names:
                        return ("var", names[repr(e)])
                    return tuple([replaced(y) for y in x] if isinstance(x, list) else replaced(x) for x in e)
                return e

            items = [(replaced(e), n) for e, n in items] if items else items
            q = q | {"order": [(replaced(e), d) for e, d in q["order"]], "having": [replaced(h) for h in q["having"]]}
        for e, n in items or []:
            if e != ("var", n):
                rows = rows.withColumn(n, compile_expression(e, self.scope(rows)).term())
        for h in q["having"]:
            rows = rows.where(self.truth(h, rows))
        visible = [n for _, n in items] if items else [c for c in rows.columns if not c.startswith("_")]
        if q["order"]:
            order = []
            for e, down in q["order"]:
                x = compile_expression(e, self.scope(rows))
                for c in (F.when(x.is_number(), x.number()), x.text()):
                    order.append(c.desc_nulls_last() if down else c.asc_nulls_first())
            rows = rows.orderBy(*order)
        missing = [n for n in visible if n not in rows.columns]
        for n in missing:
            rows = rows.withColumn(n, F.lit(None).cast(TERM_TYPE))
        if q["distinct"] and q["order"]:
            # keep the order of first appearance: sort again on what is visible
            rows = rows.select(*visible).distinct()
            rows = rows.orderBy(*[c for e, d in q["order"] for x in [compile_expression(e, self.scope(rows))] for k in (F.when(x.is_number(), x.number()), x.text()) for c in [k.desc_nulls_last() if d else k.asc_nulls_first()]])
        else:
            rows = rows.select(*visible)
            rows = rows.distinct() if q["distinct"] else rows
        if q["offset"]:
            rows = rows.offset(q["offset"])
        if q["limit"] is not None:
            rows = rows.limit(q["limit"])
        return rows


def _instantiate(rows: DataFrame, template: list, compiler: Compiler) -> DataFrame:
    """The template's triples of every row, as a set; rows with an unbound part give none."""
    def column(term) -> Column:
        if isinstance(term, Path):
            return _const(Const(term.parts[0]))
        return _const(term) if isinstance(term, Const) else (F.col(term.name) if term.name in rows.columns else F.lit(None).cast(TERM_TYPE))

    one = [F.struct(column(s).alias("s"), column(p).alias("p"), column(o).alias("o")) for s, p, o in template]
    each = rows.select(F.explode(F.array(*one)).alias("t")).where("t.s is not null and t.p is not null and t.o is not null and t.s.kind <> 'literal' and t.p.kind = 'iri'")
    return each.select(F.col("t.s.value").alias("s"), F.col("t.p.value").alias("p"), F.col("t.o.value").alias("o"), "t.o.kind", "t.o.datatype", "t.o.lang").distinct()


def query(text: str, triples: DataFrame, graphs: dict[str, DataFrame] | None = None) -> DataFrame | bool:
    """Run SPARQL; ValueError says what is not understood."""
    parser = Parser(text)
    q = parser.parse()
    if parser.i < len(parser.t):
        raise ValueError(f"sparql: unexpected {parser.peek()!r}")
    compiler = Compiler(triples, graphs)
    base = compiler.terms(triples)
    if q["form"] == "select":
        return compiler.select(q, base)
    if q["form"] == "ask":
        return not compiler.group(q["where"], base).isEmpty()
    if q["form"] == "construct":
        return _instantiate(compiler.group(q["where"], base), q["template"], compiler)
    constants = [t.value for t in q["about"] if isinstance(t, Const)]
    wanted = triples.where(F.col("s").isin(constants)) if constants else None
    for t in q["about"]:
        if isinstance(t, Var):
            found = compiler.group(q["where"], base).select(F.col(t.name)["value"].alias("s")).distinct()
            rows = triples.join(found, "s", "left_semi")
            wanted = rows if wanted is None else wanted.unionByName(rows).distinct()
    return wanted.select("s", "p", "o", "kind", "datatype", "lang")


def values(df: DataFrame) -> DataFrame:
    """Term columns as plain strings."""
    return df.select(*[F.col(c)["value"].alias(c) for c in df.columns])


def results_json(df: DataFrame) -> DataFrame:
    """One SPARQL-JSON binding object a row."""
    def term(c: str) -> Column:
        t = F.col(c)
        kind = F.when(t["kind"] == "iri", F.lit("uri")).otherwise(t["kind"])
        datatype = F.when(t["lang"].isNull(), t["datatype"])
        return F.when(t.isNotNull(), F.struct(kind.alias("type"), t["value"].alias("value"), t["lang"].alias("xml:lang"), datatype.alias("datatype"))).alias(c)

    return df.select(F.to_json(F.struct(*[term(c) for c in df.columns])).alias("binding"))
