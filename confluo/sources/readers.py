"""Readers: JSON, XML, HTML with a CSS selector, and spreadsheets, each to a DataFrame of records.

``READERS`` dispatches on the local name of a source's format. Files of a
folder are read together; names beginning with a dot are skipped by Spark itself.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, time, timedelta
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.functions.terms import format_family
from confluo.plans.shared import new_dir

Reader = Callable[[SparkSession, str, dict[str, str]], DataFrame]


def read_json(spark: SparkSession, path: str, params: dict[str, str]) -> DataFrame:
    """One record per element of a top-level array (or per top-level object), nulls kept.

    Parameter ``_file`` names a column for the file that each record came from."""
    return _with_file(spark.read.option("multiLine", True).option("dropFieldIfAllNull", False).json(path), params)


def _with_file(records: DataFrame, params: dict[str, str]) -> DataFrame:
    return records.select("*", F.col("_metadata.file_path").alias(params["_file"])) if params.get("_file") else records


def read_xml(spark: SparkSession, path: str, params: dict[str, str]) -> DataFrame:
    """One record per element named by parameter ``rowTag`` (default ``record``); ``_file`` as for JSON."""
    return _with_file(spark.read.format("xml").option("rowTag", params.get("rowTag", "record")).load(path), params)


def xml_fields(docs: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of one XML document per row; a malformed document gives nulls."""
    return docs.select(F.from_xml(F.col(column), schema).alias("_r")).select("_r.*")


def json_facts(docs: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, path, value, type)``: every node of a JSON column; containers have no value, nulls are kept.

    One round a level, each written to the shared folder, until a level has no containers;
    neither rows nor levels are limited (what ``parse_json`` itself refuses is an error)."""
    spark = docs.sparkSession
    schema = "k " + docs.schema[key].dataType.simpleString() + ", path string, value string, type string, v variant"
    level = docs.select(F.col(key).alias("k"), F.lit("$").alias("path"), F.parse_json(F.col(column)).alias("v"))
    base, written = new_dir(spark, "json"), []
    while not written or not level.isEmpty():
        nodes = spark.sql(
            "select n.k, n.path || '/' || coalesce(e.key, cast(e.pos + 1 as string)) as path, e.value as v, schema_of_variant(e.value) as t from {level} n, lateral variant_explode(n.v) e",
            level=level,
        )
        inner = F.col("t").rlike("^(OBJECT|ARRAY)")
        nodes = nodes.select("k", "path", F.when(~inner, F.col("v").cast("string")).alias("value"), F.split("t", "<")[0].alias("type"), F.when(inner, F.col("v")).alias("v"))
        written.append(f"{base}/level-{len(written) + 1}")
        nodes.write.parquet(written[-1])
        level = spark.read.schema(schema).parquet(written[-1]).where("v is not null").select("k", "path", "v")
    return spark.read.schema(schema).parquet(*written).drop("v").withColumnRenamed("k", key)


class _Tree(HTMLParser):
    """Element tree of lenient HTML: void elements close themselves, unmatched end tags are ignored, titles and text areas hold no elements."""

    TEXT = ("title", "textarea") if not hasattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS") else ()
    CDATA_CONTENT_ELEMENTS = (*HTMLParser.CDATA_CONTENT_ELEMENTS, *TEXT)
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "", "attrs": {}, "children": [], "parent": None}
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "children": [], "parent": self.at}
        self.at["children"].append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.at = self.at["parent"]

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node["tag"] != tag:
            node = node["parent"]
        if node is not None and node["parent"] is not None:
            self.at = node["parent"]

    def handle_data(self, data):
        self.at["children"].append(unescape(data) if self.cdata_elem in self.TEXT else data)


def _text(node) -> str:
    """Text of an element in document order, scripts and styles left out; a stack, so any depth will do."""
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(at)
        elif at["tag"] not in ("script", "style"):
            stack += reversed(at["children"])
    return "".join(out)


STEP = re.compile(r"^(?P<tag>[\w-]+|\*)?(?P<rest>(?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:[~^$*]?=(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])*)$")


def _selector(text: str):
    """Groups of compound steps with their combinators: type, #id, .class, [attribute], descendant and child."""
    groups = []
    for group in text.split(","):
        steps, child = [], False
        for part in re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", group.strip()):
            if part == ">":
                child = True
                continue
            m = STEP.match(part)
            if not m:
                raise ValueError(f"selector: cannot read {part!r}")
            tests = re.findall(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([~^$*]?=)(\"[^\"]*\"|'[^']*'|[^\]]*))?\]", m["rest"])
            steps.append((child, m["tag"], tests))
            child = False
        groups.append(steps)
    return groups


def _fits(node, step) -> bool:
    _, tag, tests = step
    if tag not in (None, "*") and node["tag"] != tag.lower():
        return False
    for ident, cls, attr, op, raw in tests:
        have = node["attrs"]
        value = raw.strip("\"'")
        if ident and have.get("id") != ident or cls and cls not in have.get("class", "").split():
            return False
        if attr:
            if attr not in have:
                return False
            own = have[attr]
            checks = {"=": own == value, "^=": own.startswith(value), "$=": own.endswith(value), "*=": value in own, "~=": value in own.split()}
            if op and not checks[op]:
                return False
    return True


def _reach(node, above: list[tuple[set, set]], groups) -> list[tuple[set, set]]:
    """Per group of steps: how many leading steps end at this node, and how many end at it or above it.

    Follows from the parent's sets alone, so neither depth nor the number of ancestors costs more than one look.
    """
    out = []
    for (parent, over), steps in zip(above, groups, strict=True):
        here = {k + 1 for k, step in enumerate(steps) if (k == 0 or k in (parent if step[0] else over)) and _fits(node, step)}
        out.append((here, over | here))
    return out


def select_html(html: str | None, selector: str, references: tuple[str, ...] | None = None) -> list[dict]:
    """Elements that match the selector, in document order: tag, text (HTML's white space collapsed) and attributes.

    ``references`` names the only character references that are read, where their semicolon is there; by
    default all of HTML's are, which needs no semicolon for some.
    """
    tree, groups, out = _Tree(), _selector(selector), []
    if references is not None:
        html = re.sub(rf"&(?!(?:{'|'.join(map(re.escape, references))});)" if references else "&", "&amp;", html or "")
    tree.feed(html or "")
    tree.close()
    stack = [(tree.root, [(set(), set()) for _ in groups])]
    while stack:
        node, above = stack.pop()
        reach = _reach(node, above, groups) if node["tag"] else above
        if node["tag"] and any(len(steps) in here for (here, _), steps in zip(reach, groups, strict=True)):
            out.append({"tag": node["tag"], "text": re.sub(r"[\t\n\f\r ]+", " ", _text(node)).strip(" "), "attrs": node["attrs"]})
        stack += [(c, reach) for c in reversed(node["children"]) if not isinstance(c, str)]
    return out


def html_elements(html: Column, selector: str, references: tuple[str, ...] | None = None) -> Column:
    """``array<struct<tag, text, attrs>>`` of the matching elements, Arrow-batched; ``references`` as for ``select_html``."""
    _selector(selector)

    @F.pandas_udf("array<struct<tag:string,text:string,attrs:map<string,string>>>")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([select_html(p, selector, references) for p in pages])

    return run(html)


def read_html(spark: SparkSession, path: str, params: dict[str, str]) -> DataFrame:
    """One record per element matching parameter ``_selector``: file, position, tag, text, attrs."""
    pages = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    found = html_elements(F.col("value"), params.get("_selector", "body"))
    return pages.select("file", F.posexplode(found).alias("position", "e")).select("file", (F.col("position") + 1).alias("position"), "e.tag", "e.text", "e.attrs")


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _first_sheet(book: zipfile.ZipFile, names: set[str]) -> str:
    """The file of the sheet that the workbook lists first."""
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{SHEET}sheets/{SHEET}sheet")
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links.get(next((v for k, v in first.attrib.items() if k.endswith("}id")), None)) if first is not None else None
        if target is not None:
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))


def _date_styles(book: zipfile.ZipFile, names: set[str]) -> set[int]:
    """Cell styles that show a number of days as a date."""
    if "xl/styles.xml" not in names:
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{SHEET}numFmt")}
    dated = {k for k, code in own.items() if re.search("[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower())} | set(range(14, 23))
    styles = root.find(f"{SHEET}cellXfs")
    return {k for k, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in dated}


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of the workbook's first sheet as text, row by row; numbers in a date style as ISO dates."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in root.iter(f"{SHEET}si")]
        sheet, dates, rows = _first_sheet(book, names), _date_styles(book, names), []
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{SHEET}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{SHEET}c"):
                letters = re.match(r"[A-Z]+", cell.get("r", ""))
                at = len(cells)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                value = cell.find(f"{SHEET}v")
                text = value.text if value is not None else None
                if cell.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                elif cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
                elif cell.get("t") in (None, "n") and text is not None and int(cell.get("s", -1)) in dates:
                    moment = datetime(1899, 12, 30) + timedelta(days=float(text))
                    text = moment.date().isoformat() if moment.time() == time() else moment.isoformat()
                cells += [None] * (at + 1 - len(cells))
                cells[at] = text
            rows.append(cells)
        return rows


def read_xlsx(spark: SparkSession, path: str, params: dict[str, str]) -> DataFrame:
    """One record per row below the header row of each workbook; columns are the union of the headers."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                table = sheet_rows(content)
                head = [h or "" for h in table[0]] if table else []
                for n, cells in enumerate(table[1:], 2):
                    out.append((name, n, {h: c for h, c in zip(head, cells, strict=False) if h and c is not None}))
            yield pd.DataFrame(out, columns=["file", "row", "cells"])

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    cells = books.mapInPandas(rows, "file string, row int, cells map<string,string>")
    heads = sorted(r.h for r in cells.select(F.explode(F.map_keys("cells")).alias("h")).distinct().collect())  # column names
    return cells.select(*[F.col("cells")[h].alias(h) for h in heads], *([F.col("file").alias(params["_file"])] if params.get("_file") else []))


READERS: dict[str, Reader] = {"json": read_json, "xml": read_xml, "html": read_html, "xlsx": read_xlsx}


def reader_for(format_iri: str) -> Reader:
    family = format_family(format_iri).lower()
    if family not in READERS:
        raise ValueError(f"lift: no reader for format {family} - use {', '.join(READERS)}")
    return READERS[family]
