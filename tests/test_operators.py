"""Operator cases: curated pairs, floors, nulls, known clusters, strategies, readers, Turtle, SPARQL, streaming."""

import io
import itertools
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from confluo import config
from confluo.config import Criterion, Federation, Field, FieldMapping, Mapping, MatchRule, ResolveRule, Source, TargetField, TargetSchema
from confluo.functions import similarity, turtle
from confluo.functions.terms import FACTS, PIPELINE, SCHEMA, XSD, compact, encode_for_uri, local_name, source_name
from confluo.operators import exports, identity, reports
from confluo.operators.clean import default_clean
from confluo.operators.components import connected_components
from confluo.operators.mapping import map_sources
from confluo.operators.matching import block_pairs, clusters_of, link_edges, match_rule, pair_frame, ranked, split_vetoed
from confluo.operators.resolve import resolve
from confluo.plans import engine, sparql
from confluo.sources import readers
from confluo.streaming import harvest

P = PIPELINE
JSON = "http://example.org/file-type/JSON"


def federation(rule: dict, dedup=True, **more) -> Federation:
    fields = (TargetField(P + "t-id", SCHEMA + "identifier", True), TargetField(P + "t-name", SCHEMA + "name"), TargetField(P + "t-zip", SCHEMA + "postalCode"))
    source = Source(P + "sSource", JSON, (Field(P + "f-id", "id", iri_source=True), Field(P + "f-name", "name"), Field(P + "f-zip", "zip")), dedup_within=dedup)
    maps = tuple(FieldMapping((P + f"f-{n}",), (P + f"t-{n}",)) for n in ("id", "name", "zip"))
    schema = TargetSchema(P + "thing", SCHEMA + "Thing", fields)
    return Federation((source,), (schema,), fields, (Mapping(P + "m", source.iri, schema.iri, maps),), (MatchRule(P + "rule", schema.iri, "urn:t:", "x-", **rule),), **more)


def facts(spark, fed, rows):
    return map_sources({"s": default_clean(spark.createDataFrame(rows, "id string, name string, zip string"), fed.sources[0])}, fed)


def edges(spark, fed, rows, same=(), different=()):
    iri = lambda pairs: pair_frame(spark, tuple((f"{P}s-{a}", f"{P}s-{b}") for a, b in pairs))
    _, kept, vetoed = match_rule(facts(spark, fed, rows), fed, fed.rules[0], iri(same), iri(different))
    short = lambda r: tuple(sorted((r.a.rpartition("-")[2], r.b.rpartition("-")[2])))
    return {short(r) for r in kept.collect()}, {short(r) for r in vetoed.collect()}


ROWS = [("a", "Alpha Hall", "1"), ("b", "Alpha Hall", "1"), ("c", "Alpha Hall", "2"), ("d", None, "1"), ("e", "Alpha Hall", None), ("f", "  ", "1")]


def test_criteria_and_nulls(spark):
    assert edges(spark, federation({"hard": (SCHEMA + "postalCode",)}), ROWS)[0] == {t for t in itertools.combinations("abdf", 2)}
    both = {"hard": (SCHEMA + "postalCode",), "weighted": (Criterion(SCHEMA + "name"),)}
    assert edges(spark, federation(both), ROWS)[0] == {("a", "b")}
    assert edges(spark, federation({"weighted": (Criterion(SCHEMA + "name"),), "min_score": 1.0}), ROWS)[0] == set(itertools.combinations("abce", 2))
    assert edges(spark, federation({}), ROWS)[0] == set()
    assert edges(spark, federation({"hard": (SCHEMA + "postalCode",)}, dedup=False), ROWS)[0] == set()


def test_floor_and_threshold(spark):
    rows = [("a", "Central City Library", "1"), ("b", "Central City Hall", "1"), ("c", "Old Mill", "1")]
    free = federation({"weighted": (Criterion(SCHEMA + "name", 0.5),)})
    assert len(edges(spark, free, rows)[0]) == 3  # no threshold: every pair with values
    assert edges(spark, federation({"weighted": (Criterion(SCHEMA + "name", 1.0, 0.7),)}), rows)[0] == {("a", "b")}
    assert edges(spark, federation({"weighted": (Criterion(SCHEMA + "name"),), "min_score": 0.99, "algorithm": "ratio"}), rows)[0] == set()


def test_same_as_overrules_and_veto_only_cuts_the_edge(spark):
    rule = {"hard": (SCHEMA + "postalCode",)}
    kept, vetoed = edges(spark, federation(rule), ROWS, same=[("c", "e"), ("a", "zz")], different=[("b", "a"), ("a", "c"), ("c", "e")])
    assert ("a", "b") not in kept and vetoed == {("a", "b")} and ("c", "e") in kept
    fed = federation(rule)
    rows, evidence, _ = match_rule(facts(spark, fed, ROWS), fed, fed.rules[0], pair_frame(spark, ()), pair_frame(spark, ((f"{P}s-a", f"{P}s-b"),)))
    roots = {r.member[-1]: r.root for r in clusters_of(rows, evidence).collect()}
    assert roots["a"] == roots["b"] == roots["d"] and roots["c"] != roots["a"]  # joined again through d
    veto = pair_frame(spark, ((f"{P}s-a", f"{P}s-b"),))
    few = link_edges(rows, fed, fed.rules[0], evidence, pair_frame(spark, ()), veto)
    assert {r.member[-1]: r.root for r in clusters_of(rows, few).collect()} == roots


def decided(spark, groups, registry, taken=None):
    members = [(f"r{k}", sorted(g), len(g)) for k, g in enumerate(groups)]
    clusters = spark.createDataFrame([(r, m) for r, g, _ in members for m in g], "root string, member string")
    reg = spark.createDataFrame([(m, i, k) for k, (m, i) in enumerate(registry.items())], identity.REGISTRY)
    done = identity.assign(ranked(clusters), reg, "urn:t:", "x-", taken)
    out = {tuple(r.members): (r.entity_iri, r.reused) for r in done.decisions.collect()}
    return out, {(r.notice, r.entity_iri) for r in done.notices.collect()}, done, reg


def test_known_clusters_merge_and_split(spark):
    out, notices, done, reg = decided(spark, [["a", "b", "c"], ["d"], ["e", "f"]], {"a": "urn:2", "b": "urn:1", "d": "urn:3", "e": "urn:3", "f": "urn:3", "gone": "urn:9"})
    assert out[("a", "b", "c")] == ("urn:1", True) and ("merged", "urn:1") in notices
    assert out[("e", "f")] == ("urn:3", True)  # the largest fragment keeps the IRI
    assert out[("d",)][0].startswith("urn:t:x-") and not out[("d",)][1] and ("split", out[("d",)][0]) in notices
    after = {r.member: r.entity_iri for r in identity.update_registry(reg, done.decisions).collect()}
    assert after["gone"] == "urn:9" and after["d"] == out[("d",)][0] and after["c"] == "urn:1"
    assert [(r.event, r.entity_iri, r.members) for r in identity.events(done.decisions).collect()] == [("MemberJoined", "urn:1", ["c"])]


def test_minted_collisions_are_rehashed(spark):
    import hashlib

    first = hashlib.sha1(b"a").hexdigest()[:12]
    second = hashlib.sha1(first.encode()).hexdigest()[:12]
    out, _, _, _ = decided(spark, [["a"]], {"zz": f"urn:t:x-{first}"})
    assert out[("a",)][0] == f"urn:t:x-{second}"


def test_harvesting_off_keeps_state(spark):
    fed = federation({"hard": (SCHEMA + "name",)}, harvesting=False)
    result = engine.federate(spark, fed, {"s": spark.createDataFrame(ROWS, "id string, name string, zip string")})
    assert result.registry.count() == 0 and result.history.count() == 0 and result.clusters.count() == 6


def test_result_does_not_depend_on_row_order(spark):
    fed = federation({"weighted": (Criterion(SCHEMA + "name"),), "min_score": 0.8})
    rows = [(str(k), random.Random(k).choice(["North Hall", "North Hall East", "South Hall", "Mill"]), "1") for k in range(30)]
    seen = set()
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        out = engine.federate(spark, fed, {"s": spark.createDataFrame(rows, "id string, name string, zip string")})
        seen.add(tuple(sorted(map(str, out.final.collect()))))
        again = engine.federate(spark, fed, {"s": spark.createDataFrame(rows, "id string, name string, zip string")}, registry=out.registry, history=out.history)
        assert identity.same_registry(out.registry, again.registry) and again.history.count() == out.history.count()
        covered = out.merged.join(out.provenance, ["entity_iri", "predicate", "value"], "left_anti")
        assert covered.isEmpty()
    assert len(seen) == 1


def merged_rows(spark):
    rows = [("e1", "p", v, "literal", None, None) for v in ("b", "a", "ä", "Z")] + [("e1", "q", v, "literal", None, None) for v in ("2", "10")] + [("e2", SCHEMA + "identifier", "x", "literal", None, None), ("e2", "p", "c", "literal", XSD + "integer", None)]
    return spark.createDataFrame(rows, "entity_iri string, predicate string, value string, kind string, datatype string, lang string")


def test_strategies(spark):
    rows = lambda rule: sorted((r.entity_iri, r.predicate, r.value) for r in resolve(merged_rows(spark), rule).collect())
    assert rows(ResolveRule()) == [("e1", "p", "a"), ("e1", "q", "10"), ("e2", "p", "c")]
    assert rows(ResolveRule("concatenateAll")) == [("e1", "p", "Z, a, b, ä"), ("e1", "q", "10, 2"), ("e2", "p", "c")]
    assert rows(ResolveRule("alphabeticFirst", {"q": "keepAll"})) == [("e1", "p", "a"), ("e1", "q", "10"), ("e1", "q", "2"), ("e2", "p", "c")]
    with pytest.raises(ValueError, match="unknown resolve strategy"):
        resolve(merged_rows(spark), ResolveRule("first"))


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc é", max_size=12), st.text(alphabet="abc é", max_size=12))
def test_similarity_properties(a, b):
    assert similarity.lcs(a, b) == slow_lcs(a, b)
    for f in similarity.FUNCTIONS.values():
        assert f(a, b) == f(b, a) and 0 <= f(a, b) <= 100
        assert f(a, a) == (100 if similarity.process(a) else 0)


def test_similarity_goldens(spark):
    f = similarity.token_set_ratio
    assert [f("Entry One", "Entry Two"), f("Central City Library", "Central City Library (Main Branch)"), f("Riverside Branch Library", "Riverside Library")] == [78, 100, 100]
    assert similarity.ratio("SKM Krefeld", "SKM Warendorf") == 58 and f(None, "x") == 0
    rows = spark.createDataFrame([("kitten!", "sitting"), ("", "x"), ("abc", "abc")], "a string, b string")
    got = rows.select(similarity.ratio_expression(F.col("a"), F.col("b")), similarity.similarity("ratio")(F.col("a"), F.col("b"))).collect()
    assert all(x == y for x, y in got)
    with pytest.raises(ValueError, match="unknown algorithm"):
        similarity.similarity("soundex")


def test_components_match_union_find(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 470)] + [(500, 500), (501, 500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == {x: find(x) for x in parent}


def test_terms(spark):
    assert (local_name("http://x/y#z"), source_name(P + "fooSource"), compact(SCHEMA + "name", {"schema": SCHEMA})) == ("z", "foo", "schema:name")
    row = spark.createDataFrame([("a b*~/ü",)], "x string").select(encode_for_uri(F.col("x"))).first()
    assert row[0] == "a%20b%2A~%2F%C3%BC"


def test_turtle_reader():
    g = turtle.Graph(turtle.parse('@prefix : <urn:p#> . @base <http://b/> .\n<x> a :T ; :n 1, 2.5, true ; :s "a\\"b"@en-GB , """long\n"q" """^^:d ; :o [ :k ( 1 "z" ) ; ] . # end\n_:b :p <x> .'))
    assert g.subjects_of_type("urn:p#T") == ["http://b/x"]
    assert g.objects("http://b/x", "urn:p#n") == ["1", "2.5", "true"]
    assert [(t.value, t.lang, t.datatype and t.datatype[-1]) for t in g.terms("http://b/x", "urn:p#s")] == [('a"b', "en-gb", "g"), ('long\n"q" ', None, "d")]
    for bad in ("<a> <b> .", "x:y a x:z .", "<a> <b> <c>", '<a> <b> "c'):
        with pytest.raises(ValueError):
            turtle.parse(bad)


def test_problems_name_unknown_settings():
    fed = federation({"hard": (), "algorithm": "soundex"})
    fed = Federation(fed.sources, fed.schemas, fed.fields, fed.mappings, fed.rules, ResolveRule("x"))
    found = " ".join(config.problems(fed))
    assert "soundex" in found and "unknown resolve strategy x" in found


def test_xml_html_and_spreadsheets(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.xml").write_text("<all><record><id>1</id><name>A</name></record><record><id>2</id></record></all>")
    assert sorted((r.id, r.name) for r in readers.reader_for("http://e/XML")(spark, str(tmp_path / "x"), {}).collect()) == [(1, "A"), (2, None)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.html").write_text('<div class="c d"><p>One <b>x</b><p id=q>Two</div><ul><li><a href="/k?a=1&amp;b=2">L</a></ul><script>no</script>')
    got = readers.read_html(spark, str(tmp_path / "h"), {"_selector": "div.c > p, #q, ul a[href^='/k']"}).orderBy("position").collect()
    assert [(r.tag, r.text) for r in got][0][0] == "p" and got[-1].attrs["href"] == "/k?a=1&b=2"
    assert [e["text"] for e in readers.select_html("<ul><li>a<li>b</ul>", "li")][-1] == "b"
    with pytest.raises(ValueError):
        readers.html_elements(F.col("x"), "p:first-child")
    buffer = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>na</t><t>me</t></si><si><t>Ada</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row><row><c r="B3" t="inlineStr"><is><t>Bo</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "s").mkdir()
    (tmp_path / "s/b.xlsx").write_bytes(buffer.getvalue())
    assert sorted((r.id or "", r["name"]) for r in readers.read_xlsx(spark, str(tmp_path / "s"), {}).collect()) == [("", "Bo"), ("7", "Ada")]
    with pytest.raises(ValueError, match="no reader"):
        readers.reader_for("http://e/CSV")


def test_nested_json_facts(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, null]}, "c": "x"}')], "k long, j string")
    got = {r.path: r.value for r in readers.json_facts(df, "k", "j").collect()}
    assert got == {"$/a": None, "$/a/b": None, "$/a/b/1": "1", "$/a/b/2": None, "$/c": "x"}


def test_json_facts_have_no_limit_of_rows_or_levels(spark):
    deep = "[" * 5 + "7" + "]" * 5
    df = spark.createDataFrame([(k, deep) for k in range(30)] + [(30, None), (31, "{}"), (32, "5")], "k long, j string")
    limits = {"spark.sql.cteRecursionRowLimit": "20", "spark.sql.cteRecursionLevelLimit": "3"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        got = sorted((r.k, r.path, r.value, r.type) for r in readers.json_facts(df, "k", "j").collect())
    finally:
        for name in limits:
            spark.conf.unset(name)
    assert got == [(k, "$" + "/1" * d, "7" if d == 5 else None, "BIGINT" if d == 5 else "ARRAY") for k in range(30) for d in range(1, 6)]


def triples(spark):
    rows = [("urn:a", "urn:knows", "urn:b", "iri", None, None), ("urn:b", "urn:knows", "urn:c", "iri", None, None), ("urn:c", "urn:knows", "urn:a", "iri", None, None), ("urn:a", "urn:name", "Ann", "literal", None, "en"), ("urn:b", "urn:name", "Bob", "literal", XSD + "string", None), ("urn:a", "urn:age", "41", "literal", XSD + "integer", None), ("urn:b", "urn:age", "9", "literal", XSD + "integer", None), ("urn:c", "urn:born", "2001-02-03T04:05:06Z", "literal", XSD + "dateTime", None)]
    return spark.createDataFrame(rows, "s string, p string, o string, kind string, datatype string, lang string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT ?x WHERE { ?x <urn:age> ?a } ORDER BY ?a", [("urn:b",), ("urn:a",)]),
        ("SELECT DISTINCT ?y WHERE { <urn:a> <urn:knows>* ?y }", {("urn:a",), ("urn:b",), ("urn:c",)}),
        ("SELECT ?y WHERE { <urn:a> ^<urn:knows> ?y }", {("urn:c",)}),
        ("SELECT ?o WHERE { <urn:a> <urn:age>|<urn:name> ?o }", {("41",), ("Ann",)}),
        ("SELECT ?o WHERE { <urn:a> !(<urn:age>|<urn:knows>) ?o }", {("Ann",)}),
        ("SELECT ?o WHERE { <urn:c> <urn:knows>? ?o }", {("urn:c",), ("urn:a",)}),
        ('SELECT ?x WHERE { ?x <urn:name> "Bob" }', {("urn:b",)}),
        ('SELECT ?x WHERE { ?x <urn:name> "Ann"@en }', {("urn:a",)}),
        ('SELECT ?x WHERE { ?x <urn:name> "Ann" }', set()),
        ("SELECT ?x ?l WHERE { ?x <urn:name> ?n BIND(LANG(?n) AS ?l) FILTER(LANGMATCHES(LANG(?n), \"EN\")) }", {("urn:a", "en")}),
        ("SELECT ?x WHERE { ?x <urn:age> ?a FILTER(?a IN (9, 10) || ?a * 2 = 0) }", {("urn:b",)}),
        ("SELECT (YEAR(?d) AS ?y) (SECONDS(?d) AS ?s) (TZ(?d) AS ?z) WHERE { ?x <urn:born> ?d }", {("2001", "6", "Z")}),
        ("SELECT (SUM(?a) AS ?s) (AVG(?a) AS ?m) (MIN(?a) AS ?l) (SAMPLE(?a) AS ?p) WHERE { ?x <urn:age> ?a }", {("50", "25", "9", "41")}),
        ('SELECT (CONCAT(STRBEFORE("a-b", "-"), STRAFTER("a-b", "-"), UCASE("x")) AS ?r) (COALESCE(?u, "d") AS ?c) (STRLEN("äb") AS ?n) WHERE {}', {("abX", "d", "2")}),
        ("SELECT ?x ?n WHERE { ?x <urn:knows> ?y OPTIONAL { ?x <urn:name> ?n } FILTER(!BOUND(?n)) }", {("urn:c", None)}),
        ("SELECT ?x (COUNT(*) AS ?n) WHERE { ?x ?p ?o } GROUP BY ?x ORDER BY DESC(?n) ?x LIMIT 1 OFFSET 1", [("urn:b", "3")]),
        ("SELECT ?x WHERE { ?x <urn:age> ?a . { SELECT (MAX(?b) AS ?a) WHERE { ?y <urn:age> ?b } } }", {("urn:a",)}),
        ("SELECT (<http://www.w3.org/2001/XMLSchema#integer>(?a) + 1 AS ?n) (ROUND(2.5) AS ?r) (ABS(-3) AS ?b) WHERE { <urn:b> <urn:age> ?a }", {("10", "3", "3")}),
    ],
)
def test_sparql(spark, text, want):
    out = [tuple(r) for r in sparql.values(sparql.query(text, triples(spark))).collect()]
    assert out == want if isinstance(want, list) else set(out) == want


def test_sparql_forms_and_errors(spark):
    t = triples(spark)
    assert sparql.query("ASK { <urn:a> <urn:age> 41 }", t) is True and sparql.query("ASK { <urn:a> <urn:age> 42 }", t) is False
    assert {r.s for r in sparql.query("DESCRIBE ?x WHERE { ?x <urn:age> ?a FILTER(?a < 10) }", t).collect()} == {"urn:b"}
    made = sparql.query('INSERT { ?x <urn:tag> "t" } WHERE { ?x <urn:name> ?n }', t)
    assert {(r.s, r.o) for r in made.collect()} == {("urn:a", "t"), ("urn:b", "t")}
    graph = sparql.query("SELECT ?g WHERE { GRAPH ?g { <urn:a> <urn:age> ?a } }", t.limit(0), {"urn:g": t})
    assert [r.g["value"] for r in graph.collect()] == ["urn:g"]
    assert sparql.results_json(sparql.query("SELECT ?x WHERE { ?x <urn:born> ?d }", t)).first().binding == '{"x":{"type":"uri","value":"urn:c"}}'
    for bad in ("SELECT", "SELECT ?x WHERE { ?x a }", "SELECT ?x WHERE { SERVICE <u> { ?x ?p ?o } }", "SELECT (FOO(?x) AS ?y) WHERE { ?x ?p ?o }", "SELECT ?x WHERE { ?x y:z ?o }"):
        with pytest.raises(ValueError):
            sparql.query(bad, t)


def test_hierarchy_with_cycle_and_orphans(spark):
    edges_ = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")], "node string, parent string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    got = {r.node: (r.parent, r.depth) for r in reports.hierarchy(nodes, edges_).collect()}
    assert got == {"a": (None, 0), "b": ("a", 1), "c": ("b", 2), "x": (None, 0), "y": ("x", 1), "z": (None, 0)}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("urn:1", "urn:n", 'a "q", b', "literal", None, None), ("urn:1", "urn:k", "x", "literal", None, None), ("urn:1", "urn:k", "y", "literal", None, None), ("urn:2", "urn:z", "no", "literal", None, None)], "entity_iri string, predicate string, value string, kind string, datatype string, lang string")
    fields = {"urn:n": "n", "urn:k": "k"}
    assert [r.line for r in exports.csv_lines(rows, fields).collect()] == ['urn:1,"a ""q"", b",x; y'] and exports.csv_header(fields) == "iri,n,k"
    assert exports.json_objects(rows, fields).first().json == '{"iri":"urn:1","n":"a \\"q\\", b","k":["x","y"]}'
    for fmt in ("csv", "json", "jsonld", "ttl"):
        exports.write(rows, fields, fmt, str(tmp_path / fmt))
        assert spark.read.text(str(tmp_path / fmt)).count() >= 1
    with pytest.raises(ValueError):
        exports.write(rows, fields, "pdf", str(tmp_path / "pdf"))
    plugins = exports.Exporters()
    plugins.add("count", lambda df: str(df.count()).encode())
    assert plugins.run("count", rows) == b"4"


def test_stream_of_harvests(spark, tmp_path):
    fed = federation({"hard": (SCHEMA + "name",)})
    harvester = harvest.Harvester(spark, fed, str(tmp_path / "state"))
    folder = tmp_path / "in"
    schema = "id string, name string, zip string"
    for n, rows in enumerate(([("a", "Hall", "1"), ("b", "Mill", "1")], [("c", "Hall", "2"), ("b", "Mill", "9")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
        q = harvest.start(spark, harvester, P + "sSource", spark.readStream.schema(schema).json(str(folder)), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        harvester = harvest.Harvester(spark, fed, str(tmp_path / "state"))  # as after a restart of the driver
    by = {r.member[-1]: r.entity_iri for r in harvester.registry.collect()}
    assert by["a"] == by["c"] != by["b"]
    assert sorted((r.revision, r.event) for r in harvester.history.collect()) == [(1, "Minted"), (1, "Minted"), (2, "MemberJoined")]
    assert harvester.harvest == 2 and harvester.add(P + "sSource", spark.createDataFrame([("z", "New", "1")], schema), 1) is None and harvester.harvest == 2
    last = harvester.add(P + "sSource", spark.createDataFrame([("z", "New", "1"), ("z", "Newer", "2"), ("a", "Hall", "7")], schema), 7)
    assert last.final.where("value in ('New', 'Newer')").count() == 1 and last.merged.where("value = '7'").count() == 1 and harvester.harvest == 3


def test_empty_facts(spark):
    none = spark.createDataFrame([], FACTS)
    fed = federation({"hard": (SCHEMA + "name",)})
    rows, evidence, _ = match_rule(none, fed, fed.rules[0])
    assert clusters_of(rows, evidence).count() == 0


@pytest.mark.parametrize("untrusted", [[], ["s0"], ["s0", "s1"]])
def test_few_edges_give_the_components_of_all_pairs(spark, untrusted):
    from confluo.operators.matching import block_edges

    rng = random.Random(len(untrusted))
    rows = spark.createDataFrame([(f"r{k:02}", f"s{rng.randrange(3)}", rng.choice("uvwxyz") if k else None) for k in range(40)], "record string, source string, v0 string")
    different = pair_frame(spark, tuple((f"r{rng.randrange(40):02}", f"r{rng.randrange(40):02}") for _ in range(6)))
    pairs = block_pairs(rows, ["v0"], untrusted).select(F.col("a_record").alias("a"), F.col("b_record").alias("b"))
    want = clusters_of(rows, split_vetoed(pairs, different)[0])
    got = clusters_of(rows, block_edges(rows, ["v0"], untrusted, different))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("untrusted", [[], ["s0"], ["s0", "s1"]])
def test_blocks_in_pieces_give_each_pair_once(spark, monkeypatch, untrusted):
    from confluo.operators import matching

    monkeypatch.setattr(matching, "TILE", 3)
    rng = random.Random(len(untrusted))
    data = [(f"r{k:02}", rng.choice(["s0", "s1", "s2", None]), rng.choice("uv") if k else None) for k in range(40)]
    pairs = block_pairs(spark.createDataFrame(data, "record string, source string, v0 string"), ["v0"], untrusted)
    apart = lambda a, b: a[1] == b[1] and a[1] in untrusted
    want = sorted((*a, *b) for a, b in itertools.combinations(data, 2) if a[2] and a[2] == b[2] and not apart(a, b))
    assert sorted(map(tuple, pairs.collect()), key=str) == sorted(want, key=str)
    # rows of an untrusted source do not meet each other: no piece has them on both sides
    one = block_pairs(spark.createDataFrame([(f"r{k:02}", "s0", "u") for k in range(20)], "record string, source string, v0 string"), ["v0"], ["s0"])
    assert one.isEmpty()


@pytest.mark.parametrize("counted", [False, True])
def test_pieces_of_trusted_sources_are_dealt_to_many_tasks(spark, monkeypatch, counted):
    from confluo.operators import matching

    monkeypatch.setattr(matching, "TILE", 4)
    if counted:
        monkeypatch.setattr(matching, "TASK", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        data = [(f"r{k:02}", "s0", "u") for k in range(40)]
        more = {"counted": True} if counted else {}
        pairs = block_pairs(spark.createDataFrame(data, "record string, source string, v0 string"), ["v0"], **more)
        found = pairs.select("a_record", "b_record", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((a, b) for a, b, _ in found) == sorted(itertools.combinations([r for r, _, _ in data], 2))
    # 55 pieces: in all parts there are, or in more of them where their number follows from the sizes
    assert len({part for _, _, part in found}) >= (20 if counted else 2)


@pytest.mark.parametrize(("algorithm", "score"), [("ratio", 1.0), ("token_sort_ratio", 0.98)])
def test_strict_thresholds_join_equal_texts(spark, algorithm, score):
    from confluo.operators import matching

    rng, long = random.Random(7), "abcd efgh " * 30
    names = [f"Name {rng.randrange(20)}" for _ in range(40)] + ["NAME-3", "3 name", "!", "", "\u0130x", "i\u0307x"]
    names += [long, long + "z", long[:150] + "q" + long[150:], long[5:], long[:95], long[:95] + "y", "x" * 20 + "y", "x" * 20]
    data = [(f"r{k:02}", "s", n) for k, n in enumerate(names)]
    rows = spark.createDataFrame(data, "record string, source string, v0 string")
    rule = MatchRule("r", "s", "n", "p", weighted=(Criterion("p", 1.0),), min_score=score, algorithm=algorithm)
    of = similarity.FUNCTIONS[algorithm]
    want = {tuple(sorted((a, b))) for a in set(names) for b in set(names) if of(a, b) / 100 >= score}
    assert {tuple(sorted((r.x_v0, r.y_v0))) for r in matching.scored_values(rows, rule, 0).collect()} == want
    plan = matching.scored_values(rows, rule, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "(x__key" in plan.replace("NOT (x__key", "")  # an equality to join by, so that not all pairs are scored


@pytest.mark.parametrize("untrusted", [False, True])
@pytest.mark.parametrize("weighted", [False, True])
def test_clusters_and_counts_without_pairs(spark, untrusted, weighted):
    from confluo.operators.matching import pair_counts, rule_clusters

    rng = random.Random(3)
    rule = {"hard": (SCHEMA + "postalCode",)} | ({"weighted": (Criterion(SCHEMA + "name"),), "min_score": 0.7, "algorithm": "ratio"} if weighted else {})
    fed = federation(rule, dedup=not untrusted)
    data = [(f"{k:02}", rng.choice(["Alpha Hall", "Alpha Halls", "Mill", "Old Mill", "!", "Tower", None]), rng.choice("123") if k else None) for k in range(45)]
    rows = facts(spark, fed, data).withColumn("value", F.when((F.col("predicate").endswith("fromSource")) & (F.substring("record", -1, 1) < "3"), P + "other").otherwise(F.col("value")))
    at = lambda k: f"{P}s-{k:02}"
    same = pair_frame(spark, ((at(1), at(2)), (at(0), at(44)), (at(3), "none")))
    veto = pair_frame(spark, tuple((at(rng.randrange(45)), at(rng.randrange(45))) for _ in range(60)))
    for curated in ((None, None), (same, veto)):
        records, evidence, vetoed = match_rule(rows, fed, fed.rules[0], *curated)
        got = rule_clusters(records, fed, fed.rules[0], None if weighted else evidence, *curated).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, clusters_of(records, evidence).collect()))
        counts = pair_counts(records, fed, fed.rules[0], *curated).first()
        manual = evidence.where("manual").count()
        assert tuple(counts) == (manual, evidence.count() - manual, vetoed.count())


def test_pairs_are_not_written_on_the_way(spark, monkeypatch):
    written, write = [], engine.materialize
    monkeypatch.setattr(engine, "materialize", lambda df, name="step": written.append(name) or write(df, name))
    fed = federation({"hard": (SCHEMA + "postalCode",), "weighted": (Criterion(SCHEMA + "name"),), "min_score": 1.0, "algorithm": "ratio"})
    out = engine.federate(spark, fed, {"s": spark.createDataFrame(ROWS, "id string, name string, zip string")}, at="2024-01-01 00:00:00")
    assert "clusters" in written and "pairs" not in written
    assert [(r.a[-1], r.b[-1], r.aggregate) for r in out.pairs.collect()] == [("a", "b", 1.0)]


def test_html_of_any_depth():
    from confluo.sources.readers import select_html

    deep = "<div class=a>" * 5000 + "<p>in <b>it</b></p>" + "</div>" * 5000
    assert [e["text"] for e in select_html(deep, ".a > .a p")] == ["in it"] and len(select_html(deep, "div")) == 5000
    page = "<ul id=x><li><a>1</a></li><li class='k'><span><a>2</a></span></li></ul><a>3</a>"
    assert [[e["text"] for e in select_html(page, s)] for s in ("li > a", "ul a", "#x > a", "ul > .k a", "a", "li a, span")] == [["1"], ["1", "2"], [], ["2"], ["1", "2", "3"], ["1", "2", "2"]]


def test_html_titles_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from confluo import queries

    titles = ["a &amp;&amp", "&lt;b&gt; &quot;&amp;lt;&quot;", "one <b>two</b>  \n three", "&nbsp;x&#39;y &eacute &ampx;", " \u00a0 z\u000b ", "", "&amp"]
    pages = [f"<!DOCTYPE html><html><head><title>{t}</title></head><body><p>&amp</p><a href='#'>x</a></body></html>" for t in titles]
    pages += [None, "", "<p>no title</p>", "<title>no head</title><title>second</title>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(queries.ORACLE["lift_html_titles"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in queries.lift_html_titles(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and dict(got)[0] == "a &&amp"
    assert readers.select_html("<p>a &amp&eacute;</p>", "p")[0]["text"] == "a &\u00e9"


def test_numbering_is_dense_and_in_order(spark):
    from confluo.plans.skew import numbered

    out = numbered(spark.range(500).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(97))), [F.col("k").desc(), F.col("id")], "n").collect()
    assert [r.n for r in sorted(out, key=lambda r: (-r.k, r.id))] == list(range(1, 501))
