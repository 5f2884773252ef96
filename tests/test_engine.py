"""Golden runs: a small instance on engine defaults over three harvests, and a directory of venues and courses."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from confluo import config
from confluo.__main__ import main
from confluo.config import Criterion, Federation, Field, FieldMapping, Mapping, MatchRule, Source, TargetField, TargetSchema, from_turtle, validate
from confluo.functions import turtle
from confluo.functions.terms import COMMON_PREFIXES, PIPELINE, RDF_TYPE, SCHEMA
from confluo.operators import reports
from confluo.operators.clean import record_iri, split_entities
from confluo.plans.engine import JOURNAL, Pipeline, federate

JSON_FORMAT = "http://example.org/file-type/JSON"

# Keys, names, namespace and prefix from which the golden identifiers below follow.
FIRST = {"alpha": {"a1": "Entry One", "a2": "Entry Two"}, "beta": {"b1": "Entry One", "b2": "Entry Three"}}
SECOND = {"beta": {"b1": "Entry One", "b2": "Entry Drei"}}
THIRD = {"alpha": {"a1": "Entry One", "a2": "Entry Two", "a3": "Entry Drei"}}
MINTED = {"Entry One": "urn:test:thing-e427416d02ac", "Entry Two": "urn:test:thing-5a45645edb31", "Entry Three": "urn:test:thing-d1583c098826"}
COLUMNS = {"alpha": ("id", "name"), "beta": ("id", "label")}


def configuration() -> str:
    """Every source has a key and a name column; equal names are one thing."""
    lines = [f"@prefix : <{PIPELINE}> . @prefix schema: <{SCHEMA}> .", ":f a :Federation ."]
    for target, predicate in (("key", "identifier"), ("title", "name")):
        lines.append(f":{target} a :TargetField ; :targetPredicate schema:{predicate} .")
    lines.append(":kind a :TargetSchema ; :targetClass schema:Thing .")
    for source, (key, title) in COLUMNS.items():
        lines.append(f":f :hasSource :{source}Source . :{source}Source a :Source ; :format <{JSON_FORMAT}> ; :hasField :{source}-0 , :{source}-1 .")
        lines.append(f':{source}-0 :fieldPath "{key}" ; :iriSource true . :{source}-1 :fieldPath "{title}" .')
        pairs = " , ".join(f"[ :from :{source}-{k} ; :to :{target} ]" for k, target in enumerate(("key", "title")))
        lines.append(f":{source}-map a :Mapping ; :fromSource :{source}Source ; :toTarget :kind ; :hasFieldMapping {pairs} .")
    lines.append(':rule a :MatchRule ; :forTarget :kind ; :targetNamespace "urn:test:" ; :mintedSubjectPrefix "thing-" ; :minScore 1.0 ; :hasWeightedCriterion [ :on schema:name ; :weight 1.0 ] .')
    return "\n".join(lines)


def put(root: Path, harvest: dict[str, dict[str, str]]) -> None:
    for source, rows in harvest.items():
        folder = root / "sources" / source / "static"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "data.json").write_text(json.dumps([dict(zip(COLUMNS[source], row, strict=True)) for row in rows.items()]))


@pytest.fixture
def instance(tmp_path):
    (tmp_path / "config").mkdir()
    (tmp_path / "config/federation.ttl").write_text(configuration())
    put(tmp_path, FIRST)
    return tmp_path


def by_entity(df):
    out: dict[str, set] = {}
    for r in df.collect():
        out.setdefault(r.entity_iri, set()).add(r.member)
    return out


def text_of(folder: Path) -> str:
    return "\n".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_three_harvests_keep_identity(spark, instance):
    pipeline = Pipeline(spark, str(instance), exporters={"names": lambda df: df.where("predicate like '%name'").select("value")})
    assert pipeline.validate() == []
    one = pipeline.run(at="2024-01-01 00:00:00", graphs=True)
    head = "".join(f"@prefix {p}: <{base}>.\n" for p, base in {**COMMON_PREFIXES, "cdf": "urn:test:"}.items())
    blocks = [f'cdf:{iri[9:]} a schema:Thing;\n    schema:name "{name}".\n' for iri, name in sorted((iri, name) for name, iri in MINTED.items())]
    assert turtle.document(one.final, {**COMMON_PREFIXES, "cdf": "urn:test:"}) == head + "\n" + "".join(blocks)
    record = {k: PIPELINE + f"{s}-{k}" for s, rows in FIRST.items() for k in rows}
    wanted = {MINTED["Entry Two"]: {record["a2"]}, MINTED["Entry Three"]: {record["b2"]}, MINTED["Entry One"]: {record["a1"], record["b1"]}}
    assert by_entity(one.registry) == wanted
    assert sorted((r.revision, r.event, r.entity_iri) for r in one.history.collect()) == sorted((1, "Minted", iri) for iri in MINTED.values())
    assert sorted(r.value for r in pipeline.export("names").collect()) == sorted(MINTED)
    with pytest.raises(ValueError, match="no exporter"):
        pipeline.export("other")

    # what was published
    assert pipeline.load_state("merged").count() == one.merged.count() == 4 + 4 + 3 + 3  # identifiers, sources, types, names
    graphs = instance / "artifacts/turtle/00000001"
    for name, n in (("mapped", one.mapped.count()), ("merged", one.merged.count()), ("final", one.final.count())):
        assert len(turtle.parse(text_of(graphs / name))) == n
    matches = turtle.Graph(turtle.parse(text_of(graphs / "matches")))
    assert set(matches.subjects_of_type(PIPELINE + "MatchCluster")) == set(MINTED.values())
    assert set(matches.objects(MINTED["Entry One"], PIPELINE + "hasMember")) == {record["a1"], record["b1"]}
    (evidence,) = matches.subjects_of_type(PIPELINE + "MatchEvidence")
    assert set(matches.objects(evidence, PIPELINE + "pair")) == {record["a1"], record["b1"]} and matches.first(evidence, PIPELINE + "aggregateScore") == "1.000"
    (criterion,) = matches.objects(evidence, PIPELINE + "onCriterion")
    assert [matches.first(criterion, PIPELINE + x) for x in ("on", "similarity", "weight", "valueA", "valueB")] == [SCHEMA + "name", "1.000", "1.00", "Entry One", "Entry One"]
    assert {(s.value, o.value) for s, _, o in turtle.parse(text_of(graphs / "identity"))} == {(e, m) for e, ms in wanted.items() for m in ms}
    assert text_of(graphs / "provenance").count("rdf:reifies <<(") == one.provenance.count()
    assert text_of(graphs / "history").count("cdp:minted [ cdp:entity") == 3
    steps = turtle.Graph(turtle.parse((graphs / "federate-log.ttl").read_text()))
    assert steps.objects(PIPELINE + "mergeStep", "http://purl.org/net/p-plan#isPrecededBy") == [PIPELINE + "matchStep"]
    assert steps.objects(PIPELINE + "cleanAlpha", "http://purl.org/net/p-plan#isPrecededBy") == [PIPELINE + "liftAlpha"]
    ingested = turtle.Graph(turtle.parse((graphs / "ingest-log.ttl").read_text()))
    assert ingested.objects(PIPELINE + "fetchBeta", PIPELINE + "fromSource") == [PIPELINE + "betaSource"]

    put(instance, SECOND)
    two = pipeline.run(at="2024-01-02 00:00:00")
    assert by_entity(two.registry) == wanted and two.history.count() == 3
    journal = pipeline.load_state("journal", JOURNAL)
    assert sorted(r.step for r in journal.collect()) == sorted([f"{k}-{s}" for k in ("fetch", "lift", "clean") for s in COLUMNS] + ["map", "match", "merge", "resolve"])
    assert journal.where("file_time is not null").count() == 2
    assert pipeline._snapshots("registry") == ["00000001"] and pipeline._snapshots("final") == ["00000001", "00000002"]

    put(instance, THIRD)
    three = Pipeline(spark, str(instance)).run(at="2024-01-03 00:00:00")
    joined = [r.member for r in three.registry.where(F.col("entity_iri") == MINTED["Entry Three"]).orderBy("seq").collect()]
    assert joined == [record["b2"], PIPELINE + "alpha-a3"]
    last = three.history.where("revision = 2").collect()
    assert [(r.event, r.entity_iri, r.members) for r in last] == [("MemberJoined", MINTED["Entry Three"], [PIPELINE + "alpha-a3"])]


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "own")
    assert main(["init", "--root", root]) == 0 and main(["init", "--root", root]) == 1
    assert main(["validate", "--root", root]) == 0 and main(["ingest", "--root", root]) == 0 and main(["federate", "--root", root]) == 0
    assert "instance valid" in capsys.readouterr().out
    final = Pipeline(spark, root).load_state("final")
    assert sorted(r.value for r in final.where(F.col("predicate") == SCHEMA + "name").collect()) == ["Chess Room", "Harbour Pool", "Old Mill"]
    Path(root, "plugins.py").write_text("PLUGINS = {'exporters': {'n': lambda df: str(df.count()).encode()}}")
    assert main(["export", "n", "--root", root]) == 0 and main(["export", "m", "--root", root]) == 1
    Path(root, config.CONFIG_FILE).write_text("nonsense")
    assert main(["run", "--root", root]) == 1


# Three sources of one town: halls, clubs with a nested address, and courses that name their place.
HALLS = [
    {"no": 11, "title": "Seaside Sports Hall", "zip": "24103", "call": "0431-100", "site": "https://seaside.example"},
    {"no": 12, "title": "Forest Gym", "zip": "24105", "call": "0431-200", "site": "https://gym.example"},
    {"no": 13, "title": "Canal Pool", "zip": "24106", "call": "0431-300", "site": "https://pool.example"},
]
CLUBS = [
    {"key": "x", "label": "Sports Hall Seaside", "where": {"code": "24103", "street": "Pier 1"}, "call": "0431-100"},
    {"key": "y", "label": "The Forest Gym Club", "where": {"code": "24105", "street": "Oak Lane 4"}, "call": "0431-201"},
    {"key": "z", "label": "Chess Cellar", "where": {"code": "24103", "street": "Dock 9"}, "call": None},
]
COURSES = [
    {"course": "c-1", "subject": "Judo", "place": "Seaside Sports Hall", "place_zip": "24103"},
    {"course": "c-2", "subject": "Yoga", "place": "Forest Gym", "place_zip": "24105"},
    {"course": "c-3", "subject": "Rowing", "place": None, "place_zip": None},
]
P, NS = PIPELINE, "https://example.org/town#"
PLACE = {"identifier": SCHEMA, "name": SCHEMA, "postalCode": SCHEMA, "telephone": SCHEMA, "url": SCHEMA, "streetAddress": SCHEMA}


def town() -> Federation:
    targets = {n: TargetField(f"{P}t-{n}", base + n, n == "identifier") for n, base in PLACE.items()}
    place = TargetSchema(P + "place", SCHEMA + "Place", tuple(targets.values()), "Place")
    course = TargetSchema(P + "course", SCHEMA + "Course", (targets["identifier"], targets["name"]), "Course")
    used = {
        "hall": [(place, {"no": "identifier", "title": "name", "zip": "postalCode", "call": "telephone", "site": "url"})],
        "club": [(place, {"key": "identifier", "label": "name", "where.code": "postalCode", "where.street": "streetAddress", "call": "telephone"})],
        "class": [(place, {"place": "name", "place_zip": "postalCode"}), (course, {"course": "identifier", "subject": "name"})],
    }
    sources, mappings = [], []
    for order, (name, parts) in enumerate(used.items()):
        columns = [c for _, pairs in parts for c in pairs]
        sources.append(Source(f"{P}{name}Source", JSON_FORMAT, tuple(Field(f"{P}{name}-{c}", c.split(".")[-1], c.split(".")[0] if "." in c else None) for c in columns), label=name, order=order))
        for schema, pairs in parts:
            mappings.append(Mapping(f"{schema.iri}-{name}", sources[-1].iri, schema.iri, tuple(FieldMapping((f"{P}{name}-{c}",), (f"{P}t-{t}",)) for c, t in pairs.items())))
    rules = (
        MatchRule(P + "places", place.iri, NS, "place-", 0.8, hard=(SCHEMA + "postalCode",), weighted=(Criterion(SCHEMA + "name"),)),
        MatchRule(P + "courses", course.iri, NS, "course-", 1.0, weighted=(Criterion(SCHEMA + "name"),)),
    )
    return Federation(tuple(sources), (place, course), tuple(targets.values()), tuple(mappings), rules)


def split_courses(df):
    course = (record_iri("class", F.col("course")), P + "course", [F.col("course"), F.col("subject")], [F.col("course")])
    place = (record_iri("class", F.col("place_zip"), "at-"), P + "place", [F.col("place"), F.col("place_zip")], [F.col("place"), F.col("place_zip")])
    return split_entities(df, [course, place])


def keyed(name, column):
    return lambda df: df.select(record_iri(name, F.col(column)).alias("record"), "*")


@pytest.fixture(scope="module")
def directory(spark):
    lifted = {n: spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows])) for n, rows in (("hall", HALLS), ("club", CLUBS), ("class", COURSES))}
    return federate(spark, town(), lifted, {"hall": keyed("hall", "no"), "club": keyed("club", "key"), "class": split_courses}, at="2024-01-01 00:00:00")


SEASIDE, FOREST = {"hall-11", "club-x", "class-at-24103"}, {"hall-12", "club-y", "class-at-24105"}


def entity(kind, members):
    """A fresh IRI: twelve hex digits of the SHA-1 of the smallest member."""
    return f"{NS}{kind}-{hashlib.sha1((P + min(members)).encode()).hexdigest()[:12]}"


def test_town_directory(directory):
    places = [SEASIDE, FOREST, {"hall-13"}, {"club-z"}]
    want = {entity("place", m): {P + x for x in m} for m in places} | {entity("course", {f"class-c-{k}"}): {f"{P}class-c-{k}"} for k in (1, 2, 3)}
    assert by_entity(directory.clusters) == want
    # statements: per record its type, source and non-null fields
    fields = sum(len(r) for r in HALLS) + sum(5 - (r["call"] is None) for r in CLUBS) + 3 * 2 + 2 * 2
    assert directory.mapped.count() == directory.provenance.count() == fields + 2 * (3 + 3 + 3 + 2)
    final = {(r.entity_iri, r.predicate.rpartition("/")[2]): r.value for r in directory.final.collect()}
    seaside, forest = entity("place", SEASIDE), entity("place", FOREST)
    assert final[seaside, "name"] == "Seaside Sports Hall" and final[forest, "name"] == "Forest Gym"
    assert final[forest, "telephone"] == "0431-200" and final[seaside, "streetAddress"] == "Pier 1" and (seaside, "identifier") not in final
    assert final[entity("course", {"class-c-3"}), "name"] == "Rowing"


def test_town_reports(spark, directory):
    multi = directory.federation.multi_valued
    seaside, forest = entity("place", SEASIDE), entity("place", FOREST)
    bad = {(r.entity_iri, r.predicate.rpartition("/")[2]) for r in reports.conflicts(directory.merged, multi).collect()}
    assert bad == {(seaside, "name"), (forest, "name"), (forest, "telephone")}
    total = reports.merge_statistics(directory.merged, directory.provenance, multi).where("type is null").first()
    assert (total.entities, total.deduplicated, total.with_conflicts, total.records, total.sources) == (7, 2, 2, 11, 3)
    sources = reports.source_table(spark, directory.federation)
    columns = reports.record_columns(directory.provenance, sources)
    own = [r.record for r in columns.where(F.col("entity_iri") == seaside).orderBy("place").collect()]
    assert own == [P + "hall-11", P + "club-x", P + "class-at-24103"]
    cards = {r.entity_iri: r for r in reports.assembled(directory.merged, directory.provenance).collect()}
    assert cards[entity("place", {"hall-13"})].label == "Canal Pool"
    wide = {r.predicate: r for r in reports.wide_records(directory.provenance, columns, seaside).collect()}
    assert wide[SCHEMA + "telephone"][P + "hall-11"] == "0431-100" and not wide[SCHEMA + "telephone"][P + "class-at-24103"]
    assert all(r.mapped for r in reports.field_coverage(spark, directory.federation).collect())
    nodes, members = reports.match_lanes(directory.clusters, directory.merged, only_merged=True)
    assert nodes.count() == 2 and members.count() == 6
    overview = {r["name"]: (r.records, r.format) for r in reports.source_overview(sources, directory.mapped).collect()}
    assert overview == {"hall": (3, "JSON"), "club": (3, "JSON"), "class": (5, "JSON")}
    assert reports.of_types(directory.merged, [SCHEMA + "Course"]).where(F.col("predicate") == RDF_TYPE).count() == 3


def test_validation_names_problems(instance):
    (instance / "sources/stray").mkdir()
    assert validate(str(instance)) == ["sources/stray/ has no :hasSource declaration in config/federation.ttl"]
    path, text = instance / "config/federation.ttl", configuration()
    for old, new, problem in (
        (f":betaSource a :Source ; :format <{JSON_FORMAT}> ;", ":betaSource a :Source ;", "needs exactly one :format"),
        (f":format <{JSON_FORMAT}> ;", f":format <{JSON_FORMAT}> , <{JSON_FORMAT}_2> ;", "needs exactly one :format"),
        (f":format <{JSON_FORMAT}> ;", ':format "JSON" ;', "needs exactly one :format"),
        ('"id" ; :iriSource true', '"id"', "no clean function"),
        (":iriSource true", ':iriSource "yes"', ":iriSource must be a single boolean"),
        (":iriSource true", ":iriSource true , false", ":iriSource must be a single boolean"),
    ):
        assert old in text
        path.write_text(text.replace(old, new))
        assert any(problem in p for p in validate(str(instance))), problem
    assert validate(str(instance / "nowhere")) == ["config/federation.ttl missing"]


def test_disabled_sources_are_left_out():
    fed = from_turtle(configuration().replace(":betaSource a :Source ;", ":betaSource a :Source ; :enabled false ;"))
    assert [s.name for s in fed.enabled] == ["alpha"] and [s.name for s in fed.sources] == ["alpha", "beta"]
