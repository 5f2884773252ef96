"""Federation configuration: plain data, a Turtle reader and validation."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from confluo.functions.terms import OWL, PIPELINE, RDFS, SKOS, XSD, format_family, local_name, source_name
from confluo.functions.turtle import Graph, parse
from confluo.plans.storage import LocalStore, Store, join

ALGORITHMS = ("ratio", "token_sort_ratio", "token_set_ratio")
DEFAULT_ALGORITHM = "token_set_ratio"
STRATEGIES = ("alphabeticFirst", "concatenateAll", "keepAll")
CONFIG_FILE = "config/federation.ttl"
KNOWLEDGE_FILE = "config/match-knowledge.ttl"


@dataclass(frozen=True)
class Field:
    iri: str
    path: str
    parent: str | None = None
    iri_source: bool = False
    entity: str | None = None

    @property
    def column(self) -> str:
        return f"{self.parent}.{self.path}" if self.parent else self.path


@dataclass(frozen=True)
class Source:
    iri: str
    format: str | None = None
    fields: tuple[Field, ...] = ()
    fetch_url: str | None = None
    retrieval: str | None = None
    enabled: bool = True
    dedup_within: bool = True
    lift_params: dict[str, str] = field(default_factory=dict)
    label: str | None = None
    notation: str | None = None
    order: int = 0

    @property
    def name(self) -> str:
        return source_name(self.iri)

    @property
    def key(self) -> Field | None:
        """First field that is the record's key."""
        return next((f for f in self.fields if f.iri_source), None)


@dataclass(frozen=True)
class TargetField:
    iri: str
    predicate: str
    multi_valued: bool = False


@dataclass(frozen=True)
class TargetSchema:
    iri: str
    target_class: str
    fields: tuple[TargetField, ...] = ()
    label: str | None = None


@dataclass(frozen=True)
class FieldMapping:
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    via: str | None = None


@dataclass(frozen=True)
class Relationship:
    source_predicate: str
    to_field: str
    to_schema: str


@dataclass(frozen=True)
class Mapping:
    iri: str
    source: str
    target: str | None
    fields: tuple[FieldMapping, ...] = ()
    relationships: tuple[Relationship, ...] = ()


@dataclass(frozen=True)
class Criterion:
    predicate: str
    weight: float = 1.0
    min_similarity: float | None = None


@dataclass(frozen=True)
class MatchRule:
    iri: str
    schema: str
    namespace: str
    prefix: str
    min_score: float | None = None
    algorithm: str = DEFAULT_ALGORITHM
    hard: tuple[str, ...] = ()
    weighted: tuple[Criterion, ...] = ()


@dataclass(frozen=True)
class ResolveRule:
    default: str = "alphabeticFirst"
    overrides: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Federation:
    sources: tuple[Source, ...]
    schemas: tuple[TargetSchema, ...] = ()
    fields: tuple[TargetField, ...] = ()
    mappings: tuple[Mapping, ...] = ()
    rules: tuple[MatchRule, ...] = ()
    resolve: ResolveRule = ResolveRule()
    same_as: tuple[tuple[str, str], ...] = ()
    different_from: tuple[tuple[str, str], ...] = ()
    run_params: dict[str, list[str]] = field(default_factory=dict)
    harvesting: bool = True
    label: str | None = None
    repository: str | None = None
    exporters: tuple[str, ...] = ()

    def source(self, iri: str) -> Source | None:
        return next((s for s in self.sources if s.iri == iri), None)

    def schema(self, iri: str) -> TargetSchema | None:
        return next((s for s in self.schemas if s.iri == iri), None)

    def field(self, iri: str) -> TargetField | None:
        return next((f for f in self.fields if f.iri == iri), None)

    @property
    def enabled(self) -> tuple[Source, ...]:
        """Sources in declaration order without the disabled ones."""
        return tuple(s for s in self.sources if s.enabled)

    @property
    def multi_valued(self) -> list[str]:
        return [f.predicate for f in self.fields if f.multi_valued]


def _fields(g: Graph, owner: str, entity: str | None = None) -> list[Field]:
    out = []
    for iri in g.objects(owner, PIPELINE + "hasField"):
        path = g.first(iri, PIPELINE + "fieldPath")
        if path is None:
            continue
        out.append(Field(iri, path, None, g.first(iri, PIPELINE + "iriSource") == "true", entity))
        for sub in g.objects(iri, PIPELINE + "hasSubField"):
            if (inner := g.first(sub, PIPELINE + "fieldPath")) is not None:
                out.append(Field(sub, inner, path, g.first(sub, PIPELINE + "iriSource") == "true", entity))
    return out


def _source(g: Graph, iri: str, order: int) -> Source:
    has = lambda name: g.first(iri, PIPELINE + name)
    fields = _fields(g, iri)
    for entity in g.objects(iri, PIPELINE + "hasEntity"):
        fields += _fields(g, entity, entity)
    params = {g.first(p, PIPELINE + "name"): g.first(p, PIPELINE + "value") for p in g.objects(iri, PIPELINE + "hasLiftParam")}
    return Source(
        iri, has("format"), tuple(fields), has("fetchUrl"), has("retrieval"), has("enabled") != "false", has("dedupWithinSource") != "false",
        {k: v for k, v in params.items() if k is not None}, g.first(iri, RDFS + "label"), g.first(iri, SKOS + "notation"), order,
    )


def _target_field(g: Graph, iri: str) -> TargetField | None:
    predicate = g.first(iri, PIPELINE + "targetPredicate")
    return None if predicate is None else TargetField(iri, predicate, g.first(iri, PIPELINE + "multiValued") == "true")


def _mapping(g: Graph, iri: str) -> Mapping | None:
    source = g.first(iri, PIPELINE + "fromSource")
    if source is None:
        return None
    fields = tuple(
        FieldMapping(tuple(g.objects(m, PIPELINE + "from")), tuple(g.objects(m, PIPELINE + "to")), g.first(m, PIPELINE + "via"))
        for m in g.objects(iri, PIPELINE + "hasFieldMapping")
    )
    links = []
    for r in g.objects(iri, PIPELINE + "hasRelationship"):
        parts = [g.first(r, PIPELINE + k) for k in ("sourcePredicate", "toTargetField", "toTargetSchema")]
        if all(p is not None for p in parts):
            links.append(Relationship(*parts))
    return Mapping(iri, source, g.first(iri, PIPELINE + "toTarget"), fields, tuple(links))


def _rule(g: Graph, iri: str) -> MatchRule | None:
    schema, ns, prefix = (g.first(iri, PIPELINE + k) for k in ("forTarget", "targetNamespace", "mintedSubjectPrefix"))
    if schema is None or ns is None or prefix is None:
        return None
    score = g.first(iri, PIPELINE + "minScore")
    hard = tuple(on for c in g.objects(iri, PIPELINE + "hasHardCriterion") for on in g.objects(c, PIPELINE + "on"))
    weighted = []
    for c in g.objects(iri, PIPELINE + "hasWeightedCriterion"):
        floor, weight = g.first(c, PIPELINE + "minSimilarity"), g.first(c, PIPELINE + "weight")
        for on in g.objects(c, PIPELINE + "on"):
            weighted.append(Criterion(on, float(Decimal(weight)) if weight is not None else 1.0, float(floor) if floor is not None else None))
    algorithm = g.first(iri, PIPELINE + "matchAlgorithm")
    return MatchRule(iri, schema, ns, prefix, float(score) if score is not None else None, local_name(algorithm) if algorithm else DEFAULT_ALGORITHM, hard, tuple(weighted))


def from_graph(g: Graph, knowledge: Graph | None = None) -> Federation:
    """Read the declared federation; lists keep document order, mappings and rules go by IRI."""
    P = PIPELINE
    root = next(iter(g.subjects_of_type(P + "Federation")), "")
    sources = tuple(_source(g, iri, k) for k, iri in enumerate(g.objects(root, P + "hasSource")))
    fields = tuple(f for iri in g.subjects_of_type(P + "TargetField") if (f := _target_field(g, iri)))
    by = {f.iri: f for f in fields}
    schemas = tuple(
        TargetSchema(iri, c, tuple(by[f] for f in g.objects(iri, P + "hasTargetField") if f in by), g.first(iri, RDFS + "label"))
        for iri in g.subjects_of_type(P + "TargetSchema")
        if (c := g.first(iri, P + "targetClass"))
    )
    overrides, default = {}, "alphabeticFirst"
    for rule in g.subjects_of_type(P + "ResolveRule"):
        default = local_name(g.first(rule, P + "defaultStrategy") or default)
        for o in g.objects(rule, P + "hasOverride"):
            for on in g.objects(o, P + "on"):
                overrides[on] = local_name(g.first(o, P + "strategy") or default)
    params: dict[str, list[str]] = {}
    for name, value in sorted((g.first(p, P + "name") or "", g.first(p, P + "value") or "") for p in g.objects(root, P + "hasRunParam")):
        params.setdefault(name, []).append(value)
    graphs = [g] + ([knowledge] if knowledge else [])
    return Federation(
        sources, schemas, fields,
        tuple(m for iri in sorted(g.subjects_of_type(P + "Mapping")) if (m := _mapping(g, iri))),
        tuple(r for iri in sorted(g.subjects_of_type(P + "MatchRule")) if (r := _rule(g, iri))),
        ResolveRule(default, overrides),
        tuple(dict.fromkeys(p for x in graphs for p in x.pairs(OWL + "sameAs"))),
        tuple(dict.fromkeys(p for x in graphs for p in x.pairs(OWL + "differentFrom"))),
        params, g.first(root, P + "harvestingModeActive") != "false", g.first(root, RDFS + "label"), g.first(root, P + "repository"),
        tuple(g.objects(root, P + "hasExporter")),
    )


def from_turtle(text: str, knowledge: str | None = None) -> Federation:
    return from_graph(Graph(parse(text)), Graph(parse(knowledge)) if knowledge else None)


def load(root: str, store: Store | None = None) -> Federation:
    """The federation of an instance folder."""
    store = store or LocalStore()
    knowledge = join(root, KNOWLEDGE_FILE)
    return from_turtle(store.read(join(root, CONFIG_FILE)), store.read(knowledge) if store.exists(knowledge) else None)


def shape_problems(g: Graph) -> list[str]:
    """What the document itself gets wrong, before it is read as a federation."""
    short = lambda iri: ":" + iri[len(PIPELINE) :] if iri.startswith(PIPELINE) else iri
    out = []
    for root in g.subjects_of_type(PIPELINE + "Federation"):
        for term in g.terms(root, PIPELINE + "hasSource"):
            if term.kind != "iri":
                out.append(f"{CONFIG_FILE}: {short(root)} needs at least one :hasSource that is an IRI")
                continue
            formats = g.terms(term.value, PIPELINE + "format")
            if len(formats) > 1 or any(f.kind != "iri" for f in formats):
                out.append(f"{CONFIG_FILE}: {short(term.value)} needs exactly one :format IRI")
    for s in dict.fromkeys(s.value for s, p, _ in g.triples if p == PIPELINE + "iriSource"):
        flags = g.terms(s, PIPELINE + "iriSource")
        if len(flags) != 1 or flags[0].kind != "literal" or flags[0].datatype != XSD + "boolean" or flags[0].value not in ("true", "false", "1", "0"):
            out.append(f"{CONFIG_FILE}: {short(s)} :iriSource must be a single boolean")
    return out


def problems(fed: Federation) -> list[str]:
    """What keeps a federation from running; empty when valid."""
    short = lambda iri: ":" + iri[len(PIPELINE) :] if iri.startswith(PIPELINE) else iri
    out = []
    if not fed.sources:
        out.append(f"{CONFIG_FILE}: needs at least one :hasSource")
    for s in fed.sources:
        if s.format is None:
            out.append(f"{CONFIG_FILE}: {short(s.iri)} needs exactly one :format IRI")
        elif format_family(s.format).lower() not in ("json", "xml", "html", "xlsx"):
            out.append(f"{CONFIG_FILE}: {short(s.iri)} has unsupported format {format_family(s.format)}")
        if sum(f.iri_source for f in s.fields) > 1:
            out.append(f"{CONFIG_FILE}: {short(s.iri)} has more than one :iriSource field")
    for m in fed.mappings:
        if fed.source(m.source) is None:
            out.append(f"{CONFIG_FILE}: {short(m.iri)} maps from undeclared source {short(m.source)}")
        if m.target is not None and fed.schema(m.target) is None:
            out.append(f"{CONFIG_FILE}: {short(m.iri)} maps to undeclared schema {short(m.target)}")
    if not fed.rules:
        out.append(f"{CONFIG_FILE}: :MatchRule config missing")
    for r in fed.rules:
        if r.algorithm not in ALGORITHMS:
            out.append(f'{CONFIG_FILE}: {short(r.iri)} has unknown :matchAlgorithm "{r.algorithm}" - use {", ".join(ALGORITHMS)}')
        if fed.schema(r.schema) is None:
            out.append(f"{CONFIG_FILE}: {short(r.iri)} matches undeclared schema {short(r.schema)}")
    for name in [fed.resolve.default, *fed.resolve.overrides.values()]:
        if name not in STRATEGIES:
            out.append(f"{CONFIG_FILE}: unknown resolve strategy {name} - use {', '.join(STRATEGIES)}")
    return out


def validate(root: str, cleaners: set[str] = frozenset(), fetchers: set[str] = frozenset(), store: Store | None = None) -> list[str]:
    """Problems of an instance folder: configuration present and sound, folders in step with it both ways.

    ``cleaners`` and ``fetchers`` name the sources that bring callables of their own.
    """
    store = store or LocalStore()
    if not store.exists(join(root, CONFIG_FILE)):
        return [f"{CONFIG_FILE} missing"]
    try:
        out = shape_problems(Graph(parse(store.read(join(root, CONFIG_FILE)))))
        fed = load(root, store)
    except ValueError as e:
        return [f"{CONFIG_FILE}: {e}"]
    out += [p for p in problems(fed) if p not in out]
    folders = store.folders(join(root, "sources"))
    for s in fed.sources:
        if s.name not in fetchers and not store.exists(join(root, "sources", s.name, "static")):
            out.append(f"sources/{s.name} has no fetcher and no static/ to default to")
        if s.name not in cleaners and s.key is None:
            out.append(f"sources/{s.name} has no clean function and no :iriSource field to derive the default clean from")
    declared = {s.name for s in fed.sources}
    return out + [f"sources/{name}/ has no :hasSource declaration in {CONFIG_FILE}" for name in folders if name not in declared]


# A small instance to start from; it runs as it is.
STARTER = f"""@prefix : <{PIPELINE}> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix schema: <http://schema.org/> .

:federation a :Federation ; rdfs:label "Directory" ; :hasSource :townSource , :clubSource .

:place a :TargetSchema ; :targetClass schema:Place ; rdfs:label "Place" ; :hasTargetField :placeId , :placeName , :placeCity .
:placeId a :TargetField ; :targetPredicate schema:identifier ; :multiValued true .
:placeName a :TargetField ; :targetPredicate schema:name .
:placeCity a :TargetField ; :targetPredicate schema:addressLocality .

:townSource a :Source ; rdfs:label "Town" ; :format <http://example.org/file-type/JSON> ; :hasField :townNo , :townTitle , :townCity .
:townNo a :SourceField ; :fieldPath "no" ; :iriSource true .
:townTitle a :SourceField ; :fieldPath "title" .
:townCity a :SourceField ; :fieldPath "city" .
:clubSource a :Source ; rdfs:label "Club" ; :format <http://example.org/file-type/JSON> ; :hasField :clubKey , :clubName , :clubCity .
:clubKey a :SourceField ; :fieldPath "key" ; :iriSource true .
:clubName a :SourceField ; :fieldPath "name" .
:clubCity a :SourceField ; :fieldPath "city" .

:townMapping a :Mapping ; :fromSource :townSource ; :toTarget :place ;
    :hasFieldMapping [ :from :townNo ; :to :placeId ] , [ :from :townTitle ; :to :placeName ] , [ :from :townCity ; :to :placeCity ] .
:clubMapping a :Mapping ; :fromSource :clubSource ; :toTarget :place ;
    :hasFieldMapping [ :from :clubKey ; :to :placeId ] , [ :from :clubName ; :to :placeName ] , [ :from :clubCity ; :to :placeCity ] .

:placeMatch a :MatchRule ; :forTarget :place ; :targetNamespace "https://example.org/directory#" ; :mintedSubjectPrefix "place-" ; :minScore 0.8 ;
    :hasHardCriterion [ :on schema:addressLocality ] ; :hasWeightedCriterion [ :on schema:name ; :weight 1.0 ] .
"""
STARTER_ROWS = {
    "town": '[{"no": 1, "title": "Harbour Pool", "city": "Kiel"}, {"no": 2, "title": "Old Mill", "city": "Kiel"}]',
    "club": '[{"key": "p", "name": "Pool Harbour", "city": "Kiel"}, {"key": "q", "name": "Chess Room", "city": "Husum"}]',
}


def scaffold(target: str, store: Store | None = None) -> None:
    """Start a new instance folder with two small sources; refuses to overwrite one."""
    store = store or LocalStore()
    if store.exists(join(target, CONFIG_FILE)):
        raise FileExistsError(f"{target} already holds {CONFIG_FILE}")
    store.write(join(target, CONFIG_FILE), STARTER)
    for name, rows in STARTER_ROWS.items():
        store.write(join(target, "sources", name, "static", "places.json"), rows + "\n")
