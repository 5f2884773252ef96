"""The federation engine: ingest (fetch, lift) and federate (clean, map, match, merge, resolve)."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo import config
from confluo.config import Federation, Source
from confluo.functions.terms import RDF_TYPE
from confluo.operators import identity
from confluo.operators.clean import Clean, default_clean
from confluo.operators.mapping import Transform, map_sources
from confluo.operators.exports import Exporter, Exporters
from confluo.operators.matching import grouped, match_rule, pair_counts, pair_frame, rule_clusters, statistics
from confluo.operators.merge import merged, provenance
from confluo.operators.resolve import resolve
from confluo.plans import publish
from confluo.plans.shared import materialize
from confluo.plans.storage import HadoopStore, join
from confluo.sources.readers import reader_for

#: fetch(spark, source, origin, params as JSON) -> DataFrame of lifted records
Fetch = Callable[[SparkSession, Source, str, str], DataFrame]
JOURNAL = "step string, type string, source string, after array<string>, started timestamp, ended timestamp, file_time timestamp"
#: Tables of a result that a run publishes beside registry, history and journal.
TABLES = ("mapped", "clusters", "pairs", "merged", "provenance", "final")


@dataclass
class Result:
    """Every intermediate and final table of one run."""

    federation: Federation
    cleaned: dict[str, DataFrame]
    mapped: DataFrame
    clusters: DataFrame
    pairs: DataFrame
    merged: DataFrame
    provenance: DataFrame
    final: DataFrame
    registry: DataFrame
    history: DataFrame
    notices: DataFrame
    stats: DataFrame
    decisions: dict[str, DataFrame]
    journal: list[tuple] = field(default_factory=list)


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Journal:
    """Steps that ran, in order, with what each was preceded by."""

    def __init__(self):
        self.rows: list[tuple] = []

    def step(self, kind: str, source: str | None, after: list[str], run: Callable, file_time: datetime | None = None):
        began = _now()
        out = run()
        self.add(kind, source, after, began, file_time)
        return out

    def add(self, kind: str, source: str | None, after: list[str], began: datetime, file_time: datetime | None = None) -> None:
        self.rows.append((kind if source is None else f"{kind}-{source}", kind, source, after, began, _now(), file_time))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, JOURNAL)


def federate(
    spark: SparkSession,
    fed: Federation,
    lifted: dict[str, DataFrame],
    cleaners: dict[str, Clean] | None = None,
    transforms: dict[tuple[str, str], Transform] | None = None,
    links: dict[str, DataFrame] | None = None,
    registry: DataFrame | None = None,
    history: DataFrame | None = None,
    same_as: DataFrame | None = None,
    different_from: DataFrame | None = None,
    at: str | None = None,
    journal: Journal | None = None,
) -> Result:
    """From lifted records by source name to the resolved directory; pure in its tables, writes only intermediates.

    ``same_as`` and ``different_from`` (two columns each) replace the curated pairs of the
    configuration, which suits lists too long for a document.
    """
    faults = config.problems(fed)
    if faults:
        raise ValueError("\n".join(faults))
    cleaners, journal = cleaners or {}, journal or Journal()
    cleaned = {}
    for s in fed.enabled:
        if s.name in lifted:
            run = lambda s=s: cleaners[s.name](lifted[s.name]) if s.name in cleaners else default_clean(lifted[s.name], s)
            cleaned[s.name] = journal.step("clean", s.name, [f"lift-{s.name}"], run)
    mapped = journal.step("map", None, [f"clean-{n}" for n in cleaned], lambda: materialize(map_sources(cleaned, fed, transforms, links), "mapped"))

    registry = identity.empty_registry(spark) if registry is None else registry
    history = identity.empty_history(spark) if history is None else history
    before = registry
    all_clusters, all_pairs, all_events, notices, stats, decisions = [], [], [], [], [], {}
    taken: DataFrame | None = None
    began = _now()
    known = pair_frame(spark, fed.same_as) if same_as is None else same_as
    different = pair_frame(spark, fed.different_from) if different_from is None else different_from
    for rule in fed.rules:
        rows, evidence, _ = match_rule(mapped, fed, rule, known, different)
        rows = materialize(rows, "subjects")
        # clusters and figures follow without listing the pairs, which are computed when they are asked for
        clusters = materialize(rule_clusters(rows, fed, rule, evidence, same_as, different_from), "clusters")
        done = identity.assign(grouped(clusters), registry, rule.namespace, rule.prefix, taken)
        registry = materialize(identity.update_registry(registry, done.decisions), "registry")
        now = done.clusters.select("entity_iri").distinct()
        taken = now if taken is None else taken.union(now)
        name = F.lit(rule.iri).alias("rule")
        all_clusters.append(done.clusters.select(name, "entity_iri", "member"))
        all_pairs.append(evidence.join(done.clusters.withColumnRenamed("member", "a"), "a").select(name, F.lit(rule.algorithm).alias("algorithm"), "entity_iri", "a", "b", "manual", "aggregate", "scores"))
        # a record known before the run under any rule is no newcomer
        all_events.append(identity.events(done.decisions))
        notices.append(done.notices)
        stats.append(statistics(rows, rule, clusters, pair_counts(rows, fed, rule, known, different)))
        decisions[rule.iri] = done.decisions
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    clusters = materialize(union(all_clusters), "clusters")
    journal.add("match", None, ["map"], began)
    if fed.harvesting:
        stamp = at or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        new = materialize(union(all_events), "events")
        history = history if new.isEmpty() else materialize(identity.append_history(history, new, stamp), "history")
    else:
        registry = before
    prov = journal.step("merge", None, ["match"], lambda: materialize(provenance(mapped, clusters), "provenance"))
    whole = materialize(merged(prov), "merged")
    final = journal.step("resolve", None, ["merge"], lambda: materialize(resolve(whole, fed.resolve), "final"))
    return Result(fed, cleaned, mapped, clusters, union(all_pairs), whole, prov, final, registry, history, union(notices), union(stats), decisions, journal.rows)


class Pipeline:
    """An instance folder: config/, sources/<name>/static/, and state below ``state``, on any file system of the session.

    ``fetchers``, ``cleaners``, ``transforms``, ``links`` and ``exporters`` are the instance's own callables.
    State: numbered Parquet snapshots of every published table, and below ``turtle/<number>`` the graphs and journals.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        fetchers: dict[str, Fetch] | None = None,
        cleaners: dict[str, Clean] | None = None,
        transforms: dict[tuple[str, str], Transform] | None = None,
        links: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
        exporters: dict[str, Exporter] | None = None,
        state: str | None = None,
    ):
        self.spark, self.root = spark, root
        self.fetchers, self.cleaners = fetchers or {}, cleaners or {}
        self.transforms, self.links = transforms or {}, links or {}
        self.exporters = Exporters()
        for name, exporter in (exporters or {}).items():
            self.exporters.add(name, exporter)
        self.state = state or join(root, "artifacts")
        self.store = HadoopStore(spark)

    def validate(self) -> list[str]:
        return config.validate(self.root, set(self.cleaners), set(self.fetchers), self.store)

    def _checked(self) -> Federation:
        faults = self.validate()
        if faults:
            raise ValueError("\n".join(faults))
        return config.load(self.root, self.store)

    def ingest(self, journal: Journal | None = None) -> dict[str, DataFrame]:
        """Lifted records of every enabled source, by name; nothing is copied, readers scan where the files lie."""
        fed, journal = self._checked(), journal or Journal()
        params = json.dumps(fed.run_params)
        lifted = {}
        for s in fed.enabled:
            static = join(self.root, "sources", s.name, "static")
            if s.name in self.fetchers:
                lifted[s.name] = journal.step("fetch", s.name, [], lambda s=s, o=s.fetch_url or static: self.fetchers[s.name](self.spark, s, o, params))
            elif s.fetch_url:
                raise ValueError(f"fetch: {s.name} is a live source and has no fetcher")
            else:
                journal.step("fetch", s.name, [], lambda: None, self.store.modified(static))
                lifted[s.name] = journal.step("lift", s.name, [f"fetch-{s.name}"], lambda s=s, p=static: reader_for(s.format)(self.spark, p, s.lift_params))
        return lifted

    def lift(self) -> None:
        """Ingest alone: lifted records as Parquet and the ingest journal, for a ``federate`` later on."""
        journal = Journal()
        for name, df in self.ingest(journal).items():
            df.write.mode("overwrite").parquet(join(self.state, "lifted", name))
        self._commit("journal", journal.frame(self.spark))
        self.store.write(join(self.state, "turtle", "ingest-log.ttl"), publish.journal_turtle(self._checked(), journal.rows, INGEST))

    def _snapshots(self, name: str) -> list[str]:
        folder = join(self.state, name)
        return [d for d in self.store.folders(folder) if self.store.exists(join(folder, d, "_SUCCESS"))]

    def load_state(self, name: str, schema: str | None = None) -> DataFrame:
        """The newest complete snapshot of a state or published table."""
        found = self._snapshots(name)
        if not found:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(join(self.state, name, found[-1]))

    def _commit(self, name: str, df: DataFrame) -> None:
        """A new snapshot beside the old ones; readers take the newest that is complete."""
        found = self._snapshots(name)
        df.write.mode("overwrite").parquet(join(self.state, name, f"{int(found[-1]) + 1 if found else 1:08d}"))

    def federate(self, lifted: dict[str, DataFrame] | None = None, at: str | None = None, journal: Journal | None = None) -> Result:
        """Clean to resolve over ``lifted`` (default: what ``lift`` wrote), without writing anything but intermediates."""
        fed, journal = self._checked(), journal or Journal()
        if lifted is None:
            lifted = {s.name: self.spark.read.parquet(join(self.state, "lifted", s.name)) for s in fed.enabled}
        registry, history = self.load_state("registry", identity.REGISTRY), self.load_state("history", identity.HISTORY)
        links = {n: make(lifted[n]) for n, make in self.links.items() if n in lifted}
        return federate(self.spark, fed, lifted, self.cleaners, self.transforms, links, registry, history, at=at, journal=journal)

    def publish(self, result: Result, graphs: bool = True) -> Result:
        """Commit registry and history when harvesting is on and they changed, the journal and all tables always;
        with ``graphs`` the Turtle of all of them as well. Returns the result over the published tables."""
        journal = self.spark.createDataFrame(result.journal, JOURNAL)
        if result.federation.harvesting:
            if not identity.same_registry(self.load_state("registry", identity.REGISTRY), result.registry):
                self._commit("registry", result.registry)
            if result.history.count() != self.load_state("history", identity.HISTORY).count():
                self._commit("history", result.history)
        self._commit("journal", journal)
        for name in TABLES:
            self._commit(name, getattr(result, name))
        result = replace(result, **{name: self.load_state(name) for name in TABLES})
        if graphs:
            folder = join(self.state, "turtle", self._snapshots("final")[-1])
            publish.write_graphs(result, folder)
            for name, kinds in (("ingest-log.ttl", INGEST), ("federate-log.ttl", FEDERATE)):
                if any(row[1] in kinds for row in result.journal):
                    self.store.write(join(folder, name), publish.journal_turtle(result.federation, result.journal, kinds))
        return result

    def run(self, at: str | None = None, graphs: bool = False) -> Result:
        """Ingest, federate and publish."""
        journal = Journal()
        return self.publish(self.federate(self.ingest(journal), at, journal), graphs)

    def export(self, name: str, final: DataFrame | None = None) -> DataFrame | bytes:
        """The final facts (default: the newest published) through one of the instance's exporters."""
        return self.exporters.run(name, self.load_state("final") if final is None else final)


INGEST, FEDERATE = ("fetch", "lift"), ("clean", "map", "match", "merge", "resolve")


def register_views(result: Result) -> None:
    """Temporary views for ad-hoc SQL: triples, entities, clusters, provenance, mapped, pairs, registry, history."""
    result.final.withColumnsRenamed({"entity_iri": "s", "predicate": "p", "value": "o"}).createOrReplaceTempView("triples")
    result.merged.where(F.col("predicate") == RDF_TYPE).select("entity_iri", F.col("value").alias("type")).createOrReplaceTempView("entities")
    for name in ("clusters", "provenance", "mapped", "pairs", "registry", "history", "merged", "final"):
        getattr(result, name).createOrReplaceTempView(name)


__all__ = ["Journal", "Pipeline", "Result", "federate", "register_views"]
