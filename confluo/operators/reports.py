"""Reports over the tables of a run: overview, conflicts, statistics, hierarchy, search, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confluo.config import Federation
from confluo.functions.terms import FROM_SOURCE, IDENTIFIER, RDF_TYPE, SCHEMA, collated, format_family, local_name_of
from confluo.plans.shared import materialize

NAME = SCHEMA + "name"


def source_table(spark: SparkSession, fed: Federation) -> DataFrame:
    """Sources in declaration order with label, format family, number of fields and of mapped fields."""
    used = {m.source: set() for m in fed.mappings}
    for m in fed.mappings:
        for f in m.fields:
            used[m.source].update(f.sources)
    rows = [(s.iri, s.name, s.label, format_family(s.format or ""), len({f.iri for f in s.fields}), len(used.get(s.iri, set())), s.order, s.enabled) for s in fed.sources]
    return spark.createDataFrame(rows, "source string, name string, label string, format string, fields int, mapped_fields int, ord int, enabled boolean")


def source_overview(sources: DataFrame, mapped: DataFrame, journal: DataFrame | None = None) -> DataFrame:
    """Sources with their number of records (0 when none) and last harvest."""
    counts = mapped.groupBy(F.col("source").alias("_s")).agg(F.count_distinct("record").alias("n"))
    out = sources.join(counts, F.col("source") == F.col("_s"), "left").withColumn("records", F.coalesce("n", F.lit(0)).cast("long")).drop("_s", "n")
    if journal is None:
        return out
    last = harvests(journal).select(F.col("source").alias("_s"), "last_harvest")
    return out.join(last, F.col("name") == F.col("_s"), "left").drop("_s")


def harvests(journal: DataFrame) -> DataFrame:
    """Latest fetch or lift per source."""
    return journal.where("type in ('fetch', 'lift')").groupBy("source").agg(F.max("ended").alias("last_harvest"))


def contributors(provenance: DataFrame) -> DataFrame:
    """Per statement its contributing records and distinct sources."""
    return provenance.groupBy("entity_iri", "predicate", "value").agg(F.array_sort(F.collect_set("record")).alias("records"), F.array_sort(F.collect_set("source")).alias("sources"))


def assembled(merged: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row an entity: label, type and fields, each with its values, those of most sources first."""
    of = contributors(provenance)
    values = merged.join(of, ["entity_iri", "predicate", "value"], "left")
    value = F.struct((-F.size(F.coalesce("sources", F.array().cast("array<string>")))).alias("rank"), "value", "sources", "records")
    fields = values.groupBy("entity_iri", "predicate").agg(F.array_sort(F.collect_list(value)).alias("values"))
    field = F.struct("predicate", F.transform("values", lambda v: F.struct(v["value"].alias("value"), v["sources"].alias("sources"), v["records"].alias("records"))).alias("values"))
    return fields.groupBy("entity_iri").agg(
        F.min(F.when(F.col("predicate") == NAME, F.col("values")[0]["value"])).alias("label"),
        F.min(F.when(F.col("predicate") == RDF_TYPE, F.col("values")[0]["value"])).alias("type"),
        F.array_sort(F.collect_list(field)).alias("fields"),
    )


def record_columns(provenance: DataFrame, order: DataFrame) -> DataFrame:
    """Contributing records of each entity, numbered by source order then record; unknown sources last."""
    rows = provenance.select("entity_iri", "record", "source").distinct().join(order.select("source", "ord"), "source", "left")
    place = Window.partitionBy("entity_iri").orderBy(F.col("ord").asc_nulls_last(), "source", "record")
    return rows.withColumn("place", F.row_number().over(place)).select("entity_iri", "record", "source", "place")


def conflicts(merged: DataFrame, multi_valued: list[str]) -> DataFrame:
    """``(entity_iri, predicate, n_values)`` where one value is expected and several are there."""
    rows = merged.where(~F.col("predicate").isin([*multi_valued, FROM_SOURCE]))
    return rows.groupBy("entity_iri", "predicate").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def conflict_ranking(merged: DataFrame, multi_valued: list[str]) -> DataFrame:
    """Entities by number of conflicts, most first, then IRI."""
    counts = conflicts(merged, multi_valued).groupBy("entity_iri").agg(F.count(F.lit(1)).alias("n"))
    every = merged.select("entity_iri").distinct().join(counts, "entity_iri", "left").select("entity_iri", F.coalesce("n", F.lit(0)).alias("conflicts"))
    return every.orderBy(F.col("conflicts").desc(), "entity_iri")


def merge_statistics(merged: DataFrame, provenance: DataFrame, multi_valued: list[str]) -> DataFrame:
    """Per type and in total (null type): entities, deduplicated, with conflicts, records, sources."""
    types = merged.where(F.col("predicate") == RDF_TYPE).groupBy("entity_iri").agg(F.min("value").alias("type"))
    records = provenance.groupBy("entity_iri").agg(F.count_distinct("record").alias("n"), F.collect_set("source").alias("from"))
    bad = conflicts(merged, multi_valued).select("entity_iri").distinct().withColumn("bad", F.lit(1))
    one = types.join(records, "entity_iri", "left").join(bad, "entity_iri", "left")
    figures = one.rollup("type").agg(
        F.count(F.lit(1)).alias("entities"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("deduplicated"), F.sum(F.coalesce("bad", F.lit(0))).alias("with_conflicts"), F.sum("n").alias("records")
    )
    sources = one.select("type", F.explode("from").alias("s")).rollup("type").agg(F.count_distinct("s").alias("sources"))
    return figures.join(sources.withColumnRenamed("type", "_t"), F.col("type").eqNullSafe(F.col("_t")), "left").drop("_t")


def of_types(merged: DataFrame, types: list[str]) -> DataFrame:
    """Statements of entities of the selected types."""
    chosen = merged.where((F.col("predicate") == RDF_TYPE) & F.col("value").isin(types)).select("entity_iri").distinct()
    return merged.join(chosen, "entity_iri", "left_semi")


def hierarchy(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``(node, parent, depth, path)`` of a forest: the smallest visible parent counts, orphans are roots.

    Levels are joined one after the other; a node reached once is not reached again, and
    nodes on a cycle start from the cycle's smallest node.
    """
    nodes = nodes.select(F.col("node").cast("string").alias("node")).distinct()
    edges = parents.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent")).join(nodes, "node", "left_semi").join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi")
    tree = materialize(nodes.join(edges.groupBy("node").agg(F.min("parent").alias("parent")), "node", "left"), "tree")
    level = tree.where("parent is null").select("node", "parent", F.lit(0).alias("depth"), F.array("node").alias("path"))
    done = level = materialize(level, "level")
    while True:
        while not level.isEmpty():
            below = tree.join(level.select(F.col("node").alias("parent"), F.col("depth").alias("_d"), F.col("path").alias("_p")), "parent").where(~F.array_contains("_p", F.col("node")))
            level = materialize(below.select("node", "parent", (F.col("_d") + 1).alias("depth"), F.concat("_p", F.array("node")).alias("path")).join(done, "node", "left_anti"), "level")
            done = materialize(done.unionByName(level), "tree")
        left = tree.join(done, "node", "left_anti")
        start = left.agg(F.min("node").alias("node")).first().node
        if start is None:
            return done
        level = materialize(left.where(F.col("node") == start).select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("node").alias("path")), "level")
        done = materialize(done.unionByName(level), "tree")


def wide_records(provenance: DataFrame, columns: DataFrame, entity: str) -> DataFrame:
    """One entity as a table: a row per field, a column per contributing record."""
    rows = provenance.where(F.col("entity_iri") == entity)
    order = [r.record for r in columns.where(F.col("entity_iri") == entity).orderBy("place").collect()]  # records of one entity
    return rows.groupBy("predicate").pivot("record", order).agg(F.array_join(F.array_sort(F.collect_set("value")), "; "))


def entities_by_source(mapped: DataFrame) -> DataFrame:
    """Records of each source with identifier (else local name) and name."""
    first = lambda p: F.min(F.when(F.col("predicate") == p, F.col("value")))
    one = mapped.groupBy("source", "record").agg(first(IDENTIFIER).alias("_id"), first(NAME).alias("name"))
    return one.select("source", "record", F.coalesce("_id", local_name_of(F.col("record"))).alias("id"), "name")


def field_values(cleaned: DataFrame, columns: list[str]) -> DataFrame:
    """``(record, field, value)``: smallest literal per record and source field."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    long = cleaned.select("record", F.explode(pairs).alias("f")).where("f.value is not null")
    return long.groupBy("record", "f.field").agg(F.min("f.value").alias("value"))


def search(entities: DataFrame, text: str, limit: int = 200) -> DataFrame:
    """Entities whose id or name contains the text, whatever the case; the first ``limit`` by id."""
    wanted = F.lower(F.lit(text))
    hit = F.lower("id").contains(wanted) | F.lower(F.coalesce("name", F.lit(""))).contains(wanted)
    return entities.where(hit).orderBy("id", "record").limit(limit)


def mapping_graph(spark: SparkSession, fed: Federation) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, kind, label)`` and edges ``(start, end, via)`` from sources over fields to target fields by schema."""
    nodes, edges = {}, {}
    for s in fed.sources:
        nodes[s.iri] = ("source", s.label or s.name)
        for f in s.fields:
            nodes[f.iri] = ("field", f.column)
            edges[s.iri, f.iri, None] = 1
    for m in fed.mappings:
        for fm in m.fields:
            for a in fm.sources:
                for b in fm.targets:
                    target = fed.field(b)
                    node = f"{b}@{m.target or ''}"
                    nodes[node] = ("target", target.predicate if target else b)
                    if fm.via:
                        via = f"{m.source}#{fm.via}"
                        nodes[via] = ("via", fm.via)
                        edges[a, via, fm.via] = edges[via, node, fm.via] = 1
                    else:
                        edges[a, node, None] = 1
    return (
        spark.createDataFrame([(k, *v) for k, v in nodes.items()], "id string, kind string, label string"),
        spark.createDataFrame(list(edges), "start string, end string, via string"),
    )


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(node, hops)`` of all that ``edges (start, end)`` reach from ``starts (node)``; breadth first, each node once."""
    seen = frontier = materialize(starts.select("node").distinct().withColumn("hops", F.lit(0)), "reach")
    while True:
        step = frontier.join(edges, F.col("node") == F.col("start")).select(F.col("end").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti"), "reach")
        if frontier.isEmpty():
            return seen
        seen = materialize(seen.unionByName(frontier), "reach")


def field_coverage(spark: SparkSession, fed: Federation) -> DataFrame:
    """Source fields and whether a mapping uses them; a parent counts as mapped when a part of it is."""
    used = {s for m in fed.mappings for f in m.fields for s in f.sources}
    parents = {(s.iri, f.parent) for s in fed.sources for f in s.fields if f.parent and f.iri in used}
    rows = [(s.iri, f.iri, f.column, f.iri in used or (f.parent is None and (s.iri, f.path) in parents)) for s in fed.sources for f in s.fields]
    return spark.createDataFrame(rows, "source string, field string, path string, mapped boolean")


def barycenters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, place)``: nodes ordered by the mean index of the nodes that lead to them."""
    mean = edges.join(nodes.select(F.col("id").alias("start"), "index"), "start").groupBy("end").agg(F.avg("index").alias("mean"))
    ordered = nodes.join(mean, F.col("id") == F.col("end"), "left").withColumn("mean", F.coalesce("mean", F.col("index").cast("double")))
    return ordered.select("id", "mean", F.row_number().over(Window.orderBy("mean", "id")).alias("place"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, level)``: longest path that leads to each node of the relation graph, not entering a node twice."""
    best = paths = materialize(nodes.select("node", F.lit(0).alias("level"), F.array("node").alias("path")), "levels")
    while True:
        step = paths.join(edges, F.col("node") == F.col("start")).where(~F.array_contains("path", F.col("end")))
        paths = materialize(step.select(F.col("end").alias("node"), (F.col("level") + 1).alias("level"), F.concat("path", F.array("end")).alias("path")), "levels")
        if paths.isEmpty():
            return best.groupBy("node").agg(F.max("level").alias("level"))
        best = best.unionByName(paths)


def match_lanes(clusters: DataFrame, merged: DataFrame, only_merged: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cluster nodes with a label, and member edges; ``only_merged`` hides clusters of one."""
    first = lambda p: F.min(F.when(F.col("predicate") == p, F.col("value")))
    label = merged.groupBy("entity_iri").agg(first(NAME).alias("_n"), first(SCHEMA + "category").alias("_c"), first(RDF_TYPE).alias("lane"))
    sizes = clusters.groupBy("entity_iri").agg(F.count("member").alias("members"))
    sizes = sizes.where("members > 1") if only_merged else sizes
    nodes = sizes.join(label, "entity_iri", "left").select("entity_iri", "members", "lane", F.coalesce("_n", "_c", local_name_of(F.col("entity_iri"))).alias("label"))
    return nodes, clusters.join(sizes.select("entity_iri"), "entity_iri", "left_semi").select("entity_iri", "member")


def lane_relations(merged: DataFrame, clusters: DataFrame) -> DataFrame:
    """Statements that link one entity to another."""
    known = clusters.select("entity_iri").distinct()
    return merged.where((F.col("kind") == "iri") & (F.col("predicate") != RDF_TYPE)).join(known, "entity_iri", "left_semi").join(known.withColumnRenamed("entity_iri", "value"), "value", "left_semi").select("entity_iri", "predicate", F.col("value").alias("to")).distinct()


def cluster_detail(clusters: DataFrame, mapped: DataFrame, predicates: list[str], same_as: DataFrame, different: DataFrame, entity: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members with their criteria values; curated pairs with both ends inside; distinct pairs with either end inside."""
    members = clusters.where(F.col("entity_iri") == entity).select("member")
    rows = mapped.where(F.col("predicate").isin(predicates)).join(members, F.col("record") == F.col("member"), "left_semi")
    values = rows.groupBy("record", "predicate").agg(F.min("value").alias("value"))
    x, y = members.withColumnRenamed("member", "x"), members.withColumnRenamed("member", "y")
    inside = same_as.join(x, "x", "left_semi").join(y, "y", "left_semi")
    either = different.join(x, "x", "left_semi").union(different.join(y, "y", "left_semi")).distinct()
    return values, inside, either


def step_graph(journal: DataFrame) -> DataFrame:
    """Edges ``(start, end, type, source)`` of the steps that ran."""
    steps = journal.select("step")
    edges = journal.select(F.explode_outer("after").alias("start"), F.col("step").alias("end"), "type", "source")
    return edges.join(steps.withColumnRenamed("step", "start"), "start", "left_semi").unionByName(edges.where("start is null"))


def by_subject(facts: DataFrame, literals_only: bool = False, subject: str = "entity_iri") -> DataFrame:
    """``(subject, predicate, values)``; with ``literals_only`` without IRIs and blank nodes."""
    rows = facts.where(F.col("kind") == "literal") if literals_only else facts
    return rows.groupBy(subject, "predicate").agg(F.array_sort(F.collect_set("value")).alias("values"))


def types_of(facts: DataFrame, subject: str = "entity_iri") -> DataFrame:
    return facts.where(F.col("predicate") == RDF_TYPE).select(subject, F.col("value").alias("type")).distinct()


def schema_options(spark: SparkSession, fed: Federation) -> DataFrame:
    """Types to choose from, with labels, in order of label."""
    rows = [(s.target_class, s.label or s.iri) for s in fed.schemas]
    return spark.createDataFrame(rows, "type string, label string").orderBy(collated(F.col("label")), "type")
