"""Identity: entities keep their minted IRI across harvests.

The registry ``(member, entity_iri, seq)`` remembers which entity a record belongs
to; the history ``(revision, at_time, event, entity_iri, members)`` is append-only.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confluo.functions.terms import collated
from confluo.operators.components import connected_components
from confluo.operators.matching import cluster_order
from confluo.plans.shared import materialize
from confluo.plans.skew import numbered

REGISTRY = "member string, entity_iri string, seq long"
HISTORY = "revision int, at_time timestamp, event string, entity_iri string, members array<string>"


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)


def empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HISTORY)


def hashed_id(text: Column) -> Column:
    """First twelve hex digits of SHA-1."""
    return F.substring(F.sha1(text), 1, 12)


@dataclass
class Assigned:
    """Outcome for one rule: ``clusters (entity_iri, member)``, per cluster decisions, and warnings."""

    clusters: DataFrame
    decisions: DataFrame
    notices: DataFrame


def _contested(prior: DataFrame) -> DataFrame:
    """``(root, claimed)`` where several clusters want the same IRIs: largest first takes its smallest free one.

    Only clusters that compete directly or through others are brought together,
    a handful in practice; each such set is decided in one place, in rank order.
    """
    linked = connected_components(prior.select(F.concat(F.lit("c:"), "root").alias("x"), F.concat(F.lit("i:"), "iri").alias("y")), "x", "y")
    # the order of clusters is only needed within each set
    line = Window.partitionBy("component").orderBy(*cluster_order())
    grouped = prior.join(linked, F.concat(F.lit("c:"), F.col("root")) == F.col("node")).select("component", "root", F.dense_rank().over(line).alias("rank"), "iri")

    def claim(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for (_, root), own in frame.groupby(["rank", "root"], sort=True):
            free = [i for i in sorted(own["iri"]) if i not in taken]
            if free:
                taken.add(free[0])
            out.append((root, free[0] if free else None))
        return pd.DataFrame(out, columns=["root", "claimed"])

    return grouped.groupBy("component").applyInPandas(claim, "root string, claimed string")


def assign(grouped: DataFrame, registry: DataFrame, namespace: str, prefix: str, taken: DataFrame | None = None) -> Assigned:
    """Give each cluster ``(root, members, size)`` an entity IRI: a prior one of its members, or a fresh one.

    ``taken`` (entity_iri) holds what earlier rules of this run have used.
    """
    spark = grouped.sparkSession
    if taken is None and registry.isEmpty():  # nothing is known: all are fresh
        none = F.lit(None).cast("string")
        base = materialize(grouped.select("root", "members", "size", none.alias("claimed"), F.col("members").alias("joined"), F.array().cast("array<string>").alias("prior")), "fresh")
        return _assigned(base, base, spark.createDataFrame([], "entity_iri string"), namespace, prefix)
    taken = spark.createDataFrame([], "entity_iri string") if taken is None else taken
    members = grouped.select("root", F.explode("members").alias("member"))
    known = members.join(registry.select("member", F.col("entity_iri").alias("iri")), "member", "left")
    prior = known.where("iri is not null").select("root", "iri").distinct()
    open_ = prior.join(taken.withColumnRenamed("entity_iri", "iri"), "iri", "left_anti")
    rivals = open_.groupBy("iri").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("iri")
    fought = open_.join(rivals, "iri", "left_semi").select("root").distinct()
    if fought.isEmpty():
        claims = open_.groupBy("root").agg(F.min("iri").alias("claimed"))
    else:
        arena = materialize(open_.join(fought, "root", "left_semi").join(grouped, "root"), "contest")
        # every cluster that shares an IRI with a contestant takes part
        peaceful = open_.join(fought, "root", "left_anti").groupBy("root").agg(F.min("iri").alias("claimed"))
        claims = peaceful.unionByName(_contested(arena).where("claimed is not null"))
    claims = materialize(claims, "claims")
    unseen = known.groupBy("root").agg(F.collect_list(F.when(F.col("iri").isNull(), F.col("member"))).alias("joined"))
    had = prior.groupBy("root").agg(F.array_sort(F.collect_set("iri")).alias("prior"))
    base = grouped.join(claims, "root", "left").join(unseen, "root", "left").join(had, "root", "left")

    fresh = materialize(base.where("claimed is null"), "mint")
    used = registry.select("entity_iri").union(taken).union(claims.select(F.col("claimed").alias("entity_iri"))).distinct()
    return _assigned(base, fresh, used, namespace, prefix)


def _assigned(base: DataFrame, fresh: DataFrame, used: DataFrame, namespace: str, prefix: str) -> Assigned:
    """Mint for ``fresh`` clusters, hashing again those whose IRI is ``used`` or taken by one before them."""
    fresh = fresh.select("root", "members", "size", hashed_id(F.col("members")[0]).alias("id"))
    done: DataFrame | None = None
    while True:
        named = fresh.withColumn("entity_iri", F.concat(F.lit(namespace + prefix), "id"))
        rivals = named.groupBy("entity_iri").agg(F.min_by("root", F.struct(-F.col("size"), collated(F.col("members")[0]), F.col("members")[0])).alias("_first"))
        judged = named.join(rivals, "entity_iri").join(used.withColumn("_used", F.lit(True)), "entity_iri", "left")
        judged = judged.withColumn("_good", (F.col("root") == F.col("_first")) & F.col("_used").isNull())
        good = judged.where("_good").select("root", "entity_iri")
        done = good if done is None else done.unionByName(good)
        again = judged.where("not _good").select("root", "members", "size", hashed_id(F.col("id")).alias("id"))
        if again.isEmpty():
            break
        fresh = materialize(again, "mint")
        used = used.union(good.select("entity_iri"))
    decided = base.join(done.withColumnRenamed("entity_iri", "_minted"), "root", "left").select(
        "root", "members", "size", F.coalesce("claimed", "_minted").alias("entity_iri"), F.col("claimed").isNotNull().alias("reused"), F.coalesce("prior", F.array().cast("array<string>")).alias("prior"), F.array_sort("joined").alias("joined")
    )
    decided = materialize(decided, "decided")
    clusters = decided.select("entity_iri", F.explode("members").alias("member"))
    merged = decided.where("reused and size(prior) > 1").select("entity_iri", F.lit("merged").alias("notice"), "prior")
    split = decided.where("not reused and size(prior) > 0").select("entity_iri", F.lit("split").alias("notice"), "prior")
    return Assigned(clusters, decided, merged.unionByName(split))


def update_registry(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every member points to its entity; members that vanished stay; known members keep their place.

    New members are numbered by their cluster's place and their own in it."""
    last = registry.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    now = decisions.select("entity_iri", "members", "size", F.posexplode("members").alias("place", "member"))
    joined = materialize(registry.withColumnRenamed("entity_iri", "_old").join(now, "member", "full_outer"), "joined")
    fresh = numbered(joined.where("seq is null"), [*cluster_order(), F.col("place")], "_n").crossJoin(F.broadcast(last))
    return joined.where("seq is not null").select("member", F.coalesce("entity_iri", "_old").alias("entity_iri"), "seq").unionByName(
        fresh.select("member", "entity_iri", (F.col("last") + F.col("_n")).alias("seq"))
    )


def events(decisions: DataFrame) -> DataFrame:
    """``Minted`` with all members of a cluster without prior IRI, ``MemberJoined`` with the members never known before."""
    minted = decisions.where("not reused and size(prior) = 0").select(F.lit("Minted").alias("event"), "entity_iri", "members")
    joined = decisions.where("reused and size(joined) > 0").select(F.lit("MemberJoined").alias("event"), "entity_iri", F.col("joined").alias("members"))
    return minted.unionByName(joined)


def append_history(history: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """History with one more revision, or unchanged when nothing happened."""
    revision = history.agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).cast("int").alias("revision"))
    return history.unionByName(new.crossJoin(F.broadcast(revision)).select("revision", F.to_timestamp(F.lit(at)).alias("at_time"), "event", "entity_iri", "members"))


def same_registry(a: DataFrame, b: DataFrame) -> bool:
    columns = ["member", "entity_iri", "seq"]
    return a.select(*columns).exceptAll(b.select(*columns)).isEmpty() and b.select(*columns).exceptAll(a.select(*columns)).isEmpty()

