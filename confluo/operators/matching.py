"""Match: blocking, weighted similarity, curated pairs and clusters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confluo.config import Federation, MatchRule
from confluo.functions.similarity import normal_form, processed, similarity, upper_bound
from confluo.functions.terms import FROM_SOURCE, RDF_TYPE, collated
from confluo.operators.components import connected_components
from confluo.plans.shared import materialize
from confluo.plans.skew import keyed_join, numbered

#: Rows of a block that are compared with as many others in one piece; Spark's merge join holds as many in memory.
TILE = 4096
#: Rows of a side for one task, on average: so few values that a Parquet dictionary (1 MB) holds those of several pieces.
TASK = 2048
SCORE = "struct<on:string,similarity:double,weight:double,value_a:string,value_b:string>"


def subjects(mapped: DataFrame, target_class: str, predicates: list[str]) -> DataFrame:
    """``(record, source, v0, v1, ...)``: records of the class with one value a predicate, null when absent.

    Several values of one predicate give the smallest, so results do not depend on row order.
    """
    typed = (F.col("predicate") == RDF_TYPE) & (F.col("value") == target_class) & (F.col("kind") == "iri")
    wanted = [RDF_TYPE, FROM_SOURCE, *predicates]
    values = [F.min(F.when(F.col("predicate") == p, F.col("value"))).alias(f"v{k}") for k, p in enumerate(predicates)]
    one = mapped.where(F.col("predicate").isin(wanted)).groupBy("record").agg(
        F.max(typed).alias("_typed"), F.min(F.when(F.col("predicate") == FROM_SOURCE, F.col("value"))).alias("source"), *values
    )
    return one.where("_typed").drop("_typed")


def _own(untrusted: list[str] | None) -> Column:
    """0, or the number of the row's source among those whose own identifiers tell entities apart."""
    if not untrusted:
        return F.lit(0)
    return F.coalesce(F.array_position(F.array(*[F.lit(u) for u in untrusted]), F.col("source")), F.lit(0)).cast("int")


def block_pairs(rows: DataFrame, hard: list[str], untrusted: list[str] | None = None, counted: bool = False) -> DataFrame:
    """Unordered pairs ``a.*, b.*`` (a.record < b.record) with equal, present hard values.

    Pairs within a source of ``untrusted`` (sources whose own identifiers already
    tell entities apart) are left out, and never compared. Blocks are cut into pieces of TILE rows in the order of
    their records (those of an untrusted source apart); each two pieces that can hold a pair are an
    equi-join key of their own, so a block that holds many records is dealt to many tasks. Where the pairs are sure to be
    listed, ``counted`` writes the pieces to the shared folder first and takes as many tasks as their sizes need.
    """
    own = ["_own"] if untrusted else []  # a constant would drop out of the join's keys, and the parts below would not be its parts
    line = Window.partitionBy(*hard, *own).orderBy("record")
    placed = rows.dropna(subset=[*hard, "record"])
    placed = placed.withColumn("_own", _own(untrusted)) if own else placed
    placed = placed.withColumn("_piece", F.floor((F.row_number().over(line) - 1) / TILE).cast("int"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counted:
        placed = materialize(placed, "pieces")
    place = [*own, "_piece"]
    pieces = placed.groupBy(*hard, *place).agg(F.min("record").alias("least"), F.max("record").alias("greatest"), F.count(F.lit(1)).alias("n"))
    ends = [pieces.select(*hard, *[F.col(p).alias(f"{p}_{x}") for p in place], F.col(bound).alias(f"_{bound}"), F.col("n").alias(f"_n_{x}")) for x, bound in (("a", "least"), ("b", "greatest"))]
    joined = ends[0].join(ends[1], hard) if hard else ends[0].crossJoin(ends[1])
    tiles = joined.where(F.col("_least") < F.col("_greatest")).drop("_least", "_greatest")
    tiles = tiles.where((F.col("_own_a") == 0) | (F.col("_own_a") != F.col("_own_b"))) if own else tiles
    if counted:
        n = tiles.agg(F.sum(F.greatest("_n_a", "_n_b"))).first()[0] or 0
        parts = max(parts, math.ceil(n / TASK))
    tiles = tiles.drop("_n_a", "_n_b")
    key = [f"{p}_{x}" for x in "ab" for p in place]

    def side(x: str) -> DataFrame:
        mine = placed.withColumnsRenamed({p: f"{p}_{x}" for p in place}).join(tiles, [*hard, *[f"{p}_{x}" for p in place]])
        mine = mine.select(*[F.col(h).alias(f"_{h}") for h in hard], *key, *[F.col(c).alias(f"{x}_{c}") for c in rows.columns])
        # few bytes make many pairs: a number of parts of our own, or Spark joins small parts into one task
        return mine.repartition(parts, *[f"_{h}" for h in hard], *key)

    pairs = side("a").join(side("b"), [*[f"_{h}" for h in hard], *key]).where("a_record < b_record")
    return pairs.select(*[f"{x}_{c}" for x in "ab" for c in rows.columns])


def _strict(rule: MatchRule, offset: int) -> tuple[str, int] | None:
    """A column whose texts must all but equal each other, and how many characters in 200 may differ: with ``s`` percent needed,
    insertions and deletions are at most (201 - 2s) / 200 of both lengths. None where no criterion asks for 98 percent."""
    if rule.algorithm not in ("ratio", "token_sort_ratio"):
        return None
    positive = rule.min_score is not None and all(c.weight >= 0 for c in rule.weighted)
    for k, c in enumerate(rule.weighted, offset):
        need = c.min_similarity or 0.0
        if positive and c.weight > 0:
            others = sum(o.weight for o in rule.weighted) - c.weight
            need = max(need, (rule.min_score - others) / c.weight)
        percent = min(math.ceil(need * 100 - 1e-6), 100)
        if percent >= 98:
            return f"v{k}", 201 - 2 * percent
    return None


def scored_values(rows: DataFrame, rule: MatchRule, offset: int) -> DataFrame:
    """Pairs of value tuples that clear the rule: blocking values, ``x_v*``, ``y_v*``, ``s*`` and ``aggregate``.

    Works on the distinct tuples of each block, so records that agree in
    their values cost nothing extra; each distinct pair of strings is scored once, after the bounds that need no Python.
    """
    hard = [f"v{k}" for k in range(offset)]
    criteria = list(enumerate(rule.weighted, offset))
    names = [f"v{k}" for k, _ in criteria]
    tuples = rows.dropna(subset=[*hard, *names]).select(*hard, *names).distinct()
    # processed lengths once a tuple, not once a pair
    tuples = tuples.select("*", *[F.length(processed(F.col(n))).alias(f"n_{n}") for n in names])
    strict = _strict(rule, offset)
    if strict:
        tuples = tuples.withColumn("_key", normal_form(rule.algorithm)(F.col(strict[0])))
    left = tuples.select(*[F.col(c).alias(c if c in hard else f"x_{c}") for c in tuples.columns])
    right = tuples.select(*[F.col(c).alias(f"h_{c}" if c in hard else f"y_{c}") for c in tuples.columns])
    condition = F.struct(*[f"x_{n}" for n in names]) <= F.struct(*[f"y_{n}" for n in names])
    for h in hard:
        condition &= F.col(h) == F.col(f"h_{h}")
    bound = {k: upper_bound(rule.algorithm, F.col(f"x_n_v{k}"), F.col(f"y_n_v{k}")) / 100.0 for k, _ in criteria}
    for k, c in criteria:
        if c.min_similarity is not None:
            condition &= bound[k] >= c.min_similarity
    if rule.min_score is not None and all(c.weight >= 0 for c in rule.weighted):
        # a little slack, so that rounding of the sum never decides
        condition &= reduce(lambda x, kc: x + bound[kc[0]] * kc[1].weight, criteria, F.lit(0.0)) >= rule.min_score - 1e-9
    if strict:
        # below 200 / slack characters in both together only equal texts score enough; pairs of longer ones are listed
        name, slack = strict
        x, y = F.col(f"x_n_{name}"), F.col(f"y_n_{name}")
        least = 100 / slack * (200 - slack) / (200 + slack) - 1
        found = left.join(right, condition & (F.col("x__key") == F.col("y__key")))
        far = left.where(x >= least).join(right.where(y >= least), condition & (F.col("x__key") != F.col("y__key")) & ((x + y) * slack >= 200))
        pairs = found.unionByName(far)
    else:
        pairs = left.join(right, condition)
    pairs = pairs.select(*hard, *[f"{side}_{n}" for side in "xy" for n in names])
    score = similarity(rule.algorithm)
    for k, c in criteria:
        low, high = F.least(f"x_v{k}", f"y_v{k}").alias("_x"), F.greatest(f"x_v{k}", f"y_v{k}").alias("_y")
        keyed = pairs.select("*", low, high)
        scores = keyed.select("_x", "_y").distinct().withColumn(f"s{k}", score(F.col("_x"), F.col("_y")) / F.lit(100.0))
        if c.min_similarity is not None:
            scores = scores.where(F.col(f"s{k}") >= c.min_similarity)
        pairs = keyed.join(scores, ["_x", "_y"]).drop("_x", "_y")
    aggregate = reduce(lambda x, kc: x + F.col(f"s{kc[0]}") * F.lit(kc[1].weight), criteria, F.lit(0.0))
    pairs = pairs.withColumn("aggregate", aggregate)
    return pairs.where(F.col("aggregate") >= rule.min_score) if rule.min_score is not None else pairs


def weighted_pairs(rows: DataFrame, rule: MatchRule, offset: int, untrusted: list[str] | None = None) -> DataFrame:
    """Matching record pairs ``a, b, aggregate, scores`` of a rule with weighted criteria."""
    hard = [f"v{k}" for k in range(offset)]
    criteria = list(enumerate(rule.weighted, offset))
    names = [f"v{k}" for k, _ in criteria]
    good = scored_values(rows, rule, offset)
    figures = [*[f"s{k}" for k, _ in criteria], "aggregate"]
    swapped = good.where(F.struct(*[f"x_{n}" for n in names]) != F.struct(*[f"y_{n}" for n in names])).select(
        *hard, *[F.col(f"y_{n}").alias(f"x_{n}") for n in names], *[F.col(f"x_{n}").alias(f"y_{n}") for n in names], *figures
    )
    good = good.select(*hard, *[f"x_{n}" for n in names], *[f"y_{n}" for n in names], *figures).unionByName(swapped)
    a = rows.select(F.col("record").alias("a"), F.col("source").alias("a_source"), *hard, *[F.col(n).alias(f"x_{n}") for n in names])
    b = rows.select(F.col("record").alias("b"), F.col("source").alias("b_source"), *[F.col(h).alias(f"h_{h}") for h in hard], *[F.col(n).alias(f"b_{n}") for n in names])
    condition = F.col("a") < F.col("b")
    for left, right in [*((h, f"h_{h}") for h in hard), *((f"y_{n}", f"b_{n}") for n in names)]:
        condition &= F.col(left) == F.col(right)
    if untrusted:
        condition &= ~(F.col("a_source").eqNullSafe(F.col("b_source")) & F.coalesce(F.col("a_source").isin(untrusted), F.lit(False)))
    pairs = good.join(a, [*hard, *[f"x_{n}" for n in names]]).join(b, condition)
    scores = F.array(
        *[F.struct(F.lit(c.predicate).alias("on"), F.col(f"s{k}").alias("similarity"), F.lit(c.weight).alias("weight"), F.col(f"x_v{k}").alias("value_a"), F.col(f"y_v{k}").alias("value_b")) for k, c in criteria]
    ).cast(f"array<{SCORE}>")
    return pairs.select("a", "b", "aggregate", scores.alias("scores"))


def pair_frame(spark: SparkSession, pairs: tuple[tuple[str, str], ...] | DataFrame) -> DataFrame:
    if isinstance(pairs, DataFrame):
        return pairs.toDF("x", "y")
    return spark.createDataFrame(list(pairs), "x string, y string")


def manual_pairs(records: DataFrame, same_as: DataFrame) -> DataFrame:
    """Curated pairs with both ends among the rule's records; neither score nor veto applies to them."""
    ends = same_as.join(records.select(F.col("record").alias("x")), "x", "left_semi").join(records.select(F.col("record").alias("y")), "y", "left_semi")
    return ends.select(F.col("x").alias("a"), F.col("y").alias("b"))


def split_vetoed(pairs: DataFrame, different: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, vetoed): an edge between two records declared different, in either order, is suppressed."""
    both = different.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.join(both, ["a", "b"], "left_anti"), pairs.join(both, ["a", "b"], "left_semi")


def match_rule(mapped: DataFrame, fed: Federation, rule: MatchRule, same_as: DataFrame | None = None, different: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records with their values, evidence ``a, b, manual, aggregate, scores``, vetoed pairs) of one rule."""
    spark = mapped.sparkSession
    predicates = [*rule.hard, *[c.predicate for c in rule.weighted]]
    rows = subjects(mapped, fed.schema(rule.schema).target_class, predicates)
    same_as = pair_frame(spark, fed.same_as) if same_as is None else same_as
    different = pair_frame(spark, fed.different_from) if different is None else different
    manual = manual_pairs(rows, same_as).select("a", "b", F.lit(True).alias("manual"), F.lit(None).cast("double").alias("aggregate"), F.lit(None).cast(f"array<{SCORE}>").alias("scores"))
    if not predicates:
        return rows, manual, manual.limit(0).select("a", "b")
    untrusted = [s.iri for s in fed.sources if not s.dedup_within]
    if rule.weighted:
        pairs = weighted_pairs(rows, rule, len(rule.hard), untrusted)
    else:
        blocks = block_pairs(rows, [f"v{k}" for k in range(len(rule.hard))], untrusted)
        pairs = blocks.select(F.col("a_record").alias("a"), F.col("b_record").alias("b"), F.lit(0.0).alias("aggregate"), F.array().cast(f"array<{SCORE}>").alias("scores"))
    pairs = pairs.select("a", "b", F.lit(False).alias("manual"), "aggregate", "scores")
    kept, vetoed = split_vetoed(pairs, different)
    return rows, manual.unionByName(kept), vetoed.select("a", "b")


def _blocks(rows: DataFrame, hard: list[str], untrusted: list[str], different: DataFrame | None) -> DataFrame:
    """Blocks of several records with their smallest one, those apart that lie in one source which tells its entities
    apart itself; ``vetoed`` where two records or more are named by a veto."""
    there = rows.dropna(subset=hard)
    vetoed = F.lit(False)
    if different is not None:
        vetoes = different.select(F.col("x").alias("record")).union(different.select("y")).distinct().withColumn("_veto", F.lit(True))
        there, vetoed = there.join(vetoes, "record", "left"), F.count("_veto") > 1
    own = F.coalesce(F.col("source").isin(untrusted), F.lit(False)) if untrusted else F.lit(False)
    lone = F.min(own) & (F.count_distinct("source") == 1) if untrusted else F.lit(False)
    return there.groupBy(*hard).agg(F.min("record").alias("least"), F.count(F.lit(1)).alias("n"), vetoed.alias("vetoed"), lone.alias("lone")).where("n > 1 and not lone").drop("lone")


def block_edges(rows: DataFrame, hard: list[str], untrusted: list[str], different: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` with the components of all pairs of each block, without listing the pairs.

    Every record of a block is joined to the block's smallest one. That holds unless all records come from
    one source that tells its entities apart itself (no pair at all), or a veto lies inside the block: only there
    pairs are listed.
    """
    blocks = materialize(_blocks(rows, hard, untrusted, different), "blocks")
    stars = keyed_join(rows, blocks.where("not vetoed").drop("n", "vetoed"), blocks.where("not vetoed").select(*hard, "n"), hard)
    stars = stars.where("record <> least").select(F.col("least").alias("a"), F.col("record").alias("b"))
    if blocks.where("vetoed").isEmpty():
        return stars
    listed = block_pairs(rows.join(blocks.where("vetoed").select(*hard), hard, "left_semi"), hard, untrusted)
    pairs = listed.select(F.col("a_record").alias("a"), F.col("b_record").alias("b"))
    return stars.unionByName(split_vetoed(pairs, different)[0])


def value_groups(rows: DataFrame, rule: MatchRule, untrusted: list[str], different: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with the key of their group, groups ``v*, _own, _named, least, n``): records with equal values, those of
    an untrusted source and each one that a veto names (``_named``) apart."""
    values = [f"v{k}" for k in range(len(rule.hard) + len(rule.weighted))]
    named = different.select(F.col("x").alias("record")).union(different.select("y")).distinct().withColumn("_named", F.col("record"))
    placed = rows.dropna(subset=values).join(named, "record", "left").withColumn("_named", F.coalesce("_named", F.lit("")))
    placed = placed.withColumn("_own", _own(untrusted)).select("record", *values, "_own", "_named")
    return placed, placed.groupBy(*values, "_own", "_named").agg(F.min("record").alias("least"), F.count(F.lit(1)).alias("n"))


def group_links(groups: DataFrame, good: DataFrame, rule: MatchRule) -> DataFrame:
    """Groups that hold matching pairs: ``a, b`` (their smallest records), ``pairs`` (how many), each two groups once; ``a = b`` within a group."""
    hard = [f"v{k}" for k in range(len(rule.hard))]
    names = [f"v{k}" for k in range(len(rule.hard), len(rule.hard) + len(rule.weighted))]
    ends = [groups.select(*hard, *[F.col(n).alias(f"{s}_{n}") for n in names], *[F.col(c).alias(f"{s}_{c}") for c in ("_own", "least", "n")]) for s in "xy"]
    pairs = good.select(*hard, *[f"{s}_{n}" for s in "xy" for n in names])
    pairs = pairs.join(ends[0], [*hard, *[f"x_{n}" for n in names]]).join(ends[1], [*hard, *[f"y_{n}" for n in names]])
    equal = F.struct(*[f"x_{n}" for n in names]) == F.struct(*[f"y_{n}" for n in names])
    apart = (F.col("x__own") == 0) | (F.col("x__own") != F.col("y__own"))
    pairs = pairs.where(apart & (~equal | (F.col("x_least") <= F.col("y_least"))))
    n = F.when(F.col("x_least") == F.col("y_least"), F.expr("x_n * (x_n - 1) div 2")).otherwise(F.col("x_n") * F.col("y_n"))
    return pairs.select(F.least("x_least", "y_least").alias("a"), F.greatest("x_least", "y_least").alias("b"), n.alias("pairs")).where("pairs > 0")


def value_clusters(rows: DataFrame, fed: Federation, rule: MatchRule, same_as: DataFrame | None = None, different: DataFrame | None = None, good: DataFrame | None = None) -> DataFrame:
    """``(root, member)`` of a rule with weighted criteria without listing pairs of records.

    All records of a group in a link are one node, its smallest record; all others are nodes of their own.
    Vetoes lie between groups of one record, so they cut links between groups."""
    spark = rows.sparkSession
    same_as = pair_frame(spark, fed.same_as) if same_as is None else same_as
    different = pair_frame(spark, fed.different_from) if different is None else different
    if good is None:
        good = materialize(scored_values(rows, rule, len(rule.hard)), "values")
    placed, groups = value_groups(rows, rule, [s.iri for s in fed.sources if not s.dedup_within], different)
    groups = materialize(groups, "groups")
    links = materialize(split_vetoed(group_links(groups, good, rule), different)[0], "links")
    linked = links.select(F.col("a").alias("least")).union(links.select("b")).distinct()
    joint = materialize(groups.join(linked, "least", "left_semi"), "joint")
    key = [c for c in groups.columns if c not in ("least", "n")]
    within = materialize(keyed_join(placed, joint.drop("n"), joint.drop("least"), key).select("record", "least"), "within")
    manual = manual_pairs(rows, same_as)
    for end in "ab":
        node = within.select(F.col("record").alias(end), F.col("least").alias("_node"))
        manual = manual.join(node, end, "left").withColumn(end, F.coalesce("_node", end)).drop("_node")
    found = connected_components(links.select("a", "b").union(manual.select("a", "b")), "a", "b")
    root = found.select(F.col("node").alias("least"), "component")
    sizes = within.groupBy("least").agg(F.count(F.lit(1)).alias("n"))
    roots = joint.select("least").join(root, "least", "left").select("least", F.coalesce("component", "least").alias("root"))
    together = keyed_join(within, roots, sizes, ["least"]).select("root", F.col("record").alias("member"))
    alone = rows.select(F.col("record").alias("member")).join(within.select(F.col("record").alias("member")), "member", "left_anti")
    alone = alone.join(found, F.col("member") == F.col("node"), "left").select(F.coalesce("component", "member").alias("root"), "member")
    return together.unionByName(alone)


def pair_counts(rows: DataFrame, fed: Federation, rule: MatchRule, same_as: DataFrame | None = None, different: DataFrame | None = None, good: DataFrame | None = None) -> DataFrame:
    """One row ``same_as_unions, matched_pairs, kept_distinct``: how many rows the evidence and the vetoed pairs of ``match_rule``
    have, from the sizes of groups of equal values; pairs are listed between records that vetoes name alone."""
    spark = rows.sparkSession
    same_as = pair_frame(spark, fed.same_as) if same_as is None else same_as
    different = pair_frame(spark, fed.different_from) if different is None else different
    unions = manual_pairs(rows, same_as).agg(F.count(F.lit(1)).alias("same_as_unions"))
    if not (rule.weighted or rule.hard):
        return unions.select("same_as_unions", F.lit(0).cast("long").alias("matched_pairs"), F.lit(0).cast("long").alias("kept_distinct"))
    groups = materialize(value_groups(rows, rule, [s.iri for s in fed.sources if not s.dedup_within], different)[1], "groups")
    if not rule.weighted:
        links = _block_links(groups, [f"v{k}" for k in range(len(rule.hard))])
    else:
        links = group_links(groups, materialize(scored_values(rows, rule, len(rule.hard)), "values") if good is None else good, rule)
    links = materialize(links, "links")
    kept, vetoed = (x.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias(n)) for x, n in zip(split_vetoed(links, different), ("matched_pairs", "kept_distinct"), strict=True))
    return unions.crossJoin(kept).crossJoin(vetoed)


def _block_links(groups: DataFrame, hard: list[str]) -> DataFrame:
    """``a, b, pairs`` of a rule of hard criteria alone, as ``group_links``."""
    x, y = (groups.select(*hard, *[F.col(c).alias(f"{s}_{c}") for c in ("_own", "least", "n")]) for s in "xy")
    pairs = x.join(y, hard).where("(x__own = 0 or x__own <> y__own) and x_least <= y_least")
    n = F.when(F.col("x_least") == F.col("y_least"), F.expr("x_n * (x_n - 1) div 2")).otherwise(F.col("x_n") * F.col("y_n"))
    return pairs.select(F.col("x_least").alias("a"), F.col("y_least").alias("b"), n.alias("pairs")).where("pairs > 0")


def rule_clusters(rows: DataFrame, fed: Federation, rule: MatchRule, evidence: DataFrame, same_as: DataFrame | None = None, different: DataFrame | None = None, good: DataFrame | None = None) -> DataFrame:
    """``(root, member)`` of a rule, so that the evidence need not be computed: groups of equal values are the nodes of a
    rule with weighted criteria (``good``: its ``scored_values``); with hard criteria alone the blocks are the clusters where
    nothing is curated, and few edges make them otherwise."""
    if rule.weighted:
        return value_clusters(rows, fed, rule, same_as, different, good)
    if not rule.hard:
        return clusters_of(rows, evidence)
    curated = any(x is not None for x in (same_as, different)) or fed.same_as or fed.different_from
    if curated:
        return clusters_of(rows, link_edges(rows, fed, rule, evidence, same_as, different))
    hard = [f"v{k}" for k in range(len(rule.hard))]
    blocks = materialize(_blocks(rows, hard, [s.iri for s in fed.sources if not s.dedup_within], None), "blocks")
    found = keyed_join(rows, blocks.select(*hard, "least"), blocks.select(*hard, "n"), hard).select(F.col("record").alias("member"), F.col("least").alias("root"))
    alone = rows.select(F.col("record").alias("member")).join(found, "member", "left_anti")
    return found.select("root", "member").unionByName(alone.select(F.col("member").alias("root"), "member"))


def link_edges(rows: DataFrame, fed: Federation, rule: MatchRule, evidence: DataFrame, same_as: DataFrame | None = None, different: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b)`` whose components are the rule's clusters: the evidence, or for a rule of hard criteria alone
    far fewer, so that the evidence need not be computed."""
    if rule.weighted or not rule.hard:
        return evidence.select("a", "b")
    spark = rows.sparkSession
    same_as = pair_frame(spark, fed.same_as) if same_as is None else same_as
    different = pair_frame(spark, fed.different_from) if different is None else different
    untrusted = [s.iri for s in fed.sources if not s.dedup_within]
    return block_edges(rows, [f"v{k}" for k in range(len(rule.hard))], untrusted, different).unionByName(manual_pairs(rows, same_as))


def clusters_of(records: DataFrame, edges: DataFrame) -> DataFrame:
    """``(root, member)``: components of the edges; records without edges are clusters of their own."""
    found = connected_components(edges, "a", "b")
    joined = records.select("record").distinct().join(found, F.col("record") == F.col("node"), "left")
    return joined.select(F.coalesce("component", "record").alias("root"), F.col("record").alias("member"))


def grouped(clusters: DataFrame) -> DataFrame:
    """``(root, members, size)``, members in code point order."""
    members = clusters.groupBy("root").agg(F.array_sort(F.collect_list("member")).alias("members"))
    return members.withColumn("size", F.size("members"))


def cluster_order() -> list[Column]:
    """Largest first, then smallest member in locale order."""
    return [F.col("size").desc(), collated(F.col("members")[0]), F.col("members")[0]]


def ranked(clusters: DataFrame) -> DataFrame:
    """``(root, members, size, rank)``: clusters numbered in ``cluster_order``."""
    return numbered(grouped(clusters), cluster_order(), "rank").withColumn("rank", F.col("rank").cast("int"))


def statistics(rows: DataFrame, rule: MatchRule, clusters: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of run figures, each from one aggregate; ``counts`` as of ``pair_counts``."""
    keys: list[Column] = [F.col(f"v{k}") for k in range(len(rule.hard))]
    buckets = rows.dropna(subset=[f"v{k}" for k in range(len(rule.hard))]).select(F.count_distinct(F.struct(*keys)).alias("buckets")) if keys else rows.select(F.lit(1).alias("buckets")).limit(1)
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") > 1).alias("multi_member"))
    parts = [
        rows.agg(F.count(F.lit(1)).alias("entities")),
        buckets,
        sizes,
        counts,
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts).withColumn("rule", F.lit(rule.iri))
