"""Connected components by alternating star contraction.

Each round rewires every edge towards the smallest identifier it can see
(first over larger neighbours, then over smaller ones), so a component
collapses into a star around its smallest node in a logarithmic number of
rounds. Nodes with a large share of all edges meet theirs by broadcast. All state stays in DataFrames; every round is materialised in the
shared folder, so lost executors only cost the current round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.plans.shared import materialize
from confluo.plans.skew import keyed_join


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    joined = keyed_join(both.where("v > u"), least.drop("n"), least.select("u", "n"), ["u"], total=2 * n)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "down")
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    moved = keyed_join(down, least.drop("n"), least.select("u", "n"), ["u"], total=n).where("v <> m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def _open(edges: DataFrame) -> int:
    """0 if every node points to one smaller node that points nowhere, the component's smallest; else the number of edges."""
    n, starts = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return 0 if n == starts and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() else n


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node.

    Self-loops are kept as singletons, null ends are ignored, duplicate and
    reversed edges count once. Works for any orderable identifier type.
    """
    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = raw.where("u = v").select("u").distinct()
    current = materialize(
        raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while n := _open(current):
        current = materialize(_small_star(_large_star(current, n), n), "edges")
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.join(found, loops.u == found.node, "left_anti").select(
        F.col("u").alias("node"), F.col("u").alias("component")
    )
    return found.union(roots.union(alone).distinct())
