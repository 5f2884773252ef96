"""Steps that must not end in one task: joins where a key may hold a large share of the rows, and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.plans.shared import materialize

#: A key is hot when it holds more than this part of the rows, so there are at most HOT hot keys.
HOT = 20_000


def keyed_join(rows: DataFrame, lookup: DataFrame, counts: DataFrame, keys: list[str], n: str = "n", total: int | None = None) -> DataFrame:
    """``rows`` joined (inner) on ``keys`` with ``lookup``, which has each key once.

    ``counts`` (keys, ``n``) says how many rows each key has, ``total`` how many there are. Keys with more than 1/HOT of all rows,
    of which there are at most HOT, meet their rows by broadcast and are never shuffled; all other keys are
    too small to burden the task that they are dealt to.
    """
    if total is None:
        total = counts.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(counts.where(F.col(n) > total / HOT).select(*keys))
    few = F.broadcast(lookup.join(hot, keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(hot, keys, "left_anti").join(lookup, keys))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number from 1 in ``order``, which should tell all of them apart.

    Rows are dealt by ranges of the order and numbered within each range; the offsets of the ranges come from a
    table with one row a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_offset") + within).cast("long")).drop("_range", "_offset")
