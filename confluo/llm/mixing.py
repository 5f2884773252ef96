"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Semantics
---------
* The budget (default: 100 % of all sizes) is shared among the sources by
  weight. A source stops at ``max_epochs`` times its own size; what it cannot
  take is shared again among the others by weight, until none is above.
* Water level: with the sources ordered by capacity / weight, the capped ones
  are a prefix of that order, so the final level follows from running sums
  over the per-source totals; no iteration is needed.
* A document is repeated ``floor(rate)`` whole times plus one fractional
  repetition of ``floor(fraction * size + u)`` units, where ``u`` in [0, 1) is
  a hash of seed and doc_id. The source's expected total is exactly its
  target, the error is that of rounding single units, and reruns agree. No
  shuffle of documents is needed: only per-source totals are.

Edge cases: null text has size 0; null sources form a source of their own,
last in order; sources of total size 0 get target 0; an empty table gives an
empty result; repeated rows each count; sources of equal capacity / weight stand in order of their names, which does
not change the level; a very long text is counted in place; extra columns of any name stay, except that names
of result columns are replaced. The table of sources is ordered in one task and broadcast: it is meant for
sources that number up to some 100,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.names import fresh, without

WORD = r"[^\x20\x09-\x0D]+"
RESULT = ["size", "source_size", "target", "whole", "extra", "taken"]


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from 32 bits of MD5 over seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def water_fill(sizes: DataFrame, max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight)``, one row per source.

    The table has one row per source, so its running sums in one task are
    bounded by the number of sources, not by the documents.
    """
    every = Window.partitionBy()
    line = Window.orderBy(F.col("capacity") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = line.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sizes.withColumn("capacity", F.col("source_size") * max_epochs)
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("spent", F.coalesce(F.sum("capacity").over(ranked), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(ranked), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / (F.col("weights") - F.col("gone")))
        .withColumn("place", F.row_number().over(line))
        .withColumn("open", F.col("capacity") > F.col("level") * F.col("weight"))
    )
    # the first source in order that is not capped fixes the level for all behind it
    final = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(every)
    return level.withColumn("final", final["level"]).select(
        "source",
        "source_size",
        F.coalesce(
            F.least(F.col("capacity").cast("double"), F.col("final") * F.col("weight")), F.col("capacity").cast("double")
        ).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    share: float = 1.0,
    seed: int = 7,
    weight_of: DataFrame | None = None,
) -> DataFrame:
    """Documents with ``size, source_size, target, whole, extra, taken``.

    ``weights`` repeat over the sources in code point order (null last);
    ``weight_of`` ``(source, weight)`` overrides them by name.
    """
    docs = without(docs, RESULT)
    own, speed = fresh([*docs.columns, *RESULT], "source_of", "rate")
    sized = docs.withColumn("size", word_count())
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    dealt = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    totals = totals.withColumn("weight", dealt.cast("long"))
    if weight_of is not None:
        given = weight_of.select(F.col("source").alias("_s"), F.col("weight").alias("_w"))
        totals = totals.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", F.coalesce("_w", "weight").alias("weight")
        )
    targets = water_fill(totals, max_epochs, share).select(F.col("source").alias(own), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col(own)))
        .drop(own)
        .withColumn(speed, rate)
        .withColumn("whole", F.floor(speed).cast("long"))
        .withColumn(
            "extra",
            F.floor((F.col(speed) - F.col("whole")) * F.col("size") + _uniform(seed, F.col("doc_id"))).cast("long"),
        )
        .withColumn("taken", F.least(F.col("whole") * F.col("size") + F.col("extra"), F.col("size") * max_epochs))
        .drop(speed)
    )
