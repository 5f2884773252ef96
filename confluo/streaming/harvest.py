"""Periodic harvesting as a stream: every micro-batch of source files is one harvest.

State lies below a folder of its own: the rows that each harvest brought per source, one row a key; a snapshot
of registry and history after each harvest; and a marker per batch, written last, that says which harvest
it became. After a restart the newest marked snapshot is the state. A batch that has a marker is not taken in again; one that
failed before its marker is taken in anew, over what it left. The sink is called before the marker, so it may see a batch twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from confluo.config import Federation
from confluo.operators import identity
from confluo.plans import engine
from confluo.plans.storage import HadoopStore, join


class Harvester:
    """Keeps the rows of all harvests per source and federates the newest row of each key, batch by batch.

    ``newest`` orders rows of one key within a batch (default: by their content, so that reruns agree).
    """

    def __init__(self, spark: SparkSession, fed: Federation, state: str, sink: Callable[[engine.Result, int], None] | None = None, newest: Column | None = None, **plugins):
        self.spark, self.fed, self.state, self.sink, self.newest, self.plugins = spark, fed, state, sink, newest, plugins
        self.store = HadoopStore(spark)

    def _done(self) -> dict[str, int]:
        """Marked batches and the harvest that each became."""
        folder = join(self.state, "done")
        return {name: int(self.store.read(join(folder, name, "harvest"))) for name in self.store.folders(folder)}

    def _table(self, name: str, harvest: int, schema: str) -> DataFrame:
        if not harvest:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(join(self.state, name, f"{harvest:08d}"))

    @property
    def harvest(self) -> int:
        return max(self._done().values(), default=0)

    @property
    def registry(self) -> DataFrame:
        return self._table("registry", self.harvest, identity.REGISTRY)

    @property
    def history(self) -> DataFrame:
        return self._table("history", self.harvest, identity.HISTORY)

    def _records(self, source: str, upto: int) -> DataFrame | None:
        """The newest row of each key over harvests up to this one."""
        name, key = self.fed.source(source).name, self.fed.source(source).key.column
        folder = join(self.state, "records", name)
        parts = [self.spark.read.parquet(join(folder, d)).withColumn("_harvest", F.lit(int(d))) for d in self.store.folders(folder) if int(d) <= upto]
        if not parts:
            return None
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part, allowMissingColumns=True)
        columns = [c for c in every.columns if c != "_harvest"]
        return every.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), "_harvest").alias("_row")).select("_row.*")

    def add(self, source: str, rows: DataFrame, batch: int) -> engine.Result | None:
        """Take in rows of one source: a row replaces earlier ones of its key. None for a batch already taken in."""
        done = self._done()
        own = self.fed.source(source)
        mark = f"{own.name}-{batch}"
        if mark in done:
            return None
        last = max(done.values(), default=0)
        now = last + 1
        content = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns])
        order = content if self.newest is None else F.struct(self.newest, content)
        fresh = rows.where(F.col(own.key.column).isNotNull()).groupBy(F.col(own.key.column).alias("_key")).agg(F.max_by(F.struct("*"), order).alias("_row")).select("_row.*")
        fresh.write.mode("overwrite").parquet(join(self.state, "records", own.name, f"{now:08d}"))
        lifted = {s.name: df for s in self.fed.enabled if (df := self._records(s.iri, now)) is not None}
        result = engine.federate(self.spark, self.fed, lifted, registry=self._table("registry", last, identity.REGISTRY), history=self._table("history", last, identity.HISTORY), **self.plugins)
        for name, table in (("registry", result.registry), ("history", result.history)):
            table.write.mode("overwrite").parquet(join(self.state, name, f"{now:08d}"))
        if self.sink:
            self.sink(result, batch)
        self.store.write(join(self.state, "done", mark, "harvest"), str(now))
        return result


def start(spark: SparkSession, harvester: Harvester, source: str, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Federate every micro-batch of ``stream`` (rows of ``source``); processes what is there and stops."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            harvester.add(source, rows, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
