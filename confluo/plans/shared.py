"""Shared storage for intermediate results.

Everything that must outlive a lost executor is written below the folder that
the cluster names in ``spark.checkpoint.dir``. Only where that setting is
absent and the master is local (tests, notebooks) a folder of our own is chosen and set.
What a session wrote can be dropped with ``clear``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_DIR = "/tmp/checkpoints/confluo"


def shared_dir(spark: SparkSession) -> str:
    """The fully qualified shared folder (scheme included)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", OWN_DIR)
        path = OWN_DIR
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop.getFileSystem(conf).makeQualified(hadoop).toString()


_made: dict[str, list[str]] = {}


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder (not yet created)."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the intermediates of this session and say how many; results that still read them must be written before."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(conf).delete(hadoop, True)
    return len(paths)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: later stages depend on replicated files instead of
    shuffle output that vanishes with its executor.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
