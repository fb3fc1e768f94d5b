"""Cutting lineage by a written table in the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a folder of our own on a local master; on a cluster, whose
    executors would not see it, an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/lumaspan-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Writes a frame and reads it again: cuts lineage, survives lost executors. Unlike a checkpointed frame, the result brings
    no constraints of its history, which grow with every turn of a loop until the optimizer no longer ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lumaspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
