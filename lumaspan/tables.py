"""Reading the parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a dataset folder; any file system Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
