"""The corpus pipeline: quality rules, near-duplicate join, benchmark decontamination, source mixing, sharding.

Each stage takes what its predecessor kept, reread from Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspan.llm import decontamination, jaccard, mixing, quality, sharding
from lumaspan.llm.common import documents, shielded, stored
from lumaspan.tables import table

#: Word shingles and similarity of the near-duplicate stage, and the share of shingles that its order counts.
SHINGLE, PERCENT, REGION = 5, 80, 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule and whose host is not rejected."""
    return quality.reject(docs)


def row_name(key: Column, text: Column) -> Column:
    """A number for each different (key, text), in the order of keys, null last: the key and 62 bits of the text's hash. A plain number is
    summed up by hash; a struct would be sorted."""
    wide = lambda c: c.cast("decimal(38,0)")
    return wide(wide(F.coalesce(key.cast("decimal(20,0)"), F.lit(Decimal(1 << 64)))) * F.lit(1 << 62).cast("decimal(19,0)")) + wide(F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the least doc_id, then text hash. Rows that repeat a doc_id with other texts
    are documents of their own; of rows that repeat both, one stays. Documents without words stay, all of them."""
    docs, named = shielded(docs, "doc_id", "text")
    row = row_name(F.col("doc_id"), F.col("text"))
    found = stored(jaccard.join(docs.select(row.alias("_row"), "text"), key="_row", shingle=SHINGLE, percent=PERCENT, region=REGION))
    gone = stored(found.where((F.col("n_shingles") > 0) & (F.col("component_id") != F.col("_row"))).select(F.col("_row").alias("_gone")).distinct())
    repeated = stored(found.where("n_shingles > 0").groupBy("_row").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_row").alias("_again")))
    few = lambda df: F.broadcast(df) if df.count() <= jaccard.ID_ROWS else df
    left = docs.withColumn("_row", row).join(few(gone), F.col("_row") == F.col("_gone"), "left_anti")
    on = F.col("_row") == F.col("_again")
    once = left.join(few(repeated), on, "left_semi").dropDuplicates(["_row"])
    return named(left.join(few(repeated), on, "left_anti").unionByName(once).select(*docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, a row per copy."""
    docs, named = shielded(docs, "doc_id", "text", "source")
    return named(mixing.mixed(docs).select(*docs.columns))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.assign(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_stage),
]

#: Mixing draws by hashes that SQL does not have; tests/llm/test_pipeline.py compares the stages with plain-Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
