"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspan.operators.storage import scratch_dir, stored  # noqa: F401
from lumaspan.tables import table

#: Words are runs of characters outside the space and the controls 9 to 13.
GAPS = "[\\x20\\x09-\\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: Rows that may be broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a side for broadcast if it has few rows (counted, unless the count is given); else it is left to a shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def shielded(df: DataFrame, *own: str):
    """The frame with all columns but ``own`` under neutral names, and what gives such a frame its names back: columns of the
    input cannot clash with an operator's. Columns that an operator adds behind them keep their names."""
    names = df.columns
    inner = [c if c in own else f"_in{i}" for i, c in enumerate(names)]
    return df.toDF(*inner), lambda out: out.toDF(*names, *out.columns[len(names):])


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(whole(text), GAPS, -1), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
