"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaspan.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its neighbours (larger ones only if ``large``, else the others and itself) to its least neighbour."""
    a = edges.select(F.col("_a").alias("_u"), F.col("_b").alias("_v"))
    both = a.unionAll(edges.select(F.col("_b").alias("_u"), F.col("_a").alias("_v"))) if large else a
    least = both.groupBy("_u").agg(F.min("_v").alias("_m"))
    if large:
        least = least.select("_u", F.least("_u", "_m").alias("_m"))
        found = both.where(F.col("_v") > F.col("_u")).join(least, "_u").select(F.col("_v").alias("_a"), F.col("_m").alias("_b"))
    else:
        found = both.join(least, "_u").select(F.col("_v").alias("_a"), F.col("_m").alias("_b")).unionAll(
            least.select(F.col("_u").alias("_a"), F.col("_m").alias("_b")))
    return found.where(F.col("_a") != F.col("_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: _a, _b (comparable, not null). Returns _node, _root (the least node of its component) for nodes with links."""
    edges = stored(edges.where(F.col("_a") != F.col("_b")).select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct())
    before = None
    while True:
        edges = stored(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("_a", "_b"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_root")).unionAll(
        edges.select(F.col("_b").alias("_node"), F.col("_b").alias("_root")).distinct())
