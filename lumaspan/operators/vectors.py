"""Hashes of vectors, Hamming and cosine joins, candidate merging and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspan.operators import graph, metric
from lumaspan.operators.storage import stored


def median_sign_hash(vector: Column) -> Column:
    """64 bits, first value highest: is it above the median of the values but the first. A signed long."""
    v = F.transform(vector, lambda x: x.cast("double"))
    median = F.get(F.sort_array(F.slice(v, 2, 63)), F.lit(31))
    bits = lambda m: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: F.call_function("shiftleft", a, F.lit(1)).bitwiseOR((x > m).cast("long")))
    return F.get(F.transform(F.array(median), bits), F.lit(0))  # the values are sorted once, not for each of them


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hash_classes(df: DataFrame, key: str, hash_: str) -> DataFrame:
    """Rows of equal hash as one class: h, rep (the least key), members."""
    return df.groupBy(F.col(hash_).alias("h")).agg(F.min(key).alias("rep"), F.count("*").alias("members"))


def hamming_class_pairs(classes: DataFrame, radius: int, block: int | None = None, copied: bool = False) -> DataFrame:
    """Pairs (a, b, distance) of the classes' reps, a < b, within the radius; classes: h (distinct), rep, and members for ``copied``, which adds a
    flag mark: one of the two has several members.

    Up to 7 bits the hash is cut into radius + 1 bands, one of which two such hashes share (pigeonhole): an equi join. Wider radii have
    no selective bands: a range join over metric cells."""
    mark = [(F.col("members") > 1).alias("mark")] if copied else []
    base = classes.where("h is not null and rep is not null").select(F.col("rep").alias("id"), F.col("h").alias("x"), *mark)
    if radius > 7:
        return metric.range_pairs(base, metric.Bits, radius, block).withColumn("distance", F.col("distance").cast("int"))
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    parts = F.array(*(F.shiftrightunsigned("x", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)) for a, b in zip(edges[:-1], edges[1:], strict=True)))
    side = lambda n: base.select(F.col("id").alias(n), F.col("x").alias(f"h{n}"), *([F.col("mark").alias(f"m{n}")] if copied else []), F.posexplode(parts).alias("k", "v"))
    distance = hamming(F.col("ha"), F.col("hb"))
    either = [(F.col("ma") | F.col("mb")).alias("mark")] if copied else []
    return side("a").join(side("b"), ["k", "v"]).where((F.col("a") < F.col("b")) & (distance <= radius)).select("a", "b", distance.alias("distance"), *either).distinct()


def hamming_pairs(df: DataFrame, key: str, hash_: str, radius: int, block: int | None = None) -> DataFrame:
    """Pairs (a, b, distance), a < b, within the radius, copies in all pairs. Components need only the classes' pairs.

    Pairs are many more than rows, which the optimizer cannot know of a Python function: they are joined only where a class has copies, and by
    sorting, never by sending them to the driver as the side that looks small."""
    rows = stored(df.select(F.col(key).alias("id"), F.col(hash_).alias("h")).where("h is not null"))
    classes = stored(hash_classes(rows, "id", "h"))
    several = classes.where("members > 1").select("h", "rep")
    near = hamming_class_pairs(classes, radius, block, copied=True)
    if several.isEmpty():
        return near.select("a", "b", "distance")
    near = stored(near)
    copies = stored(rows.join(several, "h"))
    x, y = copies.select(F.col("rep").alias("a"), F.col("id").alias("ia")), copies.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    spread = near.where("mark").hint("merge").join(x, "a", "left").hint("merge").join(y, "b", "left").select("distance", F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b"))
    same = copies.select("h", F.col("id").alias("a")).join(copies.select("h", F.col("id").alias("b")), "h").where("a < b")
    return near.where("NOT mark").select("a", "b", "distance").unionByName(spread.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")).unionByName(
        same.select("a", "b", F.lit(0).alias("distance")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(df: DataFrame, key: str, vector: str, k: int, floor: float, block: int | None = None) -> DataFrame:
    """Directed neighbours (a, b, similarity): the k best other rows of each row by the cosine of their vectors, at the floor or above; ties by key.
    Vectors need not have unit length; those of length 0 have similarity 0 with all, null ones and those with a value that is missing or not
    finite take no part."""
    kept = df.where(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))).where(F.col(key).isNotNull())
    x = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.transform(vector, lambda x: x.cast("double"))
    rows = kept.select(F.col(key).alias("id"), x.alias("x"))
    return metric.nearest(rows, k, floor, block)


def cosine_pairs(directed: DataFrame, mutual: bool) -> DataFrame:
    """Undirected pairs with the larger similarity; with ``mutual`` both rows must name each other."""
    both = directed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"), F.count("*").alias("n"))
    return (both.where("n = 2") if mutual else both).drop("n")


def merge_candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """Pairs of several sources (63 at most) with the sorted, joined names of those that found them. A bit stands for each source, so that a
    pair takes a few bytes while it is merged."""
    names, out = sorted(sources), None
    for name, df in sources.items():
        part = df.select("a", "b", F.lit(1 << names.index(name)).cast("long").alias("bits"))
        out = part if out is None else out.unionByName(part)
    found = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, name) for i, name in enumerate(names))))
    return out.groupBy("a", "b").agg(F.bit_or("bits").alias("bits")).select("a", "b", F.array_join(found, ", ").alias("sources"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id; edges: a, b. Each node's least reachable id."""
    root = graph.components(edges.select(F.col("a").alias("_a"), F.col("b").alias("_b")))
    return nodes.join(root, F.col("id") == F.col("_node"), "left").select("id", F.coalesce("_root", "id").alias("label"))


def hamming_components(df: DataFrame, key: str, hash_: str, radius: int, block: int | None = None) -> DataFrame:
    """id and label, the least key that is reached by pairs within the radius; links run between classes of equal hash."""
    rows = stored(df.select(F.col(key).alias("id"), F.col(hash_).alias("h")))
    classes = stored(hash_classes(rows.where("h is not null"), "id", "h"))
    roots = stored(components(classes.select(F.col("rep").alias("id")), hamming_class_pairs(classes, radius, block)))
    named = classes.join(roots, F.col("rep") == F.col("id")).select("h", "label")
    return rows.join(named, "h", "left").select("id", F.coalesce("label", "id").alias("label"))
