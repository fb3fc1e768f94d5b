"""Operator 5, sharding by Karmarkar-Karp differencing (law ``bytes``: shard sizes near equal).

Rows with equal texts form a group that stays in one shard. Groups that hold more than 1 / ``items`` of all bytes are
items of their own (fewer than ``items``); the others are hashed into ``items`` bundles. So there are under 2 x ``items``
items whatever the input's size, and the driver can difference them: the two partial partitions of largest spread are
combined again and again, one ordered against the other, until one partition into ``shards`` bins is left. Rows then find
their shard by their text's digest, without a shuffle: heavy groups in a broadcast table, bundles in an array.

A null text has no bytes (size 1, CRC 0) and is grouped with no other text but null. Repeated rows are placed each.
Ties in spread go to the smaller item number, so reruns agree. An empty table gives an empty result. Slots are
gapless from 0 in each shard, dealt by a hash of the key and then the key. Other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaspan.llm.common import documents, stored, whole

SHARDS = 16
ITEMS = 8192
PER_UNIT = 20_000


def differencing(sums: list[tuple[int, ...]]) -> tuple[list[list[int]], list[int]]:
    """Combines partial partitions (ascending bin sums) into one: the final bin of each item's bins, and the bins' sums."""
    k = len(sums[0])
    heap = [(s[0] - s[-1], i, s) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, list[int]]] = []
    lift = 0
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        bins = sorted((x[j] + y[k - 1 - j], j) for j in range(k))
        low = bins[0][0]
        lift += low
        made.append((a, b, [j for _, j in bins]))
        s = tuple(v - low for v, _ in bins)
        heapq.heappush(heap, (-s[-1], len(sums) + len(made) - 1, s))
    _, top, rest = heap[0]
    place: list[list[int] | None] = [None] * (len(sums) + len(made))
    place[top] = list(range(k))
    for n in range(len(made) - 1, -1, -1):
        at = place[len(sums) + n]
        a, b, order = made[n]
        pa, pb = [0] * k, [0] * k
        for new, j in enumerate(order):
            pa[j] = at[new]
            pb[k - 1 - j] = at[new]
        place[a], place[b] = pa, pb
        place[len(sums) + n] = None
    return place[: len(sums)], [v + lift for v in rest]


def balanced(groups: DataFrame, shards: int = SHARDS, items: int = ITEMS) -> tuple[DataFrame, list[int]]:
    """groups: _g (distinct), _w (weight). Returns the heavy groups (_g, _shard), at most ``items`` rows, and a shard for each bundle."""
    total = groups.agg(F.sum("_w")).first()[0] or 0
    heavy = F.col("_w") * items > total
    top = [(bytes(g), w) for g, w in groups.where(heavy).select("_g", "_w").orderBy("_g").collect()]  # under ``items`` rows
    light = dict(groups.where(~heavy).groupBy(bundle(F.col("_g"), items).alias("b")).agg(F.sum("_w")).collect())
    weights = [w for _, w in top] + [light.get(b, 0) for b in range(items)]
    place, _ = differencing([(0,) * (shards - 1) + (int(w),) for w in weights])
    found = [p[-1] for p in place]
    spark = groups.sparkSession
    return spark.createDataFrame([(g, k) for (g, _), k in zip(top, found)], "_g binary, _shard int"), found[len(top):]


def bundle(group: Column, items: int) -> Column:
    return F.pmod(F.xxhash64(group, F.lit(5)), F.lit(items)).cast("int")


def text_size(text: Column) -> Column:
    return (F.octet_length(whole(text)) + 1).cast("long")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, items: int = ITEMS,
           per_unit: int = PER_UNIT) -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard."""
    rows = stored(docs.select(
        F.col(key).alias("_key"), text_size(F.col(text)).alias("size"), F.crc32(F.encode(whole(F.col(text)), "utf-8")).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit(b"\0")).otherwise(F.unhex(F.md5(F.encode(whole(F.col(text)), "utf-8")))).alias("_g"),
    ))
    groups = stored(rows.groupBy("_g").agg(F.sum("size").alias("_w")))
    heavy, light = balanced(groups, shards, items)
    bins = F.from_json(F.lit(str(light)), "array<int>")
    units = max(1, -(-rows.count() // (per_unit * shards)))
    placed = stored(rows.join(F.broadcast(heavy), "_g", "left").select(
        "_key", "size", "text_crc32", F.coalesce("_shard", F.get(bins, bundle(F.col("_g"), items))).alias("_shard"), F.pmod(F.xxhash64("_key", "size", F.lit(9)), F.lit(units)).alias("_unit")))
    before = placed.groupBy("_shard", "_unit").agg(F.count("*").alias("_n")).select(
        "_shard", "_unit",
        (F.sum("_n").over(Window.partitionBy("_shard").orderBy("_unit")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("_shard", "_unit").orderBy("_key", "size", "text_crc32")
    return placed.withColumn("_at", F.row_number().over(order)).join(before, ["_shard", "_unit"]).select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
        (F.col("_before") + F.col("_at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))
