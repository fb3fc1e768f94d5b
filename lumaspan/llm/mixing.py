"""Operator 9, mixing sources to target weights, in DataFrame functions only.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share all words; a target stops at
``most`` times its source's size and the excess goes to the others by weight until none is above (found at once from the
sources sorted by size per weight). A target is whole passes over the source and a rest. Documents are permuted by a
seeded hash into cells; 64 blocks of cells make a pass. The rest takes whole cells in permuted order as far as they
fit, in the one cell at the cut the shortest documents up to the target, so that only that cell's rows are ordered, and
the one document left that fills the gap best.

Shards: the drawn blocks of all sources are split between output shards by a binary tree. At each node a random
permutation sends an exact half of its blocks to either side, so that the numbers from each source are multivariate
hypergeometric draws without replacement; a leaf's disjoint blocks are shuffled locally by the column ``_order``.

Null and empty texts have size 0. Repeated rows with the same key and size are drawn together, and fill a gap together or not. An empty table gives an
empty result; sources without words have the target 0. Reruns agree (all draws hash the seed). Other columns are kept
by ``mixed`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaspan.llm.common import documents, shielded, small, stored, words_of

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCKS = 64
PER_CELL = 4096  # rows of all sources in a cell; a block has a power of two of cells
MAX_CELLS_BITS = 12
SHARDS = 16
SEED = 11


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: _source, _size, a row per source. Adds _w, _target. Windows here run over sources, not documents."""
    w = Window.orderBy(F.col("_source").asc_nulls_last())
    s = sizes.withColumn("_w", F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(w) - 1) % len(weights)).cast("int")))
    # water filling: sources are capped from the smallest size per weight on, as long as the level is above their cap
    by = Window.orderBy((F.col("_size") / F.col("_w")), F.col("_source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.select(
        "*", F.sum("_size").over(every).alias("_all"),
        (F.sum(most * F.col("_size")).over(by.rowsBetween(Window.unboundedPreceding, -1))).alias("_caps"),
        F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_rest"),
    ).withColumn("_level", (F.col("_all") - F.coalesce("_caps", F.lit(0))) / F.col("_rest"))
    fits = F.col("_level") * F.col("_w") <= most * F.col("_size")
    level = F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.col("_size") / F.col("_w"))).over(every)
    return s.select("_source", "_size", "_w", F.least(level * F.col("_w"), (most * F.col("_size")).cast("double")).alias("_target"))


def shard_tree(blocks: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """blocks: _source, _pass, _block. Adds _shard. Each level halves the capacity of every node."""
    out, span = blocks.withColumn("_node", F.lit(0)).withColumn("_shards", F.lit(shards)), shards
    level = 0
    while span > 1:
        by = Window.partitionBy("_node").orderBy(F.xxhash64(F.lit(seed), F.lit(level), "_source", "_pass", "_block"), "_source", "_pass", "_block")
        left = F.floor(F.col("_shards") / 2).cast("int")
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy("_node"))).withColumn("_k", F.row_number().over(by))
        goes = (F.col("_shards") > 1) & (F.col("_k") > F.round(F.col("_n") * left / F.col("_shards")))
        out = out.select(
            "_source", "_pass", "_block", F.when(goes, F.col("_node") + left).otherwise(F.col("_node")).alias("_node"),
            F.when(F.col("_shards") <= 1, F.col("_shards")).when(goes, F.col("_shards") - left).otherwise(left).alias("_shards"))
        span, level = -(-span // 2), level + 1
    return out.select("_source", "_pass", "_block", F.col("_node").cast("int").alias("_shard"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
         most: int = MOST, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row: _key, _size, _source, _source_size, _target, _copies, _shards (a shard per copy), _u (the permuted place)."""
    rows = stored(docs.select(
        F.col(key).alias("_key"), F.size(words_of(F.col(text))).cast("long").alias("_size"), F.col(source).alias("_source"))
        .withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), "_key", "_size"), F.lit(1 << 32))))
    per_block = 1 << max(0, min(MAX_CELLS_BITS, (rows.count() // (BLOCKS * PER_CELL)).bit_length()))
    cells = BLOCKS * per_block
    rows = rows.withColumn("_cell", F.floor(F.col("_u") / ((1 << 32) // cells)).cast("int"))
    by_cell = stored(rows.groupBy("_source", "_cell").agg(F.sum("_size").alias("_n")))
    goal = targets(by_cell.groupBy("_source").agg(F.sum("_n").alias("_size")), weights, most)
    goal = goal.select(
        F.col("_source").alias("_s"), F.col("_size").alias("_source_size"), "_target",
        F.when(F.col("_size") > 0, F.least(F.lit(most), F.floor(F.col("_target") / F.col("_size")))).otherwise(0).cast("int").alias("_passes"),
    ).withColumn("_over", F.col("_target") - F.col("_passes") * F.col("_source_size"))
    same = F.col("_source").eqNullSafe(F.col("_s"))
    run = Window.partitionBy("_s").orderBy("_cell")
    upto = by_cell.join(goal, same).withColumn("_sum", F.sum("_n").over(run))
    # the cut: the first cell that does not fit as a whole, and the words before it
    cut = upto.groupBy("_s").agg(
        F.min(F.when(F.col("_sum") > F.col("_over"), F.col("_cell"))).alias("_cut"),
        F.max(F.when(F.col("_sum") <= F.col("_over"), F.col("_sum"))).alias("_before"))
    goal = stored(goal.join(cut.withColumnRenamed("_s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")), "left").select(
        "_s", "_source_size", "_target", "_passes", "_over",
        F.coalesce("_cut", F.lit(cells)).alias("_cut"), F.coalesce("_before", F.lit(0)).alias("_before")))
    n = goal.count()
    # blocks drawn: all of each whole pass, and those up to the cut in the last
    last = F.floor(F.col("_cut") / per_block).cast("int")
    drawn = goal.select(F.col("_s").alias("_source"), F.explode(F.sequence(F.lit(0), F.col("_passes"))).alias("_pass"), "_passes", last.alias("_last")).select(
        "_source", "_pass", F.explode(F.when(F.col("_pass") < F.col("_passes"), F.sequence(F.lit(0), F.lit(BLOCKS - 1))).otherwise(
            F.sequence(F.lit(0), F.least(F.col("_last"), F.lit(BLOCKS - 1))))).alias("_block"))
    dealt = stored(shard_tree(drawn, shards, seed).groupBy("_source", "_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pass", "_shard"))), lambda x: x["_shard"]).alias("_dealt")))
    joined = rows.join(small(goal, n), same).drop("_s")
    at_cut = joined.where(F.col("_cell") == F.col("_cut"))
    upto = F.sum("_size").over(Window.partitionBy("_source").orderBy("_size", "_u", "_key")) + F.col("_before")
    at_cut = stored(at_cut.withColumn("_in", upto <= F.col("_over") + 0.5))
    rest = joined.where(F.col("_cell") != F.col("_cut")).withColumn("_in", F.col("_cell") < F.col("_cut"))
    # what is still missing is filled by the one document left out that comes nearest
    gap = at_cut.groupBy("_source").agg(F.first(F.col("_over") - F.col("_before")).alias("_g"), F.sum(F.when(F.col("_in"), F.col("_size")).otherwise(0)).alias("_t"))
    gap = stored(gap.select(F.col("_source").alias("_s"), (F.col("_g") - F.col("_t")).alias("_gap")))
    off = F.abs(F.col("_gap") - F.col("_size") * F.col("_m"))
    left = rest.unionByName(at_cut).where(~F.col("_in")).join(small(gap, n), same).where(F.col("_size") < 2 * F.col("_gap"))
    left = left.groupBy("_s", "_gap", "_key", "_size", "_u").agg(F.count("*").alias("_m"))  # repeated rows are one choice
    best = left.where(off < F.col("_gap")).groupBy("_s").agg(
        F.min_by(F.struct("_key", "_size", "_u"), F.struct(off, F.col("_u"), F.col("_key"))).alias("_best"))
    best = stored(best.withColumnRenamed("_s", "_s3"))
    chosen = F.col("_best").isNotNull() & F.struct("_key", "_size", "_u").eqNullSafe(F.col("_best"))
    drawn_rows = rest.unionByName(at_cut).join(small(best, n), F.col("_source").eqNullSafe(F.col("_s3")), "left").withColumn("_in", F.col("_in") | chosen)
    copies = F.least(F.lit(most), F.col("_passes") + F.col("_in").cast("int"))  # texts without words fit any rest
    dealt_to = F.slice(F.coalesce("_dealt", F.array().cast("array<int>")), F.lit(1), copies)
    dealt = small(dealt.select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_dealt"), n * BLOCKS)
    return drawn_rows.withColumn("_b0", F.floor(F.col("_cell") / per_block).cast("int")).join(
        dealt, same & (F.col("_b0") == F.col("_b")), "left").select(
        "_key", "_size", "_source", "_source_size", "_target", copies.alias("_copies"),
        F.when(F.size(dealt_to) < copies, F.concat(dealt_to, F.array(F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(shards)).cast("int")))).otherwise(dealt_to).alias("_shards"), "_u")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents of the mix, a row per copy, with the input's columns and, behind them, _shard and _order (shuffles within a shard)."""
    docs, named = shielded(docs, key, text, source)
    chosen = plan(docs, key, text, source, **how).where("_copies > 0").groupBy("_key", "_size", "_source").agg(
        F.first("_copies").alias("_copies"), F.first("_shards").alias("_shards"), F.first("_u").alias("_u"))
    sized = docs.withColumn("_n", F.size(words_of(F.col(text))).cast("long"))
    on = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_n") == F.col("_size")) & F.col(source).eqNullSafe(F.col("_source"))
    return named(sized.join(chosen, on).select(*docs.columns, "_u", F.posexplode("_shards").alias("_copy", "_shard")).select(
        *docs.columns, "_shard", F.xxhash64(F.lit(how.get("seed", SEED)), "_u", "_copy").alias("_order")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir)).select(
        F.col("_key").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_shards").alias("shards"))
