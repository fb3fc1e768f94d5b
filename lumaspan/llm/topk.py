"""Operator 12, exact top-k search by inner product, score at a time over an impact-ordered index.

Index. Components are integers, floor(``scale`` x component). Rows are dealt by a hash of their key into blocks of about ``PER_BLOCK``; a
block's index holds, for each of ``LEVELS`` levels of the magnitude of a component from the highest down, a posting segment for
each dimension: the rows and signs of the components there, which stand for the level's middle. For each row and level it has the length of what
the segments so far do not say of the row's vector (the components not yet met, and the errors of the middles).

Search. For a batch of queries the segments are processed by descending level; each adds its middle times the queries' component to
the rows' sums. A row's true score is within (length of the query) x (length of what is not yet said) of its sum (Cauchy and Schwarz), so
the k-th best lower bound proves which rows cannot be members. A batch stops only when for all its queries the rows that are left are few,
or after the last segment. All rows left are scored exactly in integers and the best are taken, so results do not depend on levels or stops.

Work is quadratic by the contract (queries are a share of all rows): a task takes one block and one batch of queries. Queries with
equal vectors are searched once; of rows of a block with equal vectors only the first k + 1 by key can be in a result and are searched, so copies
of a hot vector cost nothing. Vectors that are null or hold null or non-finite components, and rows without a key, take no part. Of rows that repeat a
key the one with the least vector stands for all. Missing components of shorter vectors count as 0, an empty vector scores 0 with
all. Ties go to the smaller key. Scores beyond a long are taken for its limits, and tie there. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaspan.llm.common import small, stored
from lumaspan.tables import table

K = 5
SCALE = 256
EVERY = 50
LEVELS = 32
PER_BLOCK = 8192
PER_BATCH = 4096
AT_ONCE = 256  # queries of a batch whose sums a task holds at once
LIMIT = 2**63 - 1
FEW = 64  # a query may stop with so many possible members


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Whole numbers, or null for a vector that takes no part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(whole, F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


def matrix(vectors: pa.Array, dims: int | None = None) -> np.ndarray:
    """A list column as an array, shorter rows filled with 0."""
    at = vectors.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(at)
    out = np.zeros((len(sizes), max(dims or 0, sizes.max(initial=0))), np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(at[:-1] - at[0], sizes)] = values
    return out


def built(ids: np.ndarray, values: np.ndarray, k: int, levels: int = LEVELS) -> dict[str, np.ndarray]:
    """The index of a block: rows without needless copies, segments by descending level and then dimension, lengths still unsaid."""
    if values.shape[1]:
        order = np.lexsort((ids, *values.T))
        same = np.concatenate(([False], (values[order][1:] == values[order][:-1]).all(axis=1)))
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        order = np.sort(order[np.arange(len(order)) - start <= k])
    else:
        order = np.argsort(ids)[: k + 1]
    ids, values = ids[order], values[order]
    size = np.abs(values.astype(np.float64))
    width = max(1.0, np.ceil(size.max(initial=1) / levels))
    level = np.ceil(size / width).astype(np.int64)  # 0: no posting
    row, dim = np.nonzero(level)
    lev = level[row, dim]
    by = np.lexsort((row, dim, -lev))
    row, dim, lev = row[by], dim[by], lev[by]
    cut = np.flatnonzero(np.diff(lev * values.shape[1] + dim)) + 1
    starts = np.concatenate(([0], cut, [len(row)])) if len(row) else np.zeros(1, np.int64)
    said = np.sign(values) * (level - 0.5) * width
    unsaid = np.zeros((levels + 1, len(ids)))  # by the last level processed, 0 and 1: all of them
    for n in range(levels + 1):
        unsaid[n] = np.sqrt((np.where(level >= max(n, 1), values - said, values).astype(np.float64) ** 2).sum(axis=1))
    head = starts[:-1]
    return {"ids": ids, "values": values, "width": np.array([width]), "row": row.astype(np.int32), "sign": np.sign(values)[row, dim].astype(np.int8),
            "starts": starts, "level": lev[head] if len(row) else lev, "dim": dim[head] if len(row) else dim, "unsaid": unsaid}


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, in integers, at most ``LIMIT`` from 0."""
    if float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1]) < 2**62:
        return (a * b).sum(axis=1)
    return np.array([max(-LIMIT - 1, min(LIMIT, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)], np.int64)


def searched(index: dict[str, np.ndarray], queries: np.ndarray, k: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of the k + 1 best rows of each query, a query's own row not left out, and how many segments were processed."""
    n, q = len(index["ids"]), queries.astype(np.float64)
    sums, size = np.zeros((n, len(q))), np.sqrt((q**2).sum(axis=1))
    near = float(LIMIT) * (1 - 1e-6)
    level, starts, dims = index["level"], index["starts"], index["dim"]
    slack = 1e-9 * (np.sqrt((index["values"].astype(np.float64) ** 2).sum(axis=1))[:, None] * size[None, :] + 1)
    left, done, kth = np.ones((n, len(q)), bool), 0, max(0, n - k - 1)

    def possible(at: int) -> np.ndarray:
        error = index["unsaid"][at][:, None] * size[None, :] + slack
        low = np.partition((sums - error).T, kth, axis=1)[:, kth]
        low = np.where(low > -near, np.minimum(low, near), -np.inf)  # scores at the limits of a long tie
        return sums + error >= low[None, :]

    for at in sorted(set(level.tolist()), reverse=True):
        a, b = np.searchsorted(-level, [-at, -at + 1])
        for s in range(a, b):
            some = slice(starts[s], starts[s + 1])
            sums[index["row"][some]] += ((at - 0.5) * index["width"][0] * index["sign"][some])[:, None] * q[:, dims[s]][None, :]
        done = b
        # a proof is tried once what is not said is short
        if n > few and 4 * np.median(index["unsaid"][at]) <= np.median(index["unsaid"][-1]) and (left := possible(at)).sum(axis=0).max() <= few:
            break
    else:
        if n:
            left = possible(0)
    row, query = np.nonzero(left)
    score = exact(index["values"][row], queries[query])
    order = np.lexsort((index["ids"][row], ~score, query))
    row, query, score = row[order], query[order], score[order]
    first = np.searchsorted(query, np.arange(len(q)))
    best = np.arange(len(query)) - first[query] <= k if len(query) else np.zeros(0, bool)
    return query[best], row[best], score[best], done


KINDS = {"ids": np.int64, "values": np.int64, "width": np.float64, "row": np.int32, "sign": np.int8, "starts": np.int64, "level": np.int64, "dim": np.int64, "unsaid": np.float64}


def index(vectors: DataFrame, k: int = K, per_block: int = PER_BLOCK, levels: int = LEVELS) -> tuple[DataFrame, int]:
    """vectors: _id (distinct), _v. A row per block: _block, the arrays of ``built`` as bytes; and how many blocks there are."""
    blocks = max(1, -(-vectors.count() // per_block))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids = rows.column("_id").to_numpy()
        found = built(ids, matrix(rows.column("_v").chunk(0)), k, levels)
        return pa.table({"_block": rows.column("_block")[:1], **{c: pa.array([np.ascontiguousarray(found[c], t).tobytes()], pa.binary()) for c, t in KINDS.items()}})

    dealt = vectors.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("_block").applyInArrow(build, "_block int, " + ", ".join(f"{c} binary" for c in KINDS)), blocks


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
           per_block: int = PER_BLOCK, per_batch: int = PER_BATCH, few: int = FEW) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries`` but one of its own key: query_id, rank, vec_id, score."""

    def taking_part(df):
        rows = df.select(F.col(key).cast("long").alias("_id"), quantised(F.col(vector), scale).alias("_v")).where("_id is not null and _v is not null")
        return stored(rows.groupBy("_id").agg(F.min("_v").alias("_v")))

    found, blocks = index(taking_part(vectors), k, per_block)
    found = stored(found)
    asked = taking_part(queries).withColumn("_c", F.md5(F.encode(F.array_join("_v", ","), "utf-8")))
    classes = stored(asked.groupBy("_c").agg(F.min("_id").alias("_rep"), F.first("_v").alias("_v")))
    n = classes.count()
    batches = max(1, -(-n // per_batch))
    batch = classes.select("_rep", "_v", F.pmod(F.xxhash64("_rep"), F.lit(batches)).cast("int").alias("_batch"))
    to = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    def answer(key_, block: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if len(block) and len(asks):
            asks = asks.combine_chunks()
            one = {c: np.frombuffer(block.column(c)[0].as_py(), t) for c, t in KINDS.items()}
            rows = len(one["ids"])
            one["values"], one["unsaid"] = one["values"].reshape(rows, -1), one["unsaid"].reshape(-1, rows)
            reps, q = asks.column("_rep").to_numpy(), matrix(asks.column("_v").chunk(0), one["values"].shape[1])
            if q.shape[1] > one["values"].shape[1]:
                one["values"] = np.pad(one["values"], ((0, 0), (0, q.shape[1] - one["values"].shape[1])))
            for i in range(0, len(reps), AT_ONCE):
                query, row, score, _ = searched(one, q[i : i + AT_ONCE], k, few)
                out.append(pa.table({"_rep": reps[i : i + AT_ONCE][query], "_vec": one["ids"][row], "_score": score}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("_rep", "_vec", "_score")})

    pairs = ["_block", "_batch"]
    best = found.select("*", to(batches, "_batch")).groupBy(*pairs).cogroup(batch.select("*", to(blocks, "_block")).groupBy(*pairs)).applyInArrow(
        answer, "_rep long, _vec long, _score long")
    order = Window.partitionBy("_rep").orderBy(F.desc("_score"), "_vec")
    best = best.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k + 1)
    best = stored(best.groupBy(F.col("_rep").alias("_r")).agg(F.array_sort(F.collect_list(F.struct("_k", "_vec", "_score"))).alias("_best")))
    named = asked.select("_id", "_c").join(small(classes.select("_c", "_rep"), n), "_c").join(small(best, n), F.col("_rep") == F.col("_r"))
    others = F.slice(F.filter("_best", lambda x: x["_vec"] != F.col("_id")), 1, k)
    return named.select(F.col("_id").alias("query_id"), F.posexplode(others).alias("_at", "_x")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x._vec").alias("vec_id"), F.col("_x._score").alias("score"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = r"""
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
