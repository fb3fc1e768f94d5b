"""Range and nearest-neighbour joins over metric cells against all pairs, and what they send."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspan.operators import metric
from lumaspan.operators.vectors import cosine_topk, hamming_components, hamming_pairs


def clustered(n, centres, seed, flips=6):
    gen = np.random.default_rng(seed)
    base = gen.integers(0, 2**64, centres, np.uint64)
    out = base[gen.integers(0, centres, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << gen.integers(0, 64, n, np.uint64)) * gen.integers(0, 2, n, np.uint64)
    return out


def frame(spark, h):
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(h.view(np.int64))], "id long, h long")


@pytest.mark.parametrize(("radius", "block"), [(3, 50), (12, 50), (20, 50), (20, 10_000), (24, 7)])
def test_range_join_equals_all_pairs(spark, radius, block):
    h = np.concatenate([clustered(150, 12, 1), np.repeat(np.uint64(77), 25), np.zeros(1, np.uint64), ~np.zeros(1, np.uint64)])
    d = np.bitwise_count(h[:, None] ^ h[None, :])
    want = {(i, j, int(d[i, j])) for i, j in zip(*np.nonzero(d <= radius), strict=True) if i < j}
    got = hamming_pairs(frame(spark, h), "id", "h", radius, block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_components_by_classes(spark):
    h = np.concatenate([clustered(120, 15, 2), np.repeat(np.uint64(5), 40)])
    df = frame(spark, h).unionAll(spark.createDataFrame([(999, None)], "id long, h long"))
    near = np.bitwise_count(h[:, None] ^ h[None, :]) <= 12
    root = np.arange(len(h))
    while True:
        new = np.array([root[row].min() for row in near])
        if (new == root).all():
            break
        root = new
    assert dict(hamming_components(df, "id", "h", 12, 30).collect()) == {**dict(enumerate(root.tolist())), 999: 999}


@pytest.mark.parametrize("block", [40, 10_000])
def test_nearest_equal_all_pairs_with_ties(spark, block):
    gen = np.random.default_rng(4)
    v = gen.normal(size=(8, 10))[gen.integers(0, 8, 300)] + gen.choice([0.0, 0.02, 0.5], (300, 1)) * gen.normal(size=(300, 10))
    v[17] = 0
    u = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    s = np.round(u @ u.T, 6)
    want = set()
    for i in range(300):
        best = [j for j in np.lexsort((np.arange(300), -s[i])) if j != i][:5]
        want |= {(i, int(j), float(s[i, j])) for j in best if s[i, j] >= 0.1}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "id long, v array<double>")
    got = {(r.a, r.b, r.similarity) for r in cosine_topk(df, "id", "v", 5, 0.1, block).collect()}
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2] for x in want), abs=2e-6)


def test_rows_sent_grow_with_the_rows_where_data_cluster(spark):
    rows = []
    for n in (1000, 4000):
        df = frame(spark, clustered(n, n // 50, 3, flips=2)).select("id", F.col("h").alias("x"))
        placed, cells = metric.partitioned(df, metric.Bits, 100)
        assert placed.groupBy("blk").count().agg(F.max("count")).first()[0] < 200
        rows.append(metric.sent(placed, cells, 3).select(F.sum(F.size("to"))).first()[0])
    assert rows[0] < 10 * 1000 and rows[1] < 1.5 * 4 * rows[0]  # all blocks: 16 times as many


def test_empty_frames(spark):
    none = spark.createDataFrame([], "id long, h long")
    assert hamming_pairs(none, "id", "h", 20).count() == 0
    assert cosine_topk(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 3, 0.0).count() == 0


def test_pairs_are_never_the_side_that_is_broadcast(spark):
    """Pairs within a wide radius are many times the rows, but look as small as the rows they come from."""
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    distinct, copies = np.unique(clustered(300, 3, 5)), np.concatenate([clustered(300, 3, 5), np.repeat(np.uint64(9), 20)])
    got = hamming_pairs(frame(spark, distinct), "id", "h", 20)
    assert "Join" not in plan(got) and got.count() > 10 * len(distinct)
    assert "BuildLeft" not in plan(hamming_pairs(frame(spark, copies), "id", "h", 20))


def test_pairs_come_in_batches(spark, monkeypatch):
    h = clustered(200, 1, 6)
    monkeypatch.setattr(metric, "BATCH", 50)
    monkeypatch.setattr(metric, "TILE", 30)
    d = np.bitwise_count(h[:, None] ^ h[None, :])
    want = {(i, j, int(d[i, j])) for i, j in zip(*np.nonzero(d <= 20), strict=True) if i < j}
    assert {tuple(r) for r in hamming_pairs(frame(spark, h), "id", "h", 20).collect()} == want


@pytest.mark.parametrize("floor", [-1.0, 0.1])
def test_nearest_by_panels_of_broadcast_blocks(spark, monkeypatch, floor):
    """Blocks come to the rows, a panel at a time: nothing is shuffled by pairs of blocks. Copies of a vector and rows with a value that is not finite hide nobody."""
    monkeypatch.setattr(metric, "BLOCK", 25)
    monkeypatch.setattr(metric, "MAX_BLOCK", 25)
    monkeypatch.setattr(metric, "PANEL_BYTES", 6000)
    monkeypatch.setattr(metric, "sent", None)
    gen = np.random.default_rng(8)
    v = np.concatenate([gen.normal(size=(160, 6)), np.repeat(gen.normal(size=(1, 6)), 50, axis=0), np.zeros((3, 6))]).astype(np.float32)
    df = spark.createDataFrame([(i * 7 % 213, x.tolist()) for i, x in enumerate(v)] + [(900, [float("nan")] * 6), (901, [float("inf")] * 6)], "id long, v array<float>")
    got = cosine_topk(df, "id", "v", 4, floor)
    assert "Exchange" not in got._jdf.queryExecution().sparkPlan().toString()
    x = v.astype(np.float64)
    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    names = np.arange(len(v)) * 7 % 213
    s, want = np.round(np.einsum("ik,jk->ij", x, x), 6), set()
    for i in range(len(v)):
        best = [j for j in np.lexsort((names, -s[i])) if j != i][:4]
        want |= {(int(names[i]), int(names[j]), float(s[i, j])) for j in best if s[i, j] >= floor}
    assert {tuple(r) for r in got.collect()} == want
