"""Groups, anchors, quality rules and joins of vectors against plain-Python versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lumaspan.functions import pairs as P
from lumaspan.functions import quality as Q
from lumaspan.operators import groups as G
from lumaspan.operators import state as S
from lumaspan.operators import vectors as V
from lumaspan.operators.storage import stored


def greedy(order, score):
    edge = lambda a, b: score.get((min(a, b), max(a, b)))
    out = []
    for n in order:
        fits = [(min(edge(n, m) for m in g), g) for g in out if all(edge(n, m) is not None for m in g)]
        if fits:
            max(fits, key=lambda f: f[0])[1].append(n)
        else:
            out.append([n])
    return {(g[0], m) for g in out for m in g}


@pytest.mark.parametrize("bound", [10**6, 0])
def test_complete_link_in_one_task_and_by_rounds(spark, bound):
    rng = random.Random(7)
    order = list(range(24))
    rng.shuffle(order)
    score = {}
    for _ in range(50):
        a, b = rng.sample(range(21), 2)
        score[min(a, b), max(a, b)] = rng.randrange(4) / 4
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "id long, o long")
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in score.items()] + [(3, 3, 1.0), (1, 23, None)], "a long, b long, score double")
    want = greedy(order, score)
    assert set(map(tuple, G.complete_link(nodes, edges, bound, singles=True).collect())) == want
    several = {(a, m) for a, m in want if sum(x == a for x, _ in want) > 1}
    assert set(map(tuple, G.complete_link(nodes, edges, bound).collect())) == several
    assert G.complete_link(nodes, edges.limit(0), bound).count() == 0


def test_complete_link_of_a_dense_component_in_few_windows(spark, monkeypatch):
    """One component in which every node waits for those before it: windows of nodes, not a round for each node."""
    monkeypatch.setattr(G, "NODES", 4)
    stores = []
    monkeypatch.setattr(G, "stored", lambda df: stores.append(1) or stored(df))
    rng = random.Random(11)
    pairs = sorted({tuple(sorted(rng.sample(range(160), 2))) for _ in range(2500)})
    score = {p: rng.randrange(6) / 6 for p in pairs}
    nodes = spark.createDataFrame([(n, n % 40) for n in range(160)], "id long, o long")
    want = greedy(sorted(range(160), key=lambda n: (n % 40, n)), score)
    edges = spark.createDataFrame([(*p, s) for p, s in score.items()], "a long, b long, score double")
    assert set(map(tuple, G.complete_link(nodes, edges, 700, singles=True).collect())) == want
    assert len(stores) < 20


def test_anchors_labels_and_losers(spark):
    groups = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "anchor long, member long")
    edges = spark.createDataFrame([(2, 1, 0.5), (2, 3, 0.9)], "a long, b long, s double")
    assert {(r.member, r.is_anchor, r.cached, r.s) for r in G.against_anchor(groups, edges, ["s"]).collect()} == {(1, True, False, None), (2, False, True, 0.5), (3, False, False, None)}
    labels = spark.createDataFrame([(1, ["b", "a"]), (1, ["a", "c"]), (2, [])], "root long, v array<string>")
    assert {r.root: r.v for r in G.label_unions(labels, "root", "v").collect()} == {1: ["a", "b", "c"], 2: []}
    auto = spark.createDataFrame([(1, "exact", 1, True), (1, "exact", 2, False), (2, "compression", 3, True), (2, "compression", 2, False), (3, "odd", 5, False)], "grp long, kind string, member long, winner boolean")
    assert {r.member for r in G.automatic_losers(auto).collect()} == {2, 5}
    assert {tuple(r) for r in G.automatic_violations(auto).collect()} == {(1, "loser of two groups"), (2, "loser of two groups"), (3, "unknown kind"), (3, "no winner")}


def test_cosine_of_vectors_of_any_length(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.1, 0.0]), (2, [0.0, 5.0]), (3, [3.0, 4.0]), (4, [0.0, 0.0]), (5, None)], "id long, v array<double>")
    got = {(r.a, r.b): r.similarity for r in V.cosine_topk(df, "id", "v", 3, 0.5).collect()}
    assert got == {(0, 1): 1.0, (1, 0): 1.0, (0, 3): 0.6, (3, 0): 0.6, (1, 3): 0.6, (3, 1): 0.6, (2, 3): 0.8, (3, 2): 0.8}
    three = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.2, 0.0]), (2, [0.0, 0.0, 1.0])], "id long, v array<double>")
    assert {(r.a, r.b) for r in V.cosine_pairs(V.cosine_topk(three, "id", "v", 1, 0.9), True).collect()} == {(0, 1)}


def test_gate_is_necessary_for_every_verdict(spark):
    rng = random.Random(5)
    pick = lambda low, high, bounds: rng.choice(bounds) if rng.random() < 0.2 else rng.uniform(low, high)
    rows = [(
        pick(0, 0.3, [0.005, 0.03, 0.2]), pick(1, 6, [1.05, 4.1]), float(rng.choice([12, 18, 20]) if rng.random() < 0.2 else rng.randrange(41)),
        None if rng.random() < 0.25 else pick(-0.1, 1, [0.72, 0.94]), None if rng.random() < 0.25 else pick(-0.1, 1, [0.82]), rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.5) for _ in range(8000)]
    df = spark.createDataFrame(rows, "aspect_delta double, resolution_ratio double, hash_distance double, sscd_similarity double, dino_similarity double, same_size_lossless boolean, icc_mismatch boolean, alpha_mismatch boolean")
    # everything that the gate does not see at its best
    best = {"ssim": 1.0, "psnr": 99.0, "block_ssim_p10": 1.0, "coarse_ssim": 1.0, "coarse_psnr": 99.0, "coarse_block_ssim_p10": 1.0, "alpha_mae": 0.0, "alpha_local_peak": 0.0, "max_block_mae": 0.0, "color_mae": 0.0,
            "gray_local_peak": 0.0, "color_local_peak": 0.0, "review_score": 1.0, "edge_similarity": 1.0, "geometric_similarity": 1.0, "residual_std": 0.0, "residual_edge_correlation": 1.0}
    df = df.withColumns({k: F.lit(v) for k, v in best.items()}).withColumn("noise_sigma_delta", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    verdict = P.auto_candidate() | Q.review_level()["level"].isNotNull()
    assert df.where(verdict & ~Q.cheap_gate()).count() == 0
    assert df.where(~Q.cheap_gate()).count() > 0.1 * 2 * len(rows)


def test_jpeg_quality_takes_the_first_of_the_nearest(spark):
    luma, chroma = Q.standard_tables()
    scaled = lambda q, t: [min(255.0, max(1.0, float((b * (5000 / q if q < 50 else 200 - 2 * q) + 50) // 100))) for b in t]
    rows = [(q, [scaled(q, luma), scaled(q, chroma)]) for q in (5, 50, 75, 92, 98)]
    rows += [(200, [[1.0] * 10]), (201, None), (202, []), (203, [scaled(50, luma) + [7.0] * 6])]
    got = {r.k: r.f for r in spark.createDataFrame(rows, "k long, t array<array<double>>").select("k", Q.jpeg_quality(F.col("t")).alias("f")).collect()}
    assert {k: f.quality for k, f in got.items() if f} == {5: 5, 50: 50, 75: 75, 92: 92, 98: 98, 203: 50}
    assert got[200] is None and got[201] is None and got[202] is None and got[75].error == 0


def test_jpeg_quality_of_many_rows_takes_seconds(spark):
    """The expected tables are constants, and errors are summed once for a row."""
    luma, chroma = (F.element_at(F.array(*(F.array(*map(F.lit, t)) for t in Q.expected_tables(b))), F.col("q")) for b in Q.standard_tables())
    df = spark.range(2000).select((F.col("id") % 94 + 5).cast("int").alias("q")).select("q", F.array(luma, chroma).alias("t")).repartition(4)
    began = time.monotonic()
    got = df.select("q", Q.jpeg_quality(F.col("t")).alias("f")).select("q", "f.quality", "f.error").collect()
    assert len(got) == 2000 and all(r.q == r.quality and r.error == 0 for r in got)
    assert time.monotonic() - began < 30  # more than a minute where each error was computed from its formula


def test_manifest_order_over_many_stretches(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("root"), F.when(F.col("id") % 3 == 0, "single").otherwise("duplicate").alias("kind"), F.concat(F.lit("P"), F.pmod(F.col("id") * 37, F.lit(500)).cast("string")).alias("path"))
    got = {(r.root, r.path): r.ordinal for r in S.in_manifest_order(df.repartition(7), "root", "kind", "path", {"duplicate": 0, "single": 2}, span=8).collect()}
    for root in (0, 1):
        rows = sorted((r for r in df.collect() if r.root == root), key=lambda r: (r.kind == "single", r.path.lower(), r.path))
        assert [got[root, r.path] for r in rows] == list(range(1, len(rows) + 1))
