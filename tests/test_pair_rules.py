"""Verdicts on pairs at and beyond each bound, with missing metrics."""

import pytest
from pyspark.sql import functions as F

from lumaspan.functions import pairs

FLAGS = ("same_size_lossless", "icc_mismatch", "alpha_mismatch")
GOOD = dict(
    hash_distance=12.0, aspect_delta=0.005, resolution_ratio=1.05, residual_std=0.1, residual_edge_correlation=0.5, noise_sigma_delta=0.0, ssim=0.985, psnr=32.0, block_ssim_p10=0.965,
    coarse_ssim=0.0, coarse_psnr=0.0, coarse_block_ssim_p10=0.0, alpha_mae=1 / 255, alpha_local_peak=0.01, max_block_mae=0.045, color_mae=0.025, gray_local_peak=0.06, color_local_peak=0.06,
    review_score=0.88, sscd_similarity=0.94, same_size_lossless=False, icc_mismatch=False, alpha_mismatch=False)
RESIZED = dict(resolution_ratio=4.1, ssim=0.0, coarse_ssim=0.985, coarse_psnr=float("inf"), coarse_block_ssim_p10=0.98)
NOISY = dict(residual_std=0.45, residual_edge_correlation=0.05)
#: Changes to a pair at all bounds, then: noise signature, equivalent, review candidate, auto candidate.
CASES = [
    ({}, (False, True, True, True)), (RESIZED, (False, True, True, True)), (RESIZED | dict(resolution_ratio=4.2), (False, False, True, False)),
    (RESIZED | NOISY, (False, True, True, True)), (NOISY, (True, False, True, False)), (dict(noise_sigma_delta=0.25), (True, False, True, False)),
    (NOISY | dict(hash_distance=20.0, review_score=0.95), (True, False, True, False)), (dict(hash_distance=20.0, review_score=0.95), (False, True, False, True)),
    (dict(hash_distance=21.0), (False, True, False, False)), (dict(sscd_similarity=None), (False, True, True, False)), (dict(aspect_delta=0.03), (False, False, True, False)),
    (dict(aspect_delta=0.031), (False, False, False, False)), (dict(same_size_lossless=True, hash_distance=15.0, review_score=0.96), (False, False, True, False)),
    (dict(icc_mismatch=True), (False, False, True, False)), (dict(psnr=None), (False, False, True, False)), (dict(review_score=0.87), (False, True, False, True)),
    (dict(resolution_ratio=None), (False, False, True, False)), (dict.fromkeys(GOOD), (False, False, False, False)),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [tuple((GOOD | c)[k] for k in GOOD) for c, _ in CASES]
    kind = ", ".join(f"{k} {'boolean' if k in FLAGS else 'double'}" for k in GOOD)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}")
    got = df.select("i", pairs.noise_signature(), pairs.compression_equivalent(), pairs.review_candidate(), pairs.auto_candidate()).collect()
    return {r[0]: tuple(r[1:]) for r in got}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_verdicts(verdicts, i):
    assert verdicts[i] == CASES[i][1], CASES[i][0]


def test_node_tags(spark):
    df = spark.createDataFrame([("US-1 fast",), ("bus 7",), ("日本 JP",), (None,), ("",)], "n string")
    got = [r[0] for r in df.select(pairs.node_tags(F.col("n"), {"us": ["us", "usa"], "jp": ["jp", "日本"]})).collect()]
    assert got == [["us"], [], ["jp"], [], []]
