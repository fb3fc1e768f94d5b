"""Verdicts on pairs of images from their metrics, as boolean columns. A missing metric satisfies no bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default bounds of the verdicts.
SAME_SIZE_RATIO = 1.05
AT_MOST = {
    "equivalent": {"aspect_delta": 0.005, "resolution_ratio": 4.1, "alpha_mae": 1 / 255, "alpha_local_peak": 0.01, "max_block_mae": 0.045, "color_mae": 0.025, "gray_local_peak": 0.06, "color_local_peak": 0.06},
    "noise": {"residual_edge_correlation": 0.05},
    "review": {"aspect_delta": 0.03},
    "near": {"hash_distance": 12},
    "wide": {"hash_distance": 20},
}
AT_LEAST = {
    "same_size": {"ssim": 0.985, "psnr": 32.0, "block_ssim_p10": 0.965},
    "resized": {"coarse_ssim": 0.985, "coarse_psnr": 35.0, "coarse_block_ssim_p10": 0.98},
    "noise": {"residual_std": 0.45},
    "denoised": {"noise_sigma_delta": 0.25},
    "review": {"review_score": 0.88},
    "protected": {"review_score": 0.95},
    "auto": {"sscd_similarity": 0.94},
}


def holds(rule: str) -> Column:
    """All bounds of a rule."""
    terms = [F.col(m) <= b for m, b in AT_MOST.get(rule, {}).items()] + [F.col(m) >= b for m, b in AT_LEAST.get(rule, {}).items()]
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def unset(*flags: str) -> Column:
    """None of the flags is set; an unknown flag counts as set."""
    out = F.lit(True)
    for f in flags:
        out = out & ~F.coalesce(F.col(f), F.lit(True))
    return out


def same_size() -> Column:
    return F.coalesce(F.col("resolution_ratio") <= SAME_SIZE_RATIO, F.lit(False))


def noise_signature() -> Column:
    """At equal size: a residual like noise, or another noise level."""
    return same_size() & (holds("noise") | holds("denoised"))


def compression_equivalent() -> Column:
    """Nothing but encoding or scaling differs, locally too."""
    structure = F.when(same_size(), holds("same_size")).otherwise(holds("resized"))
    return holds("equivalent") & structure & unset("same_size_lossless", "icc_mismatch", "alpha_mismatch") & ~noise_signature()


def review_candidate() -> Column:
    """Close hashes, or wider ones of a pair so alike that only lossless copies or noise keep it from being equivalent."""
    kept_apart = F.coalesce(F.col("same_size_lossless"), F.lit(False)) | noise_signature()
    return holds("review") & (holds("near") | (holds("wide") & holds("protected") & kept_apart))


def auto_candidate(copy_detection: bool = True) -> Column:
    """Equivalent and, where copy detection runs, sure of it with a hash inside the wider radius."""
    return compression_equivalent() & holds("auto") & holds("wide") if copy_detection else compression_equivalent()


def node_tags(name: Column, regions: dict[str, list[str]]) -> Column:
    """Sorted region tags of a node's name: ASCII aliases match whole tokens, others anywhere."""
    tokens = F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), F.lit(1))
    found = []
    for tag, aliases in regions.items():
        hit = F.lit(False)
        for a in aliases:
            hit = hit | (F.array_contains(tokens, a.lower()) if a.isascii() else name.contains(a))
        found.append(F.when(hit, F.lit(tag)))
    return F.array_sort(F.array_compact(F.array(*found)))
