"""Quality of images and verdicts on pairs of them as column expressions, with the bounds of ``config``. A missing metric satisfies no bound."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaspan.config import DEFAULTS, Thresholds
from lumaspan.functions import pairs as P

# Formats without loss, and the order of preference among formats.
LOSSLESS = ("PNG", "BMP", "TIFF", "GIF")
PREFERRED = {"PNG": 6, "TIFF": 5, "WEBP": 4, "GIF": 3, "BMP": 2, "JPEG": 1, "JPG": 1}
# The standard quantisation tables of luminance and chrominance, row by row (ITU-T T.81, annex K).
LUMINANCE = """16 11 10 16 24 40 51 61  12 12 14 19 26 58 60 55  14 13 16 24 40 57 69 56  14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77  24 35 55 64 81 104 113 92  49 64 78 87 103 121 120 101  72 92 95 98 112 100 103 99"""
CHROMINANCE_CORNER = "17 18 24 47  18 21 26 66  24 26 56 99  47 66 99 99"  # all else is 99


def is_lossless(fmt: Column, header: Column) -> Column:
    """By format, or a WebP whose first bytes name the lossless coding; an unknown header names none."""
    return F.coalesce(fmt.isin(*LOSSLESS) | ((fmt == "WEBP") & F.coalesce(F.instr(F.hex(F.substring(header, 1, 64)), "5650384C") % 2 == 1, F.lit(False))), F.lit(False))


def bit_depth(mode: Column) -> Column:
    return F.when(mode.contains("16") | mode.isin("I", "F"), 16).otherwise(8)


def is_transparent(alpha: Column) -> Column:
    """Any pixel is not opaque; null alpha is opaque."""
    return F.coalesce(F.exists(alpha, lambda x: x != 255), F.lit(False))


def standard_tables() -> tuple[list[int], list[int]]:
    corner = [int(x) for x in CHROMINANCE_CORNER.split()]
    chroma = [corner[4 * (k // 8) + k % 8] if k // 8 < 4 and k % 8 < 4 else 99 for k in range(64)]
    return [int(x) for x in LUMINANCE.split()], chroma


def expected_tables(base: list[int]) -> list[list[float]]:
    """A standard table as an encoder scales it for each quality from 1 to 100."""
    def scaled(q: int) -> list[float]:
        scale = struct.unpack("f", struct.pack("f", 5000.0 / q))[0] if q < 50 else 200.0 - 2 * q  # an encoder's single precision
        return [min(255.0, max(1.0, float(math.floor((b * scale + 50) / 100)))) for b in base]

    return [scaled(q) for q in range(1, 101)]


def jpeg_quality(tables: Column) -> Column:
    """quality (1 to 100, the first of the nearest), error and quant_mean of an array of quantisation tables in the order of their ids.

    Tables of fewer than 64 values do not count; without any all are null. Sums are exact, so that nearest tables tie as they should. The
    expected tables are constants."""
    kept = F.transform(F.filter(tables, lambda t: F.size(t) >= 64), lambda t: F.slice(t, 1, 64))
    luma, chroma = (F.array(*(F.array(*map(F.lit, t)) for t in expected_tables(base))) for base in standard_tables())
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    off = lambda t, want: total(F.zip_with(t, want, lambda a, b: F.abs(a - b))) / 64

    def found(kept: Column) -> Column:
        errors = F.transform(luma, lambda want, q: total(F.transform(kept, lambda t, i: F.when(i == 0, off(t, want)).otherwise(off(t, F.get(chroma, q))))) / F.size(kept))
        mean = total(F.transform(F.flatten(kept), lambda x: x.cast("double"))) / (64 * F.size(kept))
        best = lambda e: F.struct(F.array_position(e, F.array_min(e)).cast("int").alias("quality"), F.round(F.array_min(e), 6).alias("error"), F.round(mean, 6).alias("quant_mean"))
        return F.get(F.transform(F.array(errors), best), F.lit(0))

    # tables and errors are each computed once a row: in a lambda they are values, not expressions to be computed again
    return F.get(F.transform(F.filter(F.array(kept), lambda k: F.size(k) > 0), found), F.lit(0))


def review_score(similar: Column, blocks: Column) -> Column:
    """From the share of similar pixels and the similarities of 4 x 4 blocks: the twelve best where six or fewer are bad, else all."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)
    bad = F.size(F.filter(blocks, lambda b: b < 0.8))
    return F.when(bad <= 6, 0.4 * similar + 0.6 * mean(F.slice(F.sort_array(blocks, asc=False), 1, 12))).otherwise(0.6 * similar + 0.4 * mean(blocks))


def quality_key() -> Column:
    """What is kept first, compared from left to right; larger is better. Columns: w, h, bit_depth, lossless, jpeg_quant_mean, format, sharpness, noise_sigma, blockiness, size."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PREFERRED.items() for x in kv)), F.col("format")), F.lit(0))
    detail = F.log1p(F.greatest(F.lit(0.0), F.col("sharpness"))) - 0.12 * F.col("noise_sigma") - 0.08 * F.col("blockiness")
    return F.struct(
        (F.col("w").cast("long") * F.col("h")).alias("pixels"), F.col("bit_depth").alias("bit_depth"), F.col("lossless").cast("int").alias("lossless"),
        F.coalesce(-F.col("jpeg_quant_mean"), F.lit(-1000.0)).alias("quant"), rank.alias("rank"), detail.alias("detail"), F.col("size").alias("size"))


def winner_reason(best: Column, next_: Column) -> Column:
    """The first attribute in which a group's best row differs from the next one of another key; both are structs of the rows' columns."""
    a, b = (lambda c: best[c]), (lambda c: next_[c])
    return (
        F.when(next_.isNull(), "only member").when(a("w").cast("long") * a("h") != b("w").cast("long") * b("h"), "more pixels").when(a("bit_depth") != b("bit_depth"), "deeper")
        .when(a("lossless") != b("lossless"), "lossless").when(a("jpeg_quality") != b("jpeg_quality"), "finer quantisation").when(a("format") != b("format"), "preferred format")
        .when(a("noise_sigma") + 0.05 < b("noise_sigma"), "less noise").when(F.abs(a("sharpness") - b("sharpness")) > 1, "more detail").when(a("size") != b("size"), "larger file").otherwise("first path")
    )


def at_least(metric: str, bound: float) -> Column:
    return F.coalesce(F.col(metric) >= bound, F.lit(False))


def at_most(metric: str, bound: float) -> Column:
    return F.coalesce(F.col(metric) <= bound, F.lit(False))


def review_level(t: Thresholds = DEFAULTS, copies: bool = True, structure: bool = True) -> Column:
    """level and score of a pair for review: copy detection, then structure, then the hash alone; null and 0 for none."""
    aspect = at_most("aspect_delta", t.aspect_deep)
    by_copy = F.lit(copies) & at_least("sscd_similarity", t.sscd_review) & aspect
    placed = at_most("hash_distance", t.phash_deep) | at_least("geometric_similarity", t.geometry)
    by_structure = F.lit(structure) & at_least("dino_similarity", t.dino_review) & at_least("edge_similarity", t.edge) & placed & aspect
    both = F.sqrt(F.greatest(F.lit(0.0), F.col("dino_similarity") * F.col("edge_similarity")))
    made = lambda level, score: F.struct(F.lit(level).alias("level"), score.cast("double").alias("score"))
    return F.when(by_copy, made("L1-SSCD", F.col("sscd_similarity"))).when(by_structure, made("L2-structure", both)).when(
        P.review_candidate(), made("L1-pHash", F.col("review_score"))).otherwise(made(None, F.lit(0.0)))


def cheap_gate(t: Thresholds = DEFAULTS, auto: bool = True, copies: bool = True, structure: bool = True) -> Column:
    """Whether a pair could still reach a verdict, from what is known before its pixels are compared: a condition that each verdict implies."""
    near = at_most("hash_distance", t.phash)
    sure = (at_least("sscd_similarity", t.sscd_auto) & near) if copies else F.lit(True)
    equivalent = F.lit(auto) & at_most("aspect_delta", 0.005) & at_most("resolution_ratio", t.max_resolution_ratio) & P.unset("same_size_lossless", "icc_mismatch", "alpha_mismatch") & sure
    deep = at_most("aspect_delta", t.aspect_deep)
    by_copy = F.lit(copies) & at_least("sscd_similarity", t.sscd_review) & deep
    by_structure = F.lit(structure) & at_least("dino_similarity", t.dino_review) & deep
    protected = near & (F.coalesce(F.col("same_size_lossless"), F.lit(False)) | at_most("resolution_ratio", P.SAME_SIZE_RATIO))
    by_hash = at_most("aspect_delta", t.aspect) & (at_most("hash_distance", t.phash_auto) | protected)
    return equivalent | by_copy | by_structure | by_hash
