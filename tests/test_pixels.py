"""Pixel measures against plain loops, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspan.operators import pixels as P

KIND = "path string, h int, w int, channels int, pixels binary, extra int"


def test_hash_by_loops():
    g = np.random.default_rng(1).integers(0, 256, (64, 96)).astype(float)
    small = [[round(float(g[2 * y : 2 * y + 2, 3 * x : 3 * x + 3].mean())) for x in range(32)] for y in range(32)]
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / 32)
    wave = lambda k, x: math.cos(math.pi * k * (2 * x + 1) / 64)
    low = [scale(u) * scale(v) * sum(small[y][x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    want = int("".join("1" if c > middle else "0" for c in low), 2)
    assert P.perceptual_hash(g) % (1 << 64) == want


def test_noise_and_blocks_by_loops():
    g = np.random.default_rng(2).integers(0, 256, (17, 24)).astype(float)
    kernel = np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]])
    each = [abs((g[y : y + 3, x : x + 3] * kernel).sum()) for y in range(15) for x in range(22)]
    assert P.noise_sigma(g) == pytest.approx(sum(each) / len(each) * math.sqrt(math.pi / 2) / 6)
    steps = np.kron(np.arange(6).reshape(2, 3) * 20.0, np.ones((8, 8)))
    assert P.blockiness(steps) > 5 and P.blockiness(np.ones((32, 32))) == 0 and P.blockiness(steps[:8]) == 0 and P.noise_sigma(g[:2]) == 0


def test_frame(spark):
    rgb = np.random.default_rng(3).integers(0, 256, (40, 50, 3), np.uint8)
    rows = [("a", 40, 50, 3, rgb.tobytes(), 1), ("b", 40, 50, 3, rgb.tobytes(), 2), ("null", 4, 4, 1, None, 3), ("short", 9, 9, 3, b"abc", 4), (None, 1, 1, 1, b"x", 5), ("none", None, 1, 1, b"x", 6)]
    got = {r.path: tuple(r)[1:] for r in P.measured(spark.createDataFrame(rows, KIND)).collect()}
    assert got["a"] == got["b"] and got["a"][0] == P.perceptual_hash(P.gray_of(rgb.tobytes(), 40, 50, 3))
    assert got["null"] == got["short"] == got["none"] == (None, None, None) and got[None][1:] == (0.0, 0.0)
    assert P.measured(spark.createDataFrame([], KIND)).count() == 0


def test_pixel_hash(spark):
    df = spark.createDataFrame([(2, 1, b"12345678", b"icc"), (2, 1, b"12345678", None), (2, 1, None, None)], "w int, h int, p binary, icc binary")
    got = [r[0] for r in df.select(P.pixel_hash(F.col("w"), F.col("h"), F.col("p"), F.col("icc"))).collect()]
    assert got == [hashlib.sha256(b"2x1|RGBA|" + hashlib.sha256(b"icc").digest() + b"12345678").hexdigest(), hashlib.sha256(b"2x1|RGBA|12345678").hexdigest(), None]
