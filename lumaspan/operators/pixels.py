"""Measures of decoded images: canonical pixel hash, perceptual hash, blockiness and noise.

Images are rows (path, h, w, channels, pixels): 8 bits a channel, row by row, 1, 3 or 4 channels. Each image is measured
where it lies, no row is moved. Null pixels, sizes that do not fit the pixels and other channel counts give null measures. An empty
table gives an empty result; repeated rows are measured each. Shrinking averages areas and rounds; images under 32 pixels a side are
stretched by the same areas.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, LOW = 32, 8
BLOCK = 8  # pixels of a coded block
LUMA = np.array([0.299, 0.587, 0.114])


def pixel_hash(w: Column, h: Column, rgba: Column, icc: Column) -> Column:
    """SHA-256 of size, mode, the digest of the color profile (none: nothing) and the RGBA bytes; null without pixels."""
    profile = F.when(F.length(icc) > 0, F.unhex(F.sha2(icc, 256))).otherwise(F.lit(b""))
    head = F.encode(F.concat(w.cast("string"), F.lit("x"), h.cast("string"), F.lit("|RGBA|")), "utf-8")
    return F.sha2(F.concat(head, profile, rgba), 256)


def area_weights(n: int, side: int = SIDE) -> np.ndarray:
    """side x n: the share of each of n pixels in each of the equal parts."""
    edge = np.linspace(0, n, side + 1)
    inside = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
    return np.maximum(0, inside) * side / n


def cosines(side: int = SIDE, low: int = LOW) -> np.ndarray:
    """The first rows of the orthonormal cosine transform."""
    k, x = np.arange(low)[:, None], np.arange(side)
    return np.cos(np.pi * k * (2 * x + 1) / (2 * side)) * np.sqrt(np.where(k == 0, 1, 2) / side)


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits, first coefficient highest: is it above the median of all but the first. A signed long."""
    small = np.rint(area_weights(gray.shape[0]) @ gray @ area_weights(gray.shape[1]).T)
    low = (cosines() @ small @ cosines().T).astype(np.float32).ravel()
    return int(np.packbits(low > np.median(low[1:])).view(">i8")[0])


def blockiness(gray: np.ndarray) -> float:
    """How much steeper steps are between blocks of 8 than overall, 0 at least."""
    if min(gray.shape) < 16:
        return 0.0
    across, down = np.abs(np.diff(gray, axis=1)), np.abs(np.diff(gray, axis=0))
    edges = across[:, BLOCK - 1 :: BLOCK].mean() + down[BLOCK - 1 :: BLOCK].mean()
    return float(max(0.0, (edges - across.mean() - down.mean()) / 2))


def noise_sigma(gray: np.ndarray) -> float:
    """Noise by the mean second difference of second differences."""
    if min(gray.shape) < 3:
        return 0.0
    return float(np.abs(np.diff(np.diff(gray, 2, axis=0), 2, axis=1)).mean() * np.sqrt(np.pi / 2) / 6)


def gray_of(pixels: bytes | None, h: int | None, w: int | None, channels: int | None) -> np.ndarray | None:
    if not pixels or not h or not w or h < 0 or w < 0 or channels not in (1, 3, 4) or len(pixels) != h * w * channels:
        return None
    a = np.frombuffer(pixels, np.uint8).reshape(h, w, channels).astype(np.float64)
    return a[:, :, 0] if channels == 1 else np.rint(a[:, :, :3] @ LUMA)


def measured(images: DataFrame, key: str = "path") -> DataFrame:
    """Per row: key, phash long, blockiness double, noise_sigma double."""

    def run(batches):
        for batch in batches:
            grays = (gray_of(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("pixels", "h", "w", "channels")), strict=True))
            got = [(None,) * 3 if g is None else (perceptual_hash(g), blockiness(g), noise_sigma(g)) for g in grays]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *cols], [key, "phash", "blockiness", "noise_sigma"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "h", "w", "channels", "pixels").mapInArrow(run, f"`{key}` {kind}, phash long, blockiness double, noise_sigma double")
