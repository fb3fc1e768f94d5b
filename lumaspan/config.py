"""Thresholds of the near-duplicate analysis and other fixed defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the pair rules; embeddings of the test tables call for lower similarity floors."""

    phash_auto: int = 12
    phash: int = 20
    phash_deep: int = 18
    sscd_candidate: float = 0.60
    sscd_review: float = 0.72
    sscd_auto: float = 0.94
    dino_candidate: float = 0.68
    dino_review: float = 0.82
    edge: float = 0.32
    geometry: float = 0.035
    aspect: float = 0.03
    aspect_deep: float = 0.20
    max_resolution_ratio: float = 4.1
    neighbours: int = 20


DEFAULTS = Thresholds()
