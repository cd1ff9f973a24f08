"""Content hashes, perceptual hashes and their distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

SIDE = 64
KEPT = 16
BITS = KEPT * KEPT - 1
DISTANCE = 0.12


def cutoff(distance: float = DISTANCE) -> int:
    """Bits that may differ at a given share of them."""
    return round(distance * BITS)


def words(phash: Column) -> list[Column]:
    """A 32-byte hash as four longs, on which XOR is defined."""
    return [F.conv(F.hex(F.substring(phash, 8 * i + 1, 8)), 16, -10).cast("long") for i in range(4)]


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two hashes given as longs."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def _basis() -> np.ndarray:
    """The first ``KEPT`` cosine vectors of length ``SIDE``, orthonormal."""
    k, n = np.arange(KEPT)[:, None], np.arange(SIDE)[None]
    scale = np.where(k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))
    return scale * np.cos(np.pi * (2 * n + 1) * k / (2 * SIDE))


def perceptual(pixels: np.ndarray) -> np.ndarray:
    """Hashes (n x 32 bytes) of grey images (n x 64 x 64): which low frequencies lie above the
    median of all but the constant one, whose bit is 0."""
    b = _basis()
    low = np.einsum("ki,nij,lj->nkl", b, pixels.astype(np.float64), b).reshape(len(pixels), -1)
    bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
    bits[:, 0] = False
    return np.packbits(bits, axis=1)


def shares(n: int, side: int) -> np.ndarray:
    """What each of n pixels in a row contributes to each of ``side`` equal parts."""
    edges = np.linspace(0, n, side + 1)
    low, high = edges[:-1, None], edges[1:, None]
    at = np.arange(n)[None]
    return np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None) * (side / n)


def grey_square(rgb: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The mean brightness of ``side`` x ``side`` equal parts of an image."""
    grey = rgb[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114]) if rgb.ndim == 3 else rgb.astype(np.float64)
    return shares(grey.shape[0], side) @ grey @ shares(grey.shape[1], side).T


def perceptual_hash(pixels: Column) -> Column:
    """Hash of 64 * 64 grey values in rows; null for null."""

    def run(pixels: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(pixels), dtype=object)
        held = pixels.notna().to_numpy()
        if held.any():
            images = np.stack([np.asarray(p, float).reshape(SIDE, SIDE) for p in pixels[held]])
            out[held] = [h.tobytes() for h in perceptual(images)]
        return out

    return F.pandas_udf(run, T.BinaryType())(pixels)


def content_hash(content: Column) -> Column:
    """BLAKE2b of 128 bits; null for null."""

    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else hashlib.blake2b(c, digest_size=16).digest())

    return F.pandas_udf(run, T.BinaryType())(content)
