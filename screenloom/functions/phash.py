"""Perceptual hashes (D1, D2, D10, D12, D13): from pixels by a DCT in Arrow batches, from coefficients by column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIDE, KEPT = 32, 8


def dct_matrix(n: int = SIDE) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def bits_of_block(block: Column) -> Column:
    """64 characters 0 and 1: which of 64 coefficients, row by row, exceed their mean."""
    mean = F.aggregate(block, F.lit(0.0), lambda a, x: a + x) / F.size(block)
    # an array of one, so that the mean is computed once and not for each coefficient
    bits = F.transform(F.array(F.struct(block.alias("b"), mean.alias("m"))), lambda s: F.array_join(F.transform(s["b"], lambda x: F.when(x > s["m"], "1").otherwise("0")), ""))
    return F.get(bits, F.lit(0))


def signed(bits: str | Column) -> Column:
    """64 characters 0 and 1 as a BIGINT."""
    return F.conv(bits, 2, -10).cast("long")


def hex_of(bits: str | Column) -> Column:
    """64 characters 0 and 1 as 16 hex digits."""
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))


@F.pandas_udf(StringType())
def phash_of_pixels(pixels: pd.Series) -> pd.Series:
    """Hash of grey images of 32 by 32 values, row by row; null for null or for another size."""
    ok = pixels.map(lambda p: p is not None and len(p) == SIDE * SIDE)
    out = pd.Series([None] * len(pixels), index=pixels.index, dtype=object)
    if ok.any():
        m = dct_matrix()
        images = np.stack([np.asarray(p, float).reshape(SIDE, SIDE) for p in pixels[ok]])
        low = (m @ images @ m.T)[:, :KEPT, :KEPT].reshape(-1, KEPT * KEPT)
        bits = low > low.mean(1, keepdims=True)
        out[ok] = [b.tobytes().hex() for b in np.packbits(bits, axis=1)]
    return out


def content_hash(data: Column) -> Column:
    """First 32 hex digits of the SHA-256."""
    return F.substring(F.sha2(data, 256), 1, 32)


def pixel_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of equal length; null otherwise."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def changed(distance: Column, least: int = 9) -> Column:
    """Whether an action had an effect."""
    return distance >= least
