"""Measures of pixels: share of green, and difference hashes. Pictures are decoded in the JVM by Spark's image source
(`spark.read.format("image")`) or come as bytes; the arithmetic is numpy on whole pictures, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType

from granary.functions.text import path_stem

#: Hues (of 180), saturation and value (of 255) that count as green; the least share; the longest side measured.
HUES, SATURATION, VALUE, LEAST_SHARE, LONGEST = (35, 85), 50, 30, 0.20, 512


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Pictures below a path: img, path, height, width, channels, data (rows of blue, green, red). Unreadable ones have null
    from height on."""
    files = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(path)
    fine = F.col("image.height") > 0
    cols = [F.when(fine, F.col(f"image.{c}")).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))]
    return files.select(path_stem(F.col("image.origin")).alias("img"), F.col("image.origin").alias("path"), *cols)


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """height x width x 3, blue, green, red; one channel counts three times, a fourth is left out."""
    x = np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, :3]


def averaged(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """A smaller picture: each new pixel is the mean of the area that it covers, parts of old pixels included."""
    for axis, size in ((0, height), (1, width)):
        old = x.shape[axis]
        edges = np.arange(size + 1) * (old / size)
        sums = np.concatenate([np.zeros_like(np.take(x, [0], axis), np.float64), np.cumsum(x, axis=axis, dtype=np.float64)], axis=axis)
        whole = np.minimum(edges.astype(np.int64), old - 1)
        part = (edges - whole).reshape([-1 if k == axis else 1 for k in range(x.ndim)])
        upto = np.take(sums, whole, axis) + part * np.take(x, whole, axis)
        x = np.diff(upto, axis=axis) / (old / size)
    return x


def hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue of 180, saturation and value of 255, rounded as 8-bit pictures have them: reciprocals in units of 1/4096."""
    b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
    v = np.maximum(np.maximum(b, g), r)
    span = v - np.minimum(np.minimum(b, g), r)
    over = lambda top, x: np.where(x > 0, np.rint(top * 4096 / np.maximum(x, 1)), 0).astype(np.int64)
    s = (span * over(255, v) + 2048) >> 12
    turn = np.where(v == r, g - b, np.where(v == g, b - r + 2 * span, r - g + 4 * span))
    h = (turn * over(30, span) + 2048) >> 12
    return np.where(h < 0, h + 180, h), s, v


def green_share(bgr: np.ndarray) -> float:
    """Share of green pixels, of the picture scaled down to LONGEST."""
    long = max(bgr.shape[:2])
    if long > LONGEST:
        scale = LONGEST / long
        bgr = np.rint(averaged(bgr, max(1, int(bgr.shape[0] * scale)), max(1, int(bgr.shape[1] * scale)))).astype(np.uint8)
    h, s, v = hsv(bgr)
    return float(((h >= HUES[0]) & (h <= HUES[1]) & (s > SATURATION) & (v > VALUE)).mean())


def windowed_sinc(old: int, new: int, lobes: int = 3) -> np.ndarray:
    """Weights (new x old) of Lanczos resampling: when a picture shrinks, the window grows by as much."""
    scale = max(1.0, old / new)
    out = np.zeros((new, old))
    for k in range(new):
        centre = (k + 0.5) * old / new
        low, high = max(0, int(centre - lobes * scale + 0.5)), min(old, int(centre + lobes * scale + 0.5))
        x = (np.arange(low, high) + 0.5 - centre) / scale
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
        out[k, low:high] = w / w.sum()
    return out


def difference_bits(bgr: np.ndarray, size: int = 8) -> np.ndarray:
    """size x size bits: whether a pixel of the grey picture of size rows and size + 1 columns is brighter than the one to
    its left."""
    b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
    # The weights of red, green and blue in grey, in units of 1/65536.
    grey = (19595 * r + 38470 * g + 7471 * b + 32768) >> 16
    byte = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = byte(grey @ windowed_sinc(grey.shape[1], size + 1).T)
    small = byte(windowed_sinc(grey.shape[0], size) @ across)
    return small[:, 1:] > small[:, :-1]


def difference_hash(bgr: np.ndarray) -> int:
    """The bits of difference_bits as a number, the first the highest."""
    out = 0
    for bit in difference_bits(bgr).ravel():
        out = out << 1 | int(bit)
    return out


def _measured(measure: Callable[[np.ndarray], object], data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    out = []
    for d, h, w, c in zip(data, height, width, channels, strict=True):
        fine = d is not None and not any(pd.isna(x) for x in (h, w, c)) and h > 0 and w > 0 and len(d) >= h * w * c
        out.append(measure(pixels(d, int(h), int(w), int(c))) if fine else None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(DoubleType())
def _green(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    return _measured(green_share, data, height, width, channels)


@F.pandas_udf(DecimalType(20, 0))
def _dhash(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    return _measured(lambda x: Decimal(difference_hash(x)), data, height, width, channels)


PICTURE = ("data", "height", "width", "channels")


def green_fraction(picture: tuple[str, str, str, str] = PICTURE) -> Column:
    """The share of green pixels, null for a picture that can't be read."""
    return _green(*[F.col(c) for c in picture])


def dhash(picture: tuple[str, str, str, str] = PICTURE) -> Column:
    """The 64-bit difference hash as decimal(20,0), null for a picture that can't be read."""
    return _dhash(*[F.col(c) for c in picture])


def curated(rows: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Pictures with green (their share) and keep: those that can be read and are green enough."""
    return rows.withColumn("green", green_fraction()).withColumn("keep", F.coalesce(F.col("green") >= least, F.lit(False)))
