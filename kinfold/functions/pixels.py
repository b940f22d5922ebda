"""Pixel expressions over decoded images.

An image is one row. Grey planes are flat row-major arrays; colour images are flat arrays with
interleaved channels. Each expression reads one row only, so none of them shuffles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.fixed import CHANNEL_MEAN, CHANNEL_STD
from kinfold.functions.scores import let


def _limits(values: Column) -> Column:
    return F.struct(F.array_min(values).cast("double").alias("low"), F.array_max(values).cast("double").alias("high"))


def to_byte_range(plane: Column) -> Column:
    """Wide-range values to 0..255 by the image's own minimum and maximum, truncated; a flat image gives 0.
    In single precision, where the maximum reaches exactly 255 after truncation."""
    def scaled(lim: Column) -> Column:
        scale = (F.lit(255.0) / F.when(lim["high"] > lim["low"], lim["high"] - lim["low"])).cast("float")
        low = lim["low"].cast("float")
        return let(scale, lambda f: F.transform(
            plane, lambda v: F.coalesce(F.floor((v.cast("float") - low) * f), F.lit(0)).cast("int")))

    return let(_limits(plane), scaled)


def unit_scale(values: Column) -> Column:
    """(v - min) / (max - min); a flat array gives zeros."""
    def scaled(lim: Column) -> Column:
        span = F.when(lim["high"] > lim["low"], lim["high"] - lim["low"])
        return F.transform(values, lambda v: F.coalesce((v.cast("double") - lim["low"]) / span, F.lit(0.0)))

    return let(_limits(values), scaled)


def over_white(rgba: Column) -> Column:
    """Interleaved RGBA to RGB, composited over white and rounded to whole levels."""
    pixels = F.sequence(F.lit(0), F.floor(F.size(rgba) / 4).cast("int") - 1)

    def blend(p: Column, c: int) -> Column:
        alpha = F.element_at(rgba, p * 4 + 4).cast("double") / 255.0
        level = F.element_at(rgba, p * 4 + 1 + c).cast("double")
        return F.floor(level * alpha + 255.0 * (1.0 - alpha) + 0.5).cast("int")

    return F.flatten(F.transform(pixels, lambda p: F.array(blend(p, 0), blend(p, 1), blend(p, 2))))


def grey_to_rgb(plane: Column) -> Column:
    return F.flatten(F.transform(plane, lambda v: F.array(v, v, v)))


def luminance(rgb: Column) -> Column:
    """ITU-R 601 luma in 16-bit fixed point, one level per pixel."""
    pixels = F.sequence(F.lit(0), (F.size(rgb) / 3 - 1).cast("int"))

    def luma(p: Column) -> Column:
        r, g, b = (F.element_at(rgb, p * 3 + 1 + c).cast("int") for c in range(3))
        return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)

    return F.transform(pixels, luma)


def stretch(levels: np.ndarray, tone: np.ndarray, cut_percent: int) -> np.ndarray:
    """One linear stretch of levels 0..255. The cut points come from the 256 counts of the tone: the levels at which more
    than ``cut_percent`` of its pixels lie behind, from either end. No pixel is sorted."""
    counts = np.bincount(tone, minlength=256)
    cut = len(tone) * cut_percent // 100
    low = int(np.argmax(np.cumsum(counts) > cut))
    high = 255 - int(np.argmax(np.cumsum(counts[::-1]) > cut))
    if high <= low:
        return levels
    scale = 255.0 / (high - low)
    table = np.clip(np.floor(np.arange(256) * scale - low * scale), 0, 255).astype(np.int32)
    return table[levels]


def autocontrast(image: Column, tone: Column, cut_percent: int = 1) -> Column:
    """One linear stretch for all channels. ``tone`` is the luminance plane; ``cut_percent`` of its pixels
    are ignored at each end. Levels are 0..255; a missing image stays missing."""

    def run(images: pa.Array, tones: pa.Array) -> pa.Array:
        out = []
        for levels, plane in zip(images, tones, strict=True):
            if not (levels.is_valid and plane.is_valid and len(plane)):
                out.append(levels.as_py() if levels.is_valid else None)
                continue
            out.append(stretch(levels.values.to_numpy(zero_copy_only=False), plane.values.to_numpy(zero_copy_only=False), cut_percent))
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(image.cast("array<int>"), tone.cast("array<int>"))


def center_crop(image: Column, height: int | Column, width: int | Column, size: int, channels: int = 1) -> Column:
    """The centred size x size window of a flat row-major image with interleaved channels."""
    h, w = (v if isinstance(v, Column) else F.lit(v) for v in (height, width))
    top, left = (F.bround((side - size) / F.lit(2.0), 0).cast("int") for side in (h, w))
    rows = F.sequence(F.lit(0), F.lit(size - 1))
    start = lambda y: (((top + y) * w + left) * channels + 1).cast("int")
    return F.flatten(F.transform(rows, lambda y: F.slice(image, start(y), F.lit(size * channels))))


def normalise_channels(
    rgb: Column, mean: Sequence[float] = CHANNEL_MEAN, std: Sequence[float] = CHANNEL_STD
) -> Column:
    """(v / 255 - mean_c) / std_c on interleaved channels."""
    means, stds = (F.array(*[F.lit(float(v)) for v in values]) for values in (mean, std))
    channels = len(mean)

    def scaled(v: Column, i: Column) -> Column:
        c = (F.pmod(i, F.lit(channels)) + 1).cast("int")
        return (v.cast("double") / 255.0 - F.element_at(means, c)) / F.element_at(stds, c)

    return F.transform(rgb, scaled)
