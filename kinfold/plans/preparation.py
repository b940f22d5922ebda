"""Images to model inputs: the items of a manifest with their decoded images, prepared by one kernel per batch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.fixed import CHANNEL_MEAN, CHANNEL_STD
from kinfold.functions.pixels import stretch
from kinfold.sources.images import axis_weights, resized_sides

#: Decimals to which a resized value is exact before it is rounded to a level, so that halves round alike everywhere.
LEVEL_DECIMALS = 9


def to_rgb(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Levels of an image as height x width x 3: one plane is replicated, transparency is composited over white, and a plane with
    values beyond 0..255 or fractions is scaled to its own range first, in single precision."""
    channels = len(values) // (height * width)
    if channels not in (1, 3, 4) or channels * height * width != len(values):
        raise ValueError(f"{len(values)} values are no image of {height} x {width}")
    if channels == 1 and len(values) and (values.min() < 0 or values.max() > 255 or (values != np.floor(values)).any()):
        plane = values.astype(np.float32)
        low, high = float(plane.min()), float(plane.max())
        values = np.floor((plane - np.float32(low)) * np.float32(255.0 / (high - low))) if high > low else np.zeros(len(plane))
    image = values.astype(np.int64).reshape(height, width, channels)
    if channels == 4:
        alpha = image[:, :, 3:] / 255.0
        return np.floor(image[:, :, :3] * alpha + 255.0 * (1.0 - alpha) + 0.5).astype(np.int64)
    return np.repeat(image, 3, axis=2) if channels == 1 else image


def luminance(image: np.ndarray) -> np.ndarray:
    """ITU-R 601 luma in 16-bit fixed point."""
    return (image @ np.array([19595, 38470, 7471]) + 32768) >> 16


def prepare(
    values: np.ndarray, height: int, width: int, size: int, cut_percent: int | None, mean: Sequence[float] = CHANNEL_MEAN, std: Sequence[float] = CHANNEL_STD
) -> np.ndarray:
    """RGB, stretch, resize of the shorter side to ``size``, centred crop, normalisation: size x size x 3 numbers."""
    image = to_rgb(values, height, width)
    if cut_percent is not None:
        image = stretch(image, luminance(image).ravel(), cut_percent)
    new_height, new_width = resized_sides(height, width, size)
    image = np.einsum("ab,bwc->awc", axis_weights(height, new_height), image.astype(float))
    image = np.einsum("ab,hbc->hac", axis_weights(width, new_width), image)
    top, left = (int(np.rint((side - size) / 2.0)) for side in (new_height, new_width))
    levels = np.floor(np.round(image[top : top + size, left : left + size], LEVEL_DECIMALS) + 0.5)
    return (levels / 255.0 - np.array(mean)) / np.array(std)


def prepare_images(
    items: DataFrame, images: DataFrame, size: int = 224, cut_percent: int | None = 1, strict: bool = True, item: str = "image_path"
) -> DataFrame:
    """The rows of a manifest with ``pixels``: size x size x 3 numbers of the image at its path. ``images`` has ``path, height, width, pixels`` (1, 3 or 4
    interleaved channels); ``cut_percent`` None leaves the contrast alone.

    An item without image, or with one that could not be decoded, fails the query that meets it; without ``strict`` its pixels are NULL.
    Every image is read, joined once and worked off in its Arrow batch; nothing else is shuffled."""
    decoded = images.select(F.col("path").alias("__path"), F.col("height").alias("__h"), F.col("width").alias("__w"), F.col("pixels").cast("array<double>").alias("__v"))
    rows = items.join(decoded, items[item] == decoded["__path"], "left").drop("__path")
    if strict:
        lost = F.raise_error(F.concat(F.lit("no image for "), F.coalesce(F.col(item), F.lit("NULL")))).cast("array<double>")
        rows = rows.withColumn("__v", F.coalesce("__v", lost))

    def run(heights: pa.Array, widths: pa.Array, pixels: pa.Array) -> pa.Array:
        out = []
        for h, w, v in zip(heights, widths, pixels, strict=True):
            known = v.is_valid and h.is_valid and w.is_valid
            out.append(prepare(v.values.to_numpy(zero_copy_only=False), h.as_py(), w.as_py(), size, cut_percent).ravel() if known else None)
        return pa.array(out, pa.list_(pa.float64()))

    prepared = F.arrow_udf(run, "array<double>")(F.col("__h").cast("int"), F.col("__w").cast("int"), "__v")
    return rows.withColumn("pixels", prepared).drop("__h", "__w", "__v")
