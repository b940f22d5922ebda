"""Image tables: decoded pixels as arrays, one row per image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.pixels import over_white


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _levels(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Stored bytes (blue first) as interleaved levels, red first; grey stays one plane."""
    def one(raw: bytes, n: int) -> np.ndarray | None:
        if n < 1:
            return None
        flat = np.frombuffer(raw, dtype=np.uint8).astype(np.int32)
        if n == 1:
            return flat
        pixels = flat.reshape(-1, n)
        return pixels[:, [2, 1, 0] + list(range(3, n))].reshape(-1)

    return pd.Series([one(raw, n) for raw, n in zip(data, channels, strict=True)])


def read_images(spark: SparkSession, path: str, pattern: str = "*", strict: bool = True) -> DataFrame:
    """``path, height, width, pixels``: RGB levels, grey replicated, transparency composited over white.
    A file that cannot be decoded fails the query that meets it; without ``strict`` its row has no size and no pixels (see ``broken_images``).
    16-bit files need another reader: Spark's image source keeps one byte per channel."""
    source = spark.read.format("image").option("pathGlobFilter", pattern).option("dropInvalid", False).load(path)
    image = source.select(
        F.regexp_replace("image.origin", "^file:/+", "/").alias("path"),
        F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), _levels("image.data", "image.nChannels").alias("levels"),
    )
    if strict:
        broken = F.raise_error(F.concat(F.lit("cannot decode "), F.col("path"))).cast("int")
        image = image.withColumn("channels", F.when(F.col("channels") > 0, F.col("channels")).otherwise(broken))
    size = {c: F.when(F.col("channels") > 0, F.col(c)).alias(c) for c in ("height", "width", "levels")}
    image = image.select("path", "channels", *size.values())
    grey = F.flatten(F.transform("levels", lambda v: F.array(v, v, v)))
    rgb = F.when(F.col("channels") == 1, grey).when(F.col("channels") == 4, over_white(F.col("levels"))).otherwise(F.col("levels"))
    return image.select("path", "height", "width", rgb.alias("pixels"))


def broken_images(images: DataFrame) -> DataFrame:
    """Files that could not be decoded, as violations of a manifest."""
    return images.where(F.col("pixels").isNull()).select(
        F.lit("broken_image").alias("rule"), F.lit("image_path").alias("column"), F.col("path").alias("value")
    )


def resized_sides(height: int, width: int, size: int) -> tuple[int, int]:
    """The shorter side becomes ``size``, the other keeps the aspect, truncated."""
    if height <= width:
        return size, int(size * width / height)
    return int(size * height / width), size


def axis_weights(n_in: int, n_out: int) -> np.ndarray:
    """Triangle-filter weights of one axis; the filter widens when shrinking, so that no pixel is skipped."""
    scale = n_in / n_out
    reach = max(scale, 1.0)
    centre = (np.arange(n_out)[:, None] + 0.5) * scale
    weights = np.clip(1.0 - np.abs((np.arange(n_in)[None, :] + 0.5 - centre) / reach), 0.0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(df: DataFrame, size: int, channels: int) -> DataFrame:
    """Bilinear resize of ``pixels`` (flat, interleaved, ``height`` x ``width``) to a shorter side of ``size``.
    Values stay real numbers; round them afterwards where levels are wanted."""
    names = df.columns
    schema = T.StructType([
        T.StructField(f.name, {"pixels": T.ArrayType(T.DoubleType()), "height": T.IntegerType(), "width": T.IntegerType()}
                      .get(f.name, f.dataType)) for f in df.schema.fields
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pixels, sides = [], []
            for flat, h, w in zip(batch["pixels"], batch["height"], batch["width"], strict=True):
                new_h, new_w = resized_sides(int(h), int(w), size)
                image = np.asarray(flat, dtype=float).reshape(int(h), int(w), channels)
                image = np.einsum("ab,bwc->awc", axis_weights(int(h), new_h), image)
                image = np.einsum("ab,hbc->hac", axis_weights(int(w), new_w), image)
                pixels.append(image.reshape(-1))
                sides.append((new_h, new_w))
            done = batch.assign(pixels=pixels, height=[s[0] for s in sides], width=[s[1] for s in sides])
            yield done[names]

    return df.mapInPandas(run, schema)
