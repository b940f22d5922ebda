import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import pixels as px
from kinfold.sources import images


def one(spark, values, expression, kind="array<int>"):
    df = spark.createDataFrame([(values,)], f"v {kind}")
    return df.select(expression(F.col("v"))).first()[0]


def png(pixels: np.ndarray) -> bytes:
    """A minimal PNG file of an 8-bit grey, RGB or RGBA array."""
    height, width, channels = pixels.shape
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_sixteen_bit_frames_reach_the_full_byte_range(spark):
    frame = np.linspace(0, 40000, 64 * 64).astype(np.uint16).astype(int).tolist()
    out = one(spark, frame, px.to_byte_range)
    assert (min(out), max(out), out[32 * 64]) == (0, 255, 127)
    assert one(spark, [7, 7, 7], px.to_byte_range) == [0, 0, 0]


def test_transparent_pixels_turn_white(spark):
    rgba = [200, 0, 0, 255] + [0, 0, 0, 0] * 15
    out = one(spark, rgba, px.over_white)
    assert out[:3] == [200, 0, 0] and out[3:] == [255] * 45
    assert one(spark, [100, 100, 100, 128], px.over_white) == [177, 177, 177]


def test_autocontrast_stretches_a_dim_ramp(spark):
    ramp = np.tile(np.linspace(100, 120, 50).astype(int), 50).tolist()
    out = one(spark, ramp, lambda v: px.autocontrast(v, v))
    assert (min(out), max(out)) == (0, 255)
    assert one(spark, [9] * 20, lambda v: px.autocontrast(v, v)) == [9] * 20


def test_autocontrast_keeps_the_hue(spark):
    image = np.zeros((40, 40, 3), int)
    image[:] = (225, 215, 185)
    image[10:30, 10:30] = (174, 70, 60)
    out = np.array(one(spark, image.reshape(-1).tolist(), lambda v: px.autocontrast(v, px.luminance(v)))).reshape(40, 40, 3)
    r, g, b = out[20, 20]
    assert r - g > 100 and r - b > 100


def test_unit_scale_and_normalise(spark):
    assert one(spark, [2.0, 4.0, 3.0], px.unit_scale, "array<double>") == [0.0, 1.0, 0.5]
    assert one(spark, [1.0, 1.0], px.unit_scale, "array<double>") == [0.0, 0.0]
    out = one(spark, [0, 255, 128, 255, 0, 0], px.normalise_channels)
    assert out == pytest.approx([-0.485 / 0.229, (1 - 0.456) / 0.224, (128 / 255 - 0.406) / 0.225, (1 - 0.485) / 0.229, -0.456 / 0.224, -0.406 / 0.225])


def test_centre_crop(spark):
    plane = list(range(5 * 7))
    got = one(spark, plane, lambda v: px.center_crop(v, 5, 7, 3))
    assert np.array(got).reshape(3, 3).tolist() == np.arange(35).reshape(5, 7)[1:4, 2:5].tolist()


def test_resize_keeps_aspect_and_is_deterministic(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (80, 100, 3)).reshape(-1).tolist()
    df = spark.createDataFrame([("a", 80, 100, image)], "path string, height int, width int, pixels array<int>")
    first, second = images.resize(df, 64, 3).first(), images.resize(df, 64, 3).first()
    assert (first["height"], first["width"], len(first["pixels"])) == (64, 80, 64 * 80 * 3)
    assert first["pixels"] == second["pixels"]
    flat = spark.createDataFrame([("a", 4, 8, [9] * 32)], "path string, height int, width int, pixels array<int>")
    assert images.resize(flat, 8, 1).first()["pixels"] == pytest.approx([9.0] * 128)


def test_image_scan_orders_channels(spark, tmp_path):
    grey = np.array([[[10], [20]]])
    rgb = np.array([[[1, 2, 3], [4, 5, 6]]])
    rgba = np.array([[[200, 0, 0, 255], [0, 0, 0, 0]]])
    for name, pixels in (("g.png", grey), ("rgb.png", rgb), ("rgba.png", rgba)):
        (tmp_path / name).write_bytes(png(pixels))
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path), "*.png").collect()}
    assert got["g.png"]["pixels"] == [10, 10, 10, 20, 20, 20]
    assert got["rgb.png"]["pixels"] == [1, 2, 3, 4, 5, 6]
    assert got["rgba.png"]["pixels"] == [200, 0, 0, 255, 255, 255]
    assert (got["rgb.png"]["height"], got["rgb.png"]["width"]) == (1, 2)


def test_preparation_equals_its_steps(spark):
    """Stretch, resize, crop and normalisation of a colour image, against the single operators."""
    from kinfold.plans.preparation import prepare_images

    rng = np.random.default_rng(4)
    image = rng.integers(60, 150, (6, 10, 3))
    found = spark.createDataFrame([("a", 6, 10, image.reshape(-1).tolist())], "path string, height int, width int, pixels array<int>")
    items = spark.createDataFrame([("a", 1, 2)], "image_path string, height int, path int")  # names that clash
    got = prepare_images(items, found, size=4, cut_percent=2).first()
    assert (got["height"], got["path"]) == (1, 2)
    toned = found.withColumn("pixels", px.autocontrast(F.col("pixels"), px.luminance(F.col("pixels")), 2))
    resized = images.resize(toned, 4, 3).withColumn("pixels", F.transform("pixels", lambda v: F.floor(F.round(v, 9) + 0.5).cast("int")))
    cropped = resized.select(px.normalise_channels(px.center_crop(F.col("pixels"), F.col("height"), F.col("width"), 4, 3)))
    assert got["pixels"] == pytest.approx(cropped.first()[0])


def test_preparation_of_wide_range_grey_and_transparent_images(spark):
    from kinfold.plans.preparation import prepare, to_rgb

    wide = np.linspace(0, 40000, 16)
    assert to_rgb(wide, 4, 4)[..., 0].ravel().tolist() == [int(np.float32(v) * np.float32(255 / 40000)) for v in wide]
    assert to_rgb(np.full(4, 9.5), 2, 2).max() == 0  # a flat image
    assert to_rgb(np.array([100, 100, 100, 128.0]), 1, 1).tolist() == [[[177, 177, 177]]]
    assert prepare(np.full(12, 255.0), 2, 2, 2, 1).reshape(-1, 3)[0] == pytest.approx([(1 - m) / s for m, s in ((0.485, 0.229), (0.456, 0.224), (0.406, 0.225))])
    with pytest.raises(ValueError, match="no image"):
        to_rgb(np.zeros(7), 2, 2)


def test_a_folder_with_a_broken_file_is_prepared(spark, tmp_path):
    from kinfold.plans.preparation import prepare_images

    rng = np.random.default_rng(1)
    for i, channels in enumerate((1, 3, 4)):
        (tmp_path / f"{i}.png").write_bytes(png(rng.integers(0, 256, (9, 12, channels))))
    (tmp_path / "broken.png").write_bytes(b"no image")
    names = [*[f"{tmp_path}/{i}.png" for i in range(3)], f"{tmp_path}/broken.png", f"{tmp_path}/missing.png"]
    items = spark.createDataFrame([(n, "a") for n in names], "image_path string, species string")
    got = {r["image_path"]: r["pixels"] for r in prepare_images(items, images.read_images(spark, str(tmp_path), "*.png", strict=False), 8, strict=False).collect()}
    assert [None if v is None else len(v) for v in (got[n] for n in names)] == [192, 192, 192, None, None]
    with pytest.raises(Exception, match="no image for"):
        prepare_images(items, images.read_images(spark, str(tmp_path), "*.png", strict=False), 8).collect()


@pytest.mark.parametrize("seed", range(3))
def test_stretch_by_counts_equals_sorting(seed):
    rng = np.random.default_rng(seed)
    tone = rng.integers(0, 256, rng.integers(1, 400)) // (seed + 1)
    for percent in (0, 1, 7, 20):
        ordered, cut = np.sort(tone), len(tone) * percent // 100
        low, high = int(ordered[cut]), int(ordered[len(tone) - 1 - cut])
        want = tone if high <= low else np.clip(np.floor(tone * (255.0 / (high - low)) - low * (255.0 / (high - low))), 0, 255)
        assert px.stretch(tone, tone, percent).tolist() == want.tolist()
