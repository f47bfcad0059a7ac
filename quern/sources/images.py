"""Decoded images: Spark's image source reads the files, NumPy lays the pixels out."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: Fixed value: images with fewer rows or columns are refused.
LEAST_SIDE = 32


def planes(data: bytes, height: int, width: int, channels: int, size: tuple[int, int] | None = None) -> np.ndarray:
    """(3, rows, columns) in the order blue, green, red: grey is repeated, a fourth channel left out. ``size`` is (columns, rows), filled by the nearest pixel."""
    picture = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    picture = picture.repeat(3, axis=2) if channels == 1 else picture[:, :, :3]
    if size:
        columns, rows = size
        picture = picture[np.arange(rows) * height // rows][:, np.arange(columns) * width // columns]
    return picture.transpose(2, 0, 1)


def _place(path: Column) -> Column:
    """A path with one slash after its scheme, however many were written."""
    return F.regexp_replace(path, "^([A-Za-z0-9.+-]+):/+", "$1:/")


def decoded(spark: SparkSession, root: str, contains: str = "", size: tuple[int, int] | None = None, keep_bytes: bool = False) -> DataFrame:
    """(index, path, height, width, pixels, problem) of the images that ``tables.images`` finds under ``root``, numbered as there.

    ``pixels`` has three planes, blue, green and red, each by rows: floats from 0 to 1, or with ``keep_bytes`` bytes. Where a file
    cannot be decoded or is smaller than 32 pixels, ``problem`` says so and height, width and pixels are null.
    """
    names = tables.images(spark, root, contains).select("index", "path", _place(F.col("path")).alias("place"))
    read = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,JPG,png,PNG}").load(root)
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))  # the image source encodes paths, the other does not
    found = names.join(read.select(_place(origin).alias("place"), "image.height", "image.width", "image.nChannels", "image.data"), "place").drop("place")
    kind, form = (pa.binary(), "binary") if keep_bytes else (pa.list_(pa.float32()), "array<float>")

    def run(batches):
        for batch in batches:
            rows = []
            for index, path, h, w, c, data in zip(*(batch.column(n).to_pylist() for n in ("index", "path", "height", "width", "nChannels", "data")), strict=True):
                if h < LEAST_SIDE or w < LEAST_SIDE:
                    rows.append((index, path, None, None, None, "not decoded" if h < 0 else f"too small: {h} x {w}"))
                    continue
                p = planes(data, h, w, c, size)
                rows.append((index, path, p.shape[1], p.shape[2], p.tobytes() if keep_bytes else (p / 255.0).astype(np.float32).reshape(-1), None))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), kind, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["index", "path", "height", "width", "pixels", "problem"])

    return found.mapInArrow(run, f"index long, path string, height int, width int, pixels {form}, problem string")


def _levels(pixels: Column, i: Column, plane: int, area: Column) -> Column:
    return F.round(F.get(pixels, i + plane * area) * 255).cast("int")


def _masks(images: DataFrame, hit) -> DataFrame:
    area, p = F.col("height") * F.col("width"), F.col("pixels")
    return images.withColumn("mask", F.transform(F.sequence(F.lit(0), area - 1), lambda i: hit(lambda plane: _levels(p, i, plane, area)).cast("int")))


def class_masks(images: DataFrame, value: int) -> DataFrame:
    """``mask`` of decoded annotations (floats): 1 where the first plane has ``value``; null without pixels."""
    return _masks(images, lambda level: level(0) == value)


def colour_masks(images: DataFrame, colours: Sequence[tuple[int, int, int]]) -> DataFrame:
    """``mask`` of decoded annotations (floats): 1 where the pixel is one of the colours, each in the order of the planes; null without pixels."""

    def hit(level) -> Column:
        found = F.lit(False)
        for colour in colours:
            found = found | ((level(0) == colour[0]) & (level(1) == colour[1]) & (level(2) == colour[2]))
        return found

    return _masks(images, hit)


def frames(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(index, height, width, pixels, mask): decoded images beside the masks with their number."""
    return images.select("index", "height", "width", "pixels").join(masks.select("index", "mask"), "index")
