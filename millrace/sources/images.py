"""Images as Spark image rows (origin, height, width, nChannels, mode, data), colour tables and features.

Pixels are stored blue, green, red. A task holds one image at a time; resizing takes the nearest pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

CELLS = "origin string, height int, width int, nChannels int, data binary"


def read_images(spark: SparkSession, path: str, colour: str = "RGB", size: tuple[int, int] | None = None) -> DataFrame:
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return convert(img, colour, size)


def _pixels(row) -> np.ndarray:
    return np.frombuffer(bytes(row.data), dtype=np.uint8).reshape(row.height, row.width, row.nChannels)


def _grey(px: np.ndarray) -> np.ndarray:
    if px.shape[2] == 1:
        return px
    # fixed values: ITU-R 601 luma weights, for blue, green, red
    return np.round(px[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)[:, :, None]


def _resize(px: np.ndarray, height: int, width: int) -> np.ndarray:
    rows = (np.arange(height) + 0.5) * px.shape[0] // height
    cols = (np.arange(width) + 0.5) * px.shape[1] // width
    return px[rows.astype(int)][:, cols.astype(int)]


def _mode(px: np.ndarray, colour: str) -> np.ndarray:
    if colour == "L":
        return _grey(px)
    return np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px[:, :, :3]


def convert(images: DataFrame, colour: str = "RGB", size: tuple[int, int] | None = None) -> DataFrame:
    """Colour mode RGB or L, optional (height, width)."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                px = _mode(_pixels(row), colour)
                px = _resize(px, *size) if size else px
                yield pd.DataFrame({"origin": [row.origin], "height": [px.shape[0]], "width": [px.shape[1]],
                                    "nChannels": [px.shape[2]], "data": [np.ascontiguousarray(px).tobytes()]})

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(work, CELLS)


def image_facts(images: DataFrame) -> DataFrame:
    """(origin, height, width, mode)"""
    return images.select("origin", "height", "width", F.when(F.col("nChannels") == 1, "L").when(F.col("nChannels") == 3, "RGB")
                         .otherwise("RGBA").alias("mode"))


def colour_histogram(images: DataFrame) -> DataFrame:
    """(channel, level, n) over all images: 256 counts per image and channel, then summed."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, 256), dtype=np.int64)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                px = _mode(_pixels(row), "RGB")
                for i in range(3):
                    total[i] += np.bincount(px[:, :, 2 - i].ravel(), minlength=256)
        ch, lev = np.nonzero(total)
        yield pd.DataFrame({"channel": np.array(list("RGB"))[ch], "level": lev.astype("int32"), "n": total[ch, lev]})

    part = images.select("origin", "height", "width", "nChannels", "data").mapInPandas(work, "channel string, level int, n long")
    return part.groupBy("channel", "level").agg(F.sum("n").alias("n"))


def features(images: DataFrame, how: str = "flatten", size: int | None = None) -> DataFrame:
    """(origin, features array<float>): flatten, scale to [0, 1], resize (224) and scale, grey (64) and flatten."""
    side = size or {"resize": 224, "grey": 64}.get(how)

    def vector(row) -> np.ndarray:
        px = _grey(_pixels(row)) if how == "grey" else _pixels(row)
        px = _resize(px, side, side) if side else px
        flat = (px if px.shape[2] == 1 else px[:, :, 2::-1]).ravel().astype(np.float32)
        return flat if how == "flatten" else flat / 255

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 32):  # few images at a time, vectors can be long
                part = b.slice(i, 32).to_pandas()
                vecs = [vector(r) for r in part.itertuples(index=False)]
                ends = np.concatenate([[0], np.cumsum([len(v) for v in vecs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(vecs))
                yield pa.RecordBatch.from_arrays([pa.array(part["origin"], pa.string()), lists], ["origin", "features"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInArrow(work, "origin string, features array<float>")
