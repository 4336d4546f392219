"""Regions of images that are too large for one task: strips are labelled apart and joined where they overlap."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel import regions
from ..kernel.pixels import UNKNOWN
from .detect import pixels_of

STRIP_ROWS = 1024


def strips(images: DataFrame, rows: int = STRIP_ROWS) -> DataFrame:
    """(image_id, width, strip, data): each image's strips of so many rows, with the next one's first row at the end.
    images: ternary ones (0, 127, 255)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image_id, width, height, stride, data in zip(*(b.column(c).to_pylist() for c in ("image_id", "width", "height", "stride", "data")), strict=True):
                if data is None:
                    continue
                img = pixels_of(data, width, height, stride)
                for k, y in enumerate(range(0, height, rows)):
                    part = np.ascontiguousarray(img[y : y + rows + 1]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([image_id]), pa.array([width], pa.int32()), pa.array([k], pa.int32()), pa.array([part], pa.binary())], ["image_id", "width", "strip", "data"])

    return images.select("image_id", "width", "height", "stride", "data").mapInArrow(cut, "image_id string, width int, strip int, data binary")


def components(images: DataFrame, rows: int = STRIP_ROWS) -> DataFrame:
    """(image_id, root, size) of the regions of ternary images: the number of a region's first pixel, and its pixels.

    A strip is a task's work. Of a strip only its regions' sizes and the regions of its two shared rows go on, which one
    task joins for each image: a few numbers for each pixel of a row."""

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image_id, width, strip, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                img = np.frombuffer(data, np.uint8).reshape(-1, width)
                region, _ = regions.label(img)
                first = strip * rows * width
                known, n = img != UNKNOWN, min(rows, len(img))
                roots, sizes = np.unique(region[:n][known[:n]], return_counts=True)
                out = [(first + roots, sizes, np.full(len(roots), -1))]
                # Pixels of a shared row, by number, with the region that either strip sees there.
                for y in [0] * (strip > 0) + [rows] * (len(img) > rows):
                    x = np.flatnonzero(known[y])
                    out.append((first + region[y, x], np.zeros(len(x), np.int64), first + y * width + x))
                root, size, pixel = (np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([image_id] * len(root), pa.string()), pa.array(root), pa.array(size), pa.array(pixel)], ["image_id", "root", "size", "pixel"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        roots, at = np.unique(pdf["root"], return_inverse=True)
        pixel = pdf["pixel"].to_numpy()
        order = np.flatnonzero(pixel >= 0)
        order = order[np.argsort(pixel[order], kind="stable")]
        same = np.flatnonzero(pixel[order][1:] == pixel[order][:-1])
        least = regions.settle(len(roots), at[order][same], at[order][same + 1])
        size = np.bincount(least[at], pdf["size"], len(roots)).astype(np.int64)
        top = np.flatnonzero(least == np.arange(len(roots)))
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "root": roots[top], "size": size[top]})

    found = strips(images, rows).repartition(F.col("image_id"), F.col("strip")).mapInArrow(label, "image_id string, root long, size long, pixel long")
    return found.groupBy("image_id").applyInPandas(join, "image_id string, root long, size long")
