"""Detection and pose over DataFrames of images.

Images are rows, and every image is read by one task from start to end: nothing is shuffled, and a task holds one Arrow
batch of images. ``with_batches`` makes batches small where images are large.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..kernel import pose as pose_kernel
from ..kernel.detecting import Config, Detector
from ..kernel.pixels import luma_rgba
from ..schemas import DETECTION, IMAGE, POSE

MAX_SIDE = 32_767


def gray_images(df: DataFrame, id_col: str = "image_id", width: str = "width", height: str = "height", data: str = "data", stride: str | None = None) -> DataFrame:
    """Raw gray buffers as images; rows whose buffer doesn't fit their size are refused when they are read."""
    step = F.col(stride) if stride else F.col(width)
    fits = (F.length(data) >= step * F.col(height)) & (step >= F.col(width)) & F.col(width).between(0, MAX_SIDE) & F.col(height).between(0, MAX_SIDE)
    checked = F.when(fits, F.col(data)).otherwise(F.raise_error(F.concat(F.lit("the buffer of image "), F.col(id_col).cast("string"), F.lit(" doesn't fit its size"))))
    return df.select(F.col(id_col).cast("string").alias("image_id"), F.col(width).cast("int").alias("width"), F.col(height).cast("int").alias("height"), step.cast("int").alias("stride"), checked.alias("data"))


def rgba_images(df: DataFrame, id_col: str = "image_id", width: str = "width", height: str = "height", data: str = "data") -> DataFrame:
    """RGBA buffers as gray images."""

    @F.pandas_udf("binary")
    def gray(raw: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else luma_rgba(r, a, b).tobytes() for r, a, b in zip(raw, w, h, strict=True)])

    return gray_images(df.withColumn("__q_gray", gray(data, width, height)), id_col, width, height, "__q_gray")


def pixels_of(data: bytes, width: int, height: int, stride: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)[:, :width]


def with_batches(df: DataFrame, images: int = 16) -> DataFrame:
    """Set how many images an Arrow batch holds in df's session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(images))
    return df


def detect(images: DataFrame, config: Config = Config()) -> DataFrame:
    """image_id and the detections of each image, a row for each; images of no bytes have none."""
    names = [f.name for f in StructType.fromDDL(DETECTION)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(config)
        for b in batches:
            ids, found = [], []
            for image_id, width, height, stride, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if data is None:
                    continue
                for d in detector.detect(pixels_of(data, width, height, stride)):
                    ids.append(image_id)
                    found.append(d | {"corners": d["corners"].tolist()})
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.float32(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string())] + [pa.array([d[n] for d in found], k) for n, k in zip(names, kinds, strict=True)], ["image_id", *names])

    cols = [f.name for f in StructType.fromDDL(IMAGE)]
    return images.select(*cols).mapInArrow(run, f"image_id string, {DETECTION}")


def per_image(images: DataFrame, detections: DataFrame) -> DataFrame:
    """A row for each image: its id, size and array of detections."""
    fields = [f.name for f in StructType.fromDDL(DETECTION)] + [c for c in ("pose",) if c in detections.columns]
    listed = detections.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("detections"))
    sizes = images.select("image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    return sizes.join(listed, "image_id", "left").withColumn("detections", F.coalesce("detections", F.array().cast(listed.schema["detections"].dataType)))


def _poses():
    schema = StructType.fromDDL(POSE)

    @F.pandas_udf(schema)
    def run(corners: pd.Series, s: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        cameras = np.stack([x.to_numpy(float, na_value=np.nan) for x in (s, a, b, c, d)])
        known = [q is not None and len(q) == 4 and all(x is not None and len(x) == 2 and not any(v is None for v in x) for x in q) for q in corners]
        at = np.flatnonzero(np.array(known, bool) & np.isfinite(cameras).all(0))
        flat = lambda v: None if v is None else np.ravel(v).tolist()
        rows = [dict.fromkeys(schema.names)] * len(corners)
        if len(at):
            shapes = np.array([[list(x) for x in corners.iloc[i]] for i in at], float)
            for i, found in zip(at, pose_kernel.estimate_all(shapes, dict(zip(("tagsize", "fx", "fy", "cx", "cy"), cameras[:, at], strict=True))), strict=True):
                rows[i] = {k: flat(v) if "tion" in k else v for k, v in found.items()}
        return pd.DataFrame(rows, columns=schema.names)

    return run


def estimate_pose(detections: DataFrame, tagsize="tagsize", fx="fx", fy="fy", cx="cx", cy="cy") -> DataFrame:
    """detections and their ``pose``, by camera columns or numbers. A pose's fields are null where corners or camera
    numbers are."""
    num = lambda v: F.col(v).cast("double") if isinstance(v, str) else F.lit(float(v))
    return detections.withColumn("pose", _poses()("corners", *map(num, (tagsize, fx, fy, cx, cy))))


def register_sql(spark) -> None:
    """Give SQL the functions estimate_tag_pose(corners, tagsize, fx, fy, cx, cy) and yaw_correction(rotation,
    translation), and the views marker_families and marker_codes."""
    from ..sources import families

    spark.udf.register("estimate_tag_pose", _poses())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION yaw_correction(r ARRAY<DOUBLE>, t ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN array(t[0] * cos(atan2(r[2], r[0])) + t[2] * sin(atan2(r[2], r[0])), t[1], t[2] * cos(atan2(r[2], r[0])) - t[0] * sin(atan2(r[2], r[0])))")
    families.families(spark).createOrReplaceTempView("marker_families")
    families.codes(spark).createOrReplaceTempView("marker_codes")


def yaw_correction(rotation, translation):
    """The translation turned back by the yaw of the rotation (nine numbers by rows), as a column."""
    r, t = (F.col(v) if isinstance(v, str) else v for v in (rotation, translation))
    yaw = F.atan2(r[2], r[0])
    return F.array(t[0] * F.cos(yaw) + t[2] * F.sin(yaw), t[1], t[2] * F.cos(yaw) - t[0] * F.sin(yaw))
