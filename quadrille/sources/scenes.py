"""Synthetic images and their truth as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..kernel import scenes as kernel
from ..schemas import IMAGE, TRUTH


def scenario_table(spark: SparkSession, scenes: list[dict] | None = None) -> DataFrame:
    """Scenarios with their parts as JSON, a row for each."""
    rows = [(s["name"], s["category"], s["width"], s["height"], json.dumps(s), len(s["tags"]), float(s["max_corner_rmse"]), s["max_rotation_error_deg"], s["quad_decimate"]) for s in (catalog.scenarios() if scenes is None else scenes)]
    return spark.createDataFrame(rows, "name string, category string, width int, height int, scene string, n_tags int, max_corner_rmse double, max_rotation_error_deg double, quad_decimate double")


def images(scenarios: DataFrame) -> DataFrame:
    """The scenarios' images, drawn by the tasks that read them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, scene in zip(b.column("name").to_pylist(), b.column("scene").to_pylist(), strict=True):
                img = np.ascontiguousarray(kernel.build(json.loads(scene)))
                h, w = img.shape
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([img.tobytes()], pa.binary())], ["image_id", "width", "height", "stride", "data"])

    return scenarios.select("name", "scene").mapInArrow(run, IMAGE)


def truth(scenarios: DataFrame) -> DataFrame:
    """Where each marker of the scenarios lies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda v: None if v is None else np.ravel(v).tolist()
        for b in batches:
            rows = []
            for name, scene in zip(b.column("name").to_pylist(), b.column("scene").to_pylist(), strict=True):
                for t in map(kernel.truth, json.loads(scene)["tags"]):
                    rows.append({"image_id": name, "family": t["family"], "id": t["id"], "corners": t["corners"].tolist(), "center": flat(t["center"]), "rotation": flat(t["rotation"]), "translation": flat(t["translation"]), "params": t["params"]})
            params = pa.struct([(k, pa.float64()) for k in ("tagsize", "fx", "fy", "cx", "cy")])
            schema = pa.schema([("image_id", pa.string()), ("family", pa.string()), ("id", pa.int32()), ("corners", pa.list_(pa.list_(pa.float64()))), ("center", pa.list_(pa.float64())), ("rotation", pa.list_(pa.float64())), ("translation", pa.list_(pa.float64())), ("params", params)])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return scenarios.select("name", "scene").mapInArrow(run, TRUTH)


def generate_scene(spark: SparkSession, scene: dict) -> DataFrame:
    """One scene ({width, height, background, tags, distortions}) as a row: the image's columns and ``tags``, its truth."""
    whole = {"name": "scene", "category": "made", "max_corner_rmse": 0.0, "max_rotation_error_deg": None, "quad_decimate": None, "distortions": []} | scene
    table = scenario_table(spark, [whole])
    fields = [c for c in truth(table).columns if c != "image_id"]
    listed = truth(table).groupBy("image_id").agg(F.collect_list(F.struct(*fields)).alias("tags"))
    return images(table).join(listed, "image_id", "left")
