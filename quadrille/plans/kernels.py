"""Queries that run the image kernels in their tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..families import SPECS, family, generate, make_layout
from ..kernel import pixels, regions
from ..kernel.detecting import Config
from ..kernel.scenes import uniform
from ..operators import evaluate
from ..operators.components import components
from ..operators.detect import detect, estimate_pose, with_batches
from ..sources import scenes


def detect_scenes(spark: SparkSession, some: list[dict], parts: int | None = None) -> DataFrame:
    """Detections of scenes, each with the families and the decimation that it is for; parts: the most partitions of
    those that are read alike, the default parallelism if not given."""
    by: dict[tuple, list[dict]] = {}
    for s in some:
        by.setdefault((tuple(dict.fromkeys(t["family"] for t in s["tags"])), s["quad_decimate"] or 2.0), []).append(s)
    out = None
    for (names, decimate), group in by.items():
        table = scenes.scenario_table(spark, group).repartition(min(len(group), parts or spark.sparkContext.defaultParallelism))
        found = detect(scenes.images(table), Config(families=names, quad_decimate=decimate))
        out = found if out is None else out.unionByName(found)
    return out


def detect_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_scenes(spark, catalog.scenarios())


def report_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = scenes.scenario_table(spark)
    return evaluate.report(evaluate.scene_results(scenes.truth(table), detect_scenes(spark, catalog.scenarios())), table)


def pose_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = catalog.scenarios("perspective")
    truth = scenes.truth(scenes.scenario_table(spark, some)).select("image_id", "params.*")  # one row for each of the catalog's scenes
    found = estimate_pose(detect_scenes(spark, some).join(F.broadcast(truth), "image_id"))
    return found.select("image_id", "family", "id", F.round("pose.error", 6).alias("error"), F.round("pose.alt_error", 6).alias("alt_error"))


def sweep_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole quick sweep."""
    return _sweep(spark, catalog.sweep())


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sweep."""
    return _sweep(spark, catalog.sweep(True))


def _sweep(spark: SparkSession, some: list[dict]) -> DataFrame:
    """The largest images have 24 million pixels, so a task has about one scene, a batch one image."""
    session = spark.newSession()  # its own batches
    # Two sizes have 25 markers: the size makes names, by which images are joined, differ.
    some = [s | {"name": f"{s['name']}-{s['width']}x{s['height']}"} for s in some]
    table = with_batches(scenes.scenario_table(session, some), 1)
    return evaluate.scene_results(scenes.truth(table), detect_scenes(session, some, len(some)))


def gen_codes_21h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = generate(make_layout("circle", 9), 7, 10)
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "id int, code long")


def render_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code of every family that family() gives."""
    rows = [(f.name, i, f.rgba(i)) for f in map(family, SPECS) for i in range(len(f.codes))]
    return spark.createDataFrame(rows, "family string, id int, rgba binary")


def noise_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first uniform draws of eight seeds."""

    @F.pandas_udf("array<double>")
    def draws(seed: pd.Series) -> pd.Series:
        return pd.Series([uniform(64, int(s)).tolist() for s in seed])

    return spark.range(8).select(F.col("id").alias("seed"), F.posexplode(draws("id")).alias("n", "u"))


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the 8 x 8 images that embeddings make, by their first pixel and size."""
    value = lambda e: F.when(F.abs(e.cast("double")) * 1000 % 3 >= 2, 127).when(e > 0, 255).otherwise(0).cast("int")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("img"), F.transform("embedding", value).alias("v"))

    def size(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for image, v in zip(b.column("img").to_pylist(), b.column("v").to_pylist(), strict=True):
                img = np.array(v, np.uint8).reshape(-1, 8)
                region, sizes = regions.label(img)
                out += [(image, int(r), int(sizes[r])) for r in np.unique(region[img != pixels.UNKNOWN])]
            cols = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["img", "root", "size"])

    return rows.mapInArrow(size, "img long, root long, size long")


def component_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same regions, of strips of three rows that are labelled apart."""
    value = "CASE WHEN abs(CAST(e AS DOUBLE)) * 1000 % 3 >= 2 THEN 127 WHEN e > 0 THEN 255 ELSE 0 END"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id", f"transform(embedding, e -> {value}) AS v")

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, np.uint8).tobytes())

    images = rows.select(F.col("vec_id").cast("string").alias("image_id"), *(F.lit(8).alias(c) for c in ("width", "height", "stride")), packed("v").alias("data"))
    return components(images, 3).select(F.col("image_id").cast("long").alias("img"), "root", "size")


COMPONENTS_SQL = """
WITH RECURSIVE px AS (SELECT vec_id AS img, pos AS p, pos // 8 AS y, pos % 8 AS x, CASE WHEN abs(CAST(e AS DOUBLE)) * 1000 % 3 >= 2 THEN 127 WHEN e > 0 THEN 255 ELSE 0 END AS v
    FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS e FROM embeddings) s),
nb AS (SELECT a.img, a.p, b.p AS q FROM px a JOIN px b ON a.img = b.img AND a.v = b.v AND a.v <> 127 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (abs(a.x - b.x) + abs(a.y - b.y) = 1 OR (a.v = 255 AND a.p <> b.p))),
reach AS (SELECT img, p, p AS low FROM px WHERE v <> 127 UNION SELECT r.img, r.p, nb.q FROM reach r JOIN nb ON nb.img = r.img AND nb.p = r.low WHERE nb.q < r.p OR nb.q > r.p),
rt AS (SELECT img, p, min(low) AS root FROM reach GROUP BY img, p)
SELECT img, root, count(*) AS size FROM rt GROUP BY img, root
"""


def bench_images(spark: SparkSession, n: int) -> DataFrame:
    """n clean and noisy 640 x 480 scenes with five markers each."""
    some = []
    for i in range(n):
        tags = [catalog.tag(x, y, 40, (i + k) % 100, theta=0.1 * k) for k, (x, y) in enumerate(catalog.grid(5, 640, 480, 60))]
        chain = [{"kind": "noise", "sigma": 10.0, "seed": i}] if i % 2 else []
        some.append(catalog.scenario("bench", f"bench-{i}", tags, 5, (640, 480), chain))
    return scenes.images(scenes.scenario_table(spark, some).repartition(4 * spark.sparkContext.defaultParallelism))


QUERIES = {"detect_catalog": detect_catalog, "report_catalog": report_catalog, "pose_catalog": pose_catalog, "sweep_small": sweep_small, "sweep": sweep, "gen_codes_21h7": gen_codes_21h7, "render_tags": render_tags, "noise_lcg": noise_lcg, "component_sizes": component_sizes, "component_strips": component_strips}
ORACLES = {"component_sizes": COMPONENTS_SQL, "component_strips": COMPONENTS_SQL}
