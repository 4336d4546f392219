"""The Spark operators: detection, evaluation, sources, sinks, streams, and the contract."""

import json
import os
import shutil
import subprocess
import sys
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quadrille import catalog
from quadrille.families import SPECS, Family, family, generate, make_layout, with_codes
from quadrille.kernel import decoding, quads, regions
from quadrille.kernel import scenes as kernel
from quadrille.kernel.detecting import Config, Detector
from quadrille.operators import evaluate
from quadrille.operators.components import components
from quadrille.operators.detect import detect, estimate_pose, gray_images, per_image, register_sql, rgba_images
from quadrille.plans import kernels, registry
from quadrille.plans.relational import TABLES
from quadrille.sources import families, files, scenes
from quadrille.streaming.frames import detect_stream

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: The least tables hold no 64 embeddings, which make an image.
LARGER = {"gray_planes", "bit_samples", "read_codes"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_oracle(spark, name):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01" if name in LARGER else SF
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.sql(registry.ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want) > 0

    def plain(df):
        numbers = lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c.astype(object).where(c.notna(), None).astype(str)
        return df[cols].apply(numbers).fillna(-1e99).sort_values(cols).reset_index(drop=True)

    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


def test_detect_is_the_kernel(spark):
    some = catalog.scenarios("multi-tag")[:2]
    table = scenes.scenario_table(spark, some)
    got = detect(scenes.images(table)).toPandas()
    for s in some:
        want = Detector().detect(kernel.build(s))
        mine = got[got["image_id"] == s["name"]]
        assert sorted(mine["id"]) == sorted(d["id"] for d in want)


def test_report(spark):
    some = catalog.scenarios("perspective")[:3]
    table = scenes.scenario_table(spark, some)
    truth = scenes.truth(table)
    found = detect(scenes.images(table)).join(truth.select("image_id", "params.*"), "image_id")
    results = evaluate.scene_results(truth, estimate_pose(found), poses=True)
    rep = evaluate.report(results, table)
    assert evaluate.totals(rep).first().asDict() == {"total": 3, "passed": 3, "failed": 0}
    assert rep.where("mean_rotation_error_deg IS NULL OR detection_rate < 1").count() == 0
    assert evaluate.subtotals(rep, ["category"]).count() == 2
    assert evaluate.compare(results, results).where("NOT agree").count() == 0


def test_evaluation_of_nothing(spark):
    table = scenes.scenario_table(spark, catalog.scenarios("occlusion"))
    truth = scenes.truth(table)
    nothing = detect(scenes.images(table)).where("false")
    row = evaluate.scene_results(truth, nothing).first()
    assert (row["detection_rate"], row["corner_rmse"], row["detected"], row["false_positives"]) == (0, 0, 0, 0)
    extra = truth.select("image_id", "family", "id", "corners", (truth["id"] * 0).cast("int").alias("hamming"), (truth["id"] * 0.0).cast("float").alias("decision_margin"))
    assert evaluate.false_positives(truth.where("false"), extra).count() == 1


def test_median_time(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5), ("b", 4)], "k string, us long")
    assert sorted(map(tuple, evaluate.median_time(df, ["k"]).collect())) == [("a", 2), ("b", 5)]


def test_dimension_tables(spark):
    assert families.families(spark).count() == 8
    assert families.bits(spark, ["tag36h11"]).count() == 36
    assert families.cells(spark, ["tag16h5"]).where("cell = 'd'").count() == 16
    assert families.codes(spark, ["tag25h9"]).count() == 35


def test_files_and_stream(spark, tmp_path):
    img = kernel.build(catalog.scenarios("baseline")[0])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(files.png(img))
    read = files.read_images(spark, str(tmp_path / "in"))
    row = read.first()
    assert (row["width"], row["height"]) == (300, 300) and bytes(row["data"]) == img.tobytes()
    found = detect(read)
    files.to_json(per_image(read, found), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 1 and lines[0]["detections"][0]["id"] == 0 and lines[0]["image_width"] == 300
    q = detect_stream(spark, str(tmp_path / "in"), Config()).writeStream.format("memory").queryName("frames").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT id FROM frames").collect()[0]["id"] == 0


def test_sinks(spark):
    f = family("tag16h5")
    assert files.code_file(f)[:8] == int(f.codes[0]).to_bytes(8, "little")
    assert files.pgm(np.zeros((2, 3), np.uint8)) == b"P5\n3 2\n255\n" + bytes(6)
    assert files.mosaic_image(f, [0, 1, 2], 2).shape == (18, 18, 4)
    assert files.pdf(f, [0, 1], rows=1).count(b"/Type /Page ") == 2
    images = scenes.images(scenes.scenario_table(spark, catalog.scenarios("occlusion")))
    assert bytes(files.encoded(images).first()["file"])[:2] == b"P5"


def test_buffers(spark):
    img = kernel.build(catalog.scenarios("baseline")[0])
    rgba = np.stack([img, img, img, np.full_like(img, 255)], -1).tobytes()
    df = spark.createDataFrame([("x", 300, 300, bytearray(rgba))], "image_id string, width int, height int, data binary")
    assert bytes(rgba_images(df).first()["data"]) == img.tobytes()
    short = spark.createDataFrame([("x", 300, 300, bytearray(b"1"))], "image_id string, width int, height int, data binary")
    with pytest.raises(Exception, match="doesn't fit"):
        gray_images(short).collect()


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_ids_beyond_the_defaults(spark):
    some = [catalog.scenario("baseline", f"id-{i}", [catalog.tag(150, 150, 50, i)], 2) for i in (150, 586)]
    found = detect(scenes.images(scenes.scenario_table(spark, some))).collect()
    assert sorted((r["image_id"], r["id"]) for r in found) == [("id-150", 150), ("id-586", 586)]
    short, name = family("tagStandard41h12"), "tagStandard41h12"
    whole = with_codes(name, files.code_file(family(name, 1 << 15)))
    assert len(whole.codes) > len(short.codes) + 50
    last = len(whole.codes) - 1
    cells = np.where(whole.render(last) < 0, 255, whole.render(last)).astype(np.uint8)
    img = np.pad(np.kron(cells, np.ones((20, 20), np.uint8)), 60, constant_values=128)
    assert not any(d["id"] == last for d in Detector(Config(families=(name,))).detect(img))
    for config in (Config(families=(whole,)), Config(families=(name,), max_candidates=1 << 15)):
        assert [d["id"] for d in Detector(config).detect(img)] == [last]
    df = spark.createDataFrame([("x", img.shape[1], img.shape[0], img.shape[1], bytearray(img.tobytes()))], "image_id string, width int, height int, stride int, data binary")
    assert [r["id"] for r in detect(df, Config(families=(whole,))).collect()] == [last]
    assert families.codes(spark, [whole]).count() == families.codes(spark, [name], 1 << 15).count() == last + 1
    assert families.families(spark, [whole]).first()["layout"] == "standard"


def test_combo4_is_the_kernels_search(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()
    got = {r["k"]: ((r["i0"], r["i1"], r["i2"], r["i3"]), r["err"]) for r in registry.QUERIES["combo4"](spark, SF).collect()}
    same = 0
    for (k,) in rows:
        q = [(k * m % 40 + a, k * n % 40 + b) for m, a, n, b in ((7, 0, 11, 0), (13, 100, 17, 0), (19, 100, 23, 100), (29, 0, 31, 100))]
        half = lambda v: np.floor(v + 0.5) * 0.5 + 0.5
        x, y = (np.array([half(q[s][c] + (q[(s + 1) % 4][c] - q[s][c]) * j / 12) for s in range(4) for j in range(12)]) for c in (0, 1))
        w = np.array([361.62445840513925 if s % 2 else 256.0 for s in range(4) for _ in range(12)])
        sums = np.concatenate([np.zeros((1, 6)), np.cumsum(np.stack([w * x, w * y, w * x * x, w * x * y, w * y * y, w], 1), 0)])
        four = quads.corners(sums, 10, 0.984807753012208, 10.0)
        assert (four is not None) == (k in got)
        if four is not None:
            lines, mse, _ = quads.fit_lines(quads.moments(sums, four, np.roll(four, -1)))
            same += tuple(four.tolist()) == got[k][0]
            assert abs(mse.sum() - got[k][1]) < 0.02
    assert same > 0.9 * len(rows)


@pytest.mark.parametrize("name", ["combo4", "segment_fits"])
def test_quads_are_searched_without_joins(spark, tmp_path, name):
    """No points or lines of all quads are broadcast; parts without a key have none."""
    assert "Join" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    parts = spark.read.parquet(f"{SF}/part.parquet").limit(5)
    parts.unionByName(parts.withColumn("p_partkey", F.lit(None).cast("bigint"))).write.parquet(str(tmp_path / "part.parquet"))
    assert {r["k"] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} == {r["p_partkey"] for r in parts.collect()}


def test_code_rules_takes_many_orders_at_once(spark, tmp_path):
    """600,000 orders in 36 seconds, which one by one took minutes, with keys that are missing and keys past 32 bits."""
    keys = spark.range(600_000).selectExpr("CASE WHEN id = 7 THEN NULL ELSE id * 9999991 END AS o_orderkey")
    keys.repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    began = time.monotonic()
    rows = registry.QUERIES["code_rules"](spark, str(tmp_path)).agg(F.count("*").alias("n"), F.countDistinct("k").alias("k"), F.sum("energy").alias("energy")).first()
    assert time.monotonic() - began < 36 and (rows["n"], rows["k"]) == (1_199_998, 599_999)
    con = duckdb.connect()
    con.sql("CREATE TABLE orders AS SELECT CASE WHEN i = 7 THEN NULL ELSE i * 9999991 END AS o_orderkey FROM range(590000, 592000) t(i) UNION ALL SELECT NULL")
    want = con.sql(registry.ORACLES["code_rules"]).fetchall()
    got = registry.QUERIES["code_rules"](spark, str(tmp_path)).where(F.col("k").between(590_000 * 9_999_991, 591_999 * 9_999_991)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 4000


def test_detect_shown_leaves_misread_parts_out(spark, tmp_path):
    """Within the markers of suppliers 152 and 992, and in the whole square of 32238's, the other family reads a code."""
    keys = [150, 151, 152, 992, 32238]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE TABLE supplier AS SELECT unnest({keys}::BIGINT[]) AS s_suppkey")
    got = registry.QUERIES["detect_shown"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.ORACLES["detect_shown"]).fetchall())


def test_detections_apart():
    """Touching ones are one marker's, whatever is read; others stay, and so do touching ones by default."""
    scene = {"width": 400, "height": 200, "tags": [catalog.tag(100, 100, 50, 2), catalog.tag(290, 100, 50, 3)]}
    img = kernel.build(scene)
    both = ("tag36h11", "tag25h9")
    assert sorted(d["id"] for d in Detector(Config(families=both, apart=True)).detect(img)) == [2, 3]
    square = np.array([[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]])
    det = lambda fam, i, hamming, at, size=1.0: {"family": fam, "id": i, "hamming": hamming, "decision_margin": 9.0, "corners": square * size + at}
    found = [det("f", 1, 2, 3.0, 0.2), det("g", 5, 0, 0.0), det("f", 1, 2, 30.0), det("g", 6, 1, 0.0)]
    assert [(d["family"], d["id"], d["hamming"]) for d in decoding.apart(found)] == [("g", 5, 0), ("f", 1, 2)]
    assert len(decoding.deduplicate(found)) == 4


def test_whole_sweep_is_registered(spark, monkeypatch):
    seen = []

    def some(session, scenes_, parts=None):
        seen.extend(s["name"] for s in scenes_)
        small = [s for s in scenes_ if s["name"] in ("1tags-single-clean-dec4-500x500", "5tags-mixed-clean-dec2-800x600")]
        return detect_scenes(session, small, parts)

    detect_scenes = kernels.detect_scenes
    monkeypatch.setattr(kernels, "detect_scenes", some)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = registry.QUERIES["sweep"](spark, SF).collect()
    assert sorted(seen) == sorted(r["image_id"] for r in rows) and len(set(seen)) == len(seen) == 294
    assert sum(r["expected"] for r in rows) == sum(len(s["tags"]) for s in catalog.sweep(True))
    assert {r["image_id"]: r["detected"] for r in rows if r["detected"]} == {"1tags-single-clean-dec4-500x500": 1, "5tags-mixed-clean-dec2-800x600": 5}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_render_tags_has_every_id(spark):
    got = {r["family"]: r["count"] for r in registry.QUERIES["render_tags"](spark, SF).groupBy("family").count().collect()}
    assert got == {n: len(family(n).codes) for n in SPECS}


def test_one_marker_found_twice(spark):
    """The better detection is matched and the spare one is the false positive, whichever corner comes first."""
    square = lambda x: [[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 1.0]]
    truth = spark.createDataFrame([("a", "f", 1, square(0.0))], "image_id string, family string, id int, corners array<array<double>>")
    found = spark.createDataFrame([("a", "f", 1, 2, 9.0, square(-5.0)), ("a", "f", 1, 0, 5.0, square(0.0)), ("b", "f", 1, 0, 5.0, square(0.0))], "image_id string, family string, id int, hamming int, decision_margin double, corners array<array<double>>")
    assert evaluate.match(truth, found).first()["found"]["hamming"] == 0
    assert sorted((r["image_id"], r["hamming"]) for r in evaluate.false_positives(truth, found).collect()) == [("a", 2), ("b", 0)]


def test_poses_of_missing_numbers(spark):
    square = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]
    df = spark.createDataFrame([(1, square, 1.0), (2, None, 1.0), (3, square, None), (4, square[:3], 1.0), (5, [[0.0, 0.0]] * 4, 1.0)], "k int, corners array<array<double>>, tagsize double")
    got = {r["k"]: r["pose"] for r in estimate_pose(df, fx=10, fy=10, cx=4.5, cy=4.5).collect()}
    assert got[1]["error"] < 1e-9 and all(got[k]["error"] is None for k in (2, 3, 4)) and got[5]["error"] > 1e300
    register_sql(spark)
    df.createOrReplaceTempView("found_markers")
    again = spark.sql("SELECT estimate_tag_pose(corners, tagsize, 10D, 10D, 4.5D, 4.5D) AS pose FROM found_markers WHERE k = 1").first()["pose"]
    assert again == got[1]
    assert spark.sql("SELECT yaw_correction(array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D), array(1D, 2D, 3D)) AS t").first()["t"] == [1.0, 2.0, 3.0]
    assert spark.sql("SELECT count(*) FROM marker_families").first()[0] == len(SPECS)


def test_images_without_data(spark):
    raw = spark.createDataFrame([("a", 2, 2, 1, bytes(4)), ("b", 2, 2, 1, None)], "origin string, height int, width int, nChannels int, data binary")
    assert {r["image_id"]: r["data"] for r in files.to_gray(raw).collect()} == {"a": bytes(4), "b": None}
    assert detect(files.to_gray(raw)).count() == 0


def test_scene_files(spark, tmp_path):
    row = scenes.generate_scene(spark, {"width": 120, "height": 100, "tags": [catalog.tag(60, 50, 20)]}).first()
    assert (row["width"], row["height"], len(row["data"]), len(row["tags"]), row["tags"][0]["id"]) == (120, 100, 12000, 1, 0)
    table = scenes.scenario_table(spark, catalog.scenarios("multi-tag"))
    files.truth_json(scenes.truth(table), str(tmp_path / "truth"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "truth")).collect()]
    assert {x["file"]: len(x["tags"]) for x in lines} == {s["name"]: len(s["tags"]) for s in catalog.scenarios("multi-tag")}
    files.report_json(spark.createDataFrame([("x", True)], "image_id string, passed boolean"), str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()["value"]) == {"image_id": "x", "passed": True}


def test_families_are_verified_and_searched(spark):
    rows = {r["family"]: r for r in families.verify(spark, ["tag16h5", "tag25h9", "tag36h11", "tagCircle21h7"]).collect()}
    assert all(r["ok"] for r in rows.values()) and rows["tag36h11"]["codes"] == 587 and rows["tag36h11"]["least_distance"] >= 11
    bad = Family("bad", family("tag16h5").layout, 5, 5, np.array([1, 1, 3], np.uint64))
    assert not families.verify(spark, [bad]).first()["ok"]
    lay = make_layout("standard", 9)
    assert (families.search(spark, lay, 10, 10, 40_000, 15_000) == generate(lay, 10, 10, 40_000)).all()


def test_the_rest_works_without_the_text_operators(tmp_path):
    """In a copy without the text operators, and with or without the pipeline, the contract still imports."""
    for i, pipeline in enumerate((True, False)):
        to = tmp_path / str(i)
        shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env=os.environ | {"PYTHONPATH": str(to)})


def test_catalog_names():
    names = {s["name"] for s in catalog.scenarios("noise")}
    assert {f"noise-sigma{s}" for s in (5, 10, 20, 40)} <= names


@pytest.mark.parametrize("rows", [1, 7, 64])
def test_regions_of_strips(spark, rows):
    rng = np.random.default_rng(rows)
    imgs = [rng.choice(np.array([0, 127, 255], np.uint8), (60, 45), p=p) for p in ((0.45, 0.1, 0.45), (0.7, 0.05, 0.25))] + [np.zeros((1, 3), np.uint8), np.full((5, 4), 127, np.uint8)]
    df = spark.createDataFrame([(str(i), a.shape[1], a.shape[0], a.shape[1], a.tobytes()) for i, a in enumerate(imgs)] + [("none", 1, 1, 1, None)], "image_id string, width int, height int, stride int, data binary")
    got = sorted(tuple(r) for r in components(df, rows).collect())
    want = []
    for i, a in enumerate(imgs):
        region, size = regions.label(a)
        want += [(str(i), int(r), int(size[r])) for r in np.unique(region[a != 127])]
    assert got == sorted(want)
