"""Detections against ground truth: joins, aggregates and the pass rule, in DataFrame operators only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = ["image_id", "family", "id"]


def _numbered(truth: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__q_n``, the place among those of one marker in an image: truth by its corners, detections by
    errors, margin and corners. Those of one place belong together."""
    nth = lambda df, *by: df.withColumn("__q_n", F.row_number().over(Window.partitionBy(*MARKER).orderBy(*by)))
    return nth(truth, "corners"), nth(detections, "hamming", F.desc("decision_margin"), "corners")


def match(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Each truth row with the detection of its marker: the k-th of either side belong together; else nulls."""
    left, right = _numbered(truth, detections)
    right = right.select(*MARKER, "__q_n", F.struct(*[c for c in detections.columns if c not in MARKER]).alias("found"))
    return left.join(right, [*MARKER, "__q_n"], "left").drop("__q_n")


def false_positives(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """The detections that match() gives to no truth row."""
    left, right = _numbered(truth, detections)
    return right.join(left.select(*MARKER, "__q_n"), [*MARKER, "__q_n"], "left_anti").drop("__q_n")


def corner_errors(truth_corners: Column, found_corners: Column) -> Column:
    """The four distances between corners, in the turn that has the least sum."""
    turn = lambda k: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.sqrt(F.pow(F.get(F.get(found_corners, (i + k) % 4), F.lit(0)) - F.get(F.get(truth_corners, i), F.lit(0)), 2) + F.pow(F.get(F.get(found_corners, (i + k) % 4), F.lit(1)) - F.get(F.get(truth_corners, i), F.lit(1)), 2)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    options = F.array(*[F.struct(total(turn(k)).alias("total"), F.lit(k).alias("k"), turn(k).alias("errors")) for k in range(4)])
    return F.array_min(options)["errors"]


def rotation_error(a: Column, b: Column) -> Column:
    """Degrees between two rotations of nine numbers."""
    trace = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def translation_error(a: Column, b: Column) -> Column:
    """Distance over the depth of b."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y)
    return F.sqrt(gap) / F.abs(b[2])


def scene_results(truth: DataFrame, detections: DataFrame, poses: bool = False) -> DataFrame:
    """A row for each image of truth: expected, detected, detection_rate, corner_rmse, corner_max, corner_mean,
    false_positives, and with poses the mean rotation and translation errors."""
    matched = match(truth, detections).withColumn("errors", F.when(F.col("found").isNotNull(), corner_errors(F.col("corners"), F.col("found.corners"))))
    if poses:
        known = F.col("found").isNotNull() & F.col("rotation").isNotNull()
        matched = matched.withColumns({"__q_r": F.when(known, rotation_error(F.col("found.pose.rotation"), F.col("rotation"))), "__q_t": F.when(known, translation_error(F.col("found.pose.translation"), F.col("translation")))})
    total = lambda a, f: F.aggregate(a, F.lit(0.0), f)
    sums = [F.count("*").alias("expected"), F.count("found").alias("detected"), F.sum(total(F.col("errors"), lambda x, y: x + y * y)).alias("__q_sq"), F.sum(total(F.col("errors"), lambda x, y: x + y)).alias("__q_sum"), F.max(F.array_max("errors")).alias("__q_max")]
    sums += [F.avg("__q_r").alias("mean_rotation_error_deg"), F.avg("__q_t").alias("mean_translation_error_frac")] if poses else []
    by_image = matched.groupBy("image_id").agg(*sums)
    extra = false_positives(truth, detections).groupBy("image_id").agg(F.count("*").alias("false_positives"))
    n = F.greatest(F.col("detected") * 4, F.lit(1))
    out = by_image.join(extra, "image_id", "left").withColumns({"detection_rate": F.when(F.col("expected") > 0, F.col("detected") / F.col("expected")).otherwise(1.0), "corner_rmse": F.coalesce(F.sqrt(F.col("__q_sq") / n), F.lit(0.0)), "corner_mean": F.coalesce(F.col("__q_sum") / n, F.lit(0.0)), "corner_max": F.coalesce("__q_max", F.lit(0.0)), "false_positives": F.coalesce("false_positives", F.lit(0))})
    return out.drop("__q_sq", "__q_sum", "__q_max")


def report(results: DataFrame, scenarios: DataFrame) -> DataFrame:
    """results and whether each scenario passed: all found, corners close enough, and rotations where they are limited.
    False positives don't fail a scenario."""
    joined = scenarios.select(F.col("name").alias("image_id"), "category", "max_corner_rmse", "max_rotation_error_deg").join(results, "image_id")
    turned = F.col("mean_rotation_error_deg") if "mean_rotation_error_deg" in results.columns else F.lit(None).cast("double")
    ok = (F.col("detection_rate") >= 1) & (F.col("corner_rmse") <= F.col("max_corner_rmse")) & (F.col("max_rotation_error_deg").isNull() | F.coalesce(turned <= F.col("max_rotation_error_deg"), F.lit(True)))
    return joined.withColumn("passed", ok)


def totals(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def subtotals(reports: DataFrame, by: list[str]) -> DataFrame:
    """Totals for each value of each column in by, and over all."""
    return reports.rollup(*by).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.avg("detection_rate").alias("detection_rate"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two detectors' results by image, and whether their rates agree within 0.01."""
    a, b = (df.select("image_id", F.col("detection_rate").alias(f"rate_{s}"), F.col("corner_rmse").alias(f"rmse_{s}")) for df, s in ((left, "left"), (right, "right")))
    return a.join(b, "image_id", "full").withColumn("agree", F.coalesce(F.abs(F.col("rate_left") - F.col("rate_right")) <= 0.01, F.lit(False)))


def median_time(runs: DataFrame, by: list[str], time_col: str = "us") -> DataFrame:
    """The middle run of each group (the upper one of two)."""
    w = Window.partitionBy(*by)
    ranked = runs.withColumns({"__q_k": F.row_number().over(w.orderBy(time_col)), "__q_n": F.count("*").over(w)})
    return ranked.where(F.col("__q_k") == F.floor(F.col("__q_n") / 2) + 1).select(*by, F.col(time_col).alias("median"))
