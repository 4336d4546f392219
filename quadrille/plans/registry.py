"""All queries of the marker engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checked, kernels, relational
from .sql import Check, Spark


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = spark.newSession()  # its own views, so that queries over other folders don't meet
        for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))):
            session.conf.set(key, value)
        for t in relational.TABLES:
            session.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return session.sql(relational.TEMPLATES[name](Spark))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(n) for n in relational.TEMPLATES} | kernels.QUERIES | checked.QUERIES
ORACLES: dict[str, str] = {n: f(Check) for n, f in relational.TEMPLATES.items()} | kernels.ORACLES | checked.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' numbers decoded as codes, beside the detections of the scenario catalog."""
    decoded = QUERIES["quick_decode_join"](spark, sf_dir).selectExpr("CAST(k AS STRING) AS image_id", "'tag16h5' AS family", "id", "hamming")
    return decoded.unionByName(kernels.detect_catalog(spark, sf_dir).select("image_id", "family", "id", "hamming"))
