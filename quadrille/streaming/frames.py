"""Detection on streams: frames have no state, so the batch operator runs on each micro-batch as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..kernel.detecting import Config
from ..operators.detect import detect
from ..sources.files import to_gray

IMAGE_SOURCE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def image_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Image files that arrive in a folder, as gray images."""
    raw = spark.readStream.format("image").schema(IMAGE_SOURCE).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return to_gray(raw.select("image.*"))


def detect_stream(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    return detect(image_stream(spark, path), config)
