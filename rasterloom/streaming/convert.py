"""Per-pixel conversions on streams. They keep no state, so the batch projection is the stream's too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rasterloom.functions.conversions import Strategy
from rasterloom.operators.convert import convert_pixels
from rasterloom.pixel import PixelType


def read_pixels(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 64) -> DataFrame:
    """Pixel rows from Parquet files as they arrive, a bounded number of files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def convert_stream(pixels: DataFrame, src: str | PixelType, strategy: Strategy, dst: str | PixelType | None = None) -> DataFrame:
    if not pixels.isStreaming:
        raise ValueError("convert_stream takes a stream; use convert_pixels for a table")
    return convert_pixels(pixels, src, strategy, dst)
