"""Where images come from and where they go: values, raw bytes, generators, and byte sinks."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.errors import LengthMismatch, PixelTypeError
from rasterloom.frame import KEYS, ImageFrame, bound, grid
from rasterloom.joins import small
from rasterloom.operators.arrays import arrays, samples
from rasterloom.pixel import PixelType, pixel_type


def _told(what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"LengthMismatch: {what} of image "), F.col("image_id").cast("string")))


def from_rows(spark: SparkSession, rows: Iterable[tuple], pixel: str | PixelType) -> ImageFrame:
    """Literal images: (image_id, width, height, values), values being numbers or tuples of channels in raster order."""
    p, out = pixel_type(pixel), []
    for image_id, width, height, values in rows:
        data = [v if isinstance(v, tuple | list) else (v,) for v in values]
        if len(data) != width * height:
            raise LengthMismatch(f"image {image_id}: {len(data)} pixels for {width} x {height}")
        if any(len(v) != len(p.channels) for v in data):
            raise PixelTypeError(f"image {image_id}: pixels do not have the channels of {p.name}")
        out.append((image_id, width, height, *([v[k] for v in data] for k in range(len(p.channels)))))
    kind = "string" if out and isinstance(out[0][0], str) else "bigint"
    loose = "array<decimal(20,0)>" if p.channel.name == "u64" else f"array<{p.sql}>"
    if p.channel.name == "u64":
        from decimal import Decimal

        out = [(*r[:3], *([Decimal(v) for v in c] for c in r[3:])) for r in out]
    if p.sql in ("float", "double"):
        out = [(*r[:3], *([float(v) for v in c] for c in r[3:])) for r in out]
    schema = f"image_id {kind}, width int, height int, " + ", ".join(f"{c} {loose}" for c in p.channels)
    return ImageFrame(spark.createDataFrame(out, schema), p)


def from_table(df: DataFrame, pixel: str | PixelType) -> ImageFrame:
    """Images in a table that has the columns already; an image whose arrays do not fit its size fails the query."""
    frame = ImageFrame.of(df, pixel)
    fits = [F.size(c) == F.col("width") * F.col("height") for c in frame.pixel.channels]
    checked = {c: F.when(ok, F.col(c)).otherwise(_told("the pixels").cast(df.schema[c].dataType)) for c, ok in zip(frame.pixel.channels, fits, strict=True)}
    return frame.with_channels(checked, frame.pixel)


def generate(images: DataFrame, pixel: str | PixelType, value: Callable[[Column, Column], Column | tuple[Column, ...]]) -> ImageFrame:
    """Images of the sizes in `images` (image_id, width, height) with value(x, y) at each pixel."""
    p = pixel_type(pixel)

    def part(k: int) -> Column:
        def at(x: Column, y: Column) -> Column:
            v = value(x, y)
            return (v[k] if isinstance(v, tuple) else v).cast(p.sql)

        return grid(F.col("width"), F.col("height"), at)

    return ImageFrame(images.select(*KEYS, *(part(k).alias(c) for k, c in enumerate(p.channels))), p)


def fill(images: DataFrame, pixel: str | PixelType, *value: float) -> ImageFrame:
    p = pixel_type(pixel)
    if len(value) != len(p.channels):
        raise PixelTypeError(f"{p.name} has {len(p.channels)} channels")
    n = F.col("width") * F.col("height")
    return ImageFrame(images.select(*KEYS, *(F.array_repeat(F.lit(v).cast(p.sql), n).alias(c) for v, c in zip(value, p.channels, strict=True))), p)


def zero(images: DataFrame, pixel: str | PixelType) -> ImageFrame:
    p = pixel_type(pixel)
    return fill(images, p, *([False if p.sql == "boolean" else 0] * len(p.channels)))


def _dtype(p: PixelType, order: str) -> np.dtype:
    return np.dtype(p.channel.code if p.channel.nbytes == 1 else {"little": "<", "big": ">", "native": "="}[order] + p.channel.code)


def from_bytes(rows: DataFrame, pixel: str | PixelType, order: str = "native") -> ImageFrame:
    """Images from rows (image_id, width, height, data) with interleaved pixels in `data`, a BINARY.

    Decoded with numpy on Arrow batches. A buffer of the wrong length fails the query.
    """
    p = pixel_type(pixel)
    dtype, n = _dtype(p, order), len(p.channels)
    own = rows.select(*KEYS, "data")
    schema = T.StructType([*own.schema.fields[:3], *(T.StructField(c, T.ArrayType(T._parse_datatype_string(p.sql))) for c in p.channels)])

    def run(batches):
        for batch in batches:
            parts = []
            for image_id, width, height, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if len(data) != width * height * p.nbytes:
                    raise LengthMismatch(f"LengthMismatch: {len(data)} bytes of image {image_id}, {width} x {height} {p.name}")
                parts.append(np.frombuffer(data, dtype=dtype).astype(dtype.newbyteorder("=")).reshape(-1, n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(arrays([v[:, k] for v in parts], p.sql) for k in range(n))], names=[f.name for f in schema.fields])

    return ImageFrame(own.mapInArrow(run, schema), p)


def to_bytes(frame: ImageFrame, order: str = "native") -> DataFrame:
    """image_id, width, height, data: interleaved pixels as a BINARY, in the byte order asked for."""
    p = frame.pixel
    dtype, own = _dtype(p, order), frame.df.select(*KEYS, *p.channels)
    schema = T.StructType([*own.schema.fields[:3], T.StructField("data", T.BinaryType())])

    def run(batches):
        for batch in batches:
            joined = np.stack([samples(batch.column(3 + k)) for k in range(len(p.channels))], axis=1).astype(dtype)
            ends = np.cumsum([0, *(w * h for w, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))]).tolist()
            out = [joined[a:b].tobytes() for a, b in itertools.pairwise(ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, type=pa.binary())], names=[f.name for f in schema.fields])

    return own.mapInArrow(run, schema)


def read_raw(spark: SparkSession, path: str, pixel: str | PixelType, width: int, height: int, order: str = "native") -> ImageFrame:
    """Files of raw pixels, one image a file, all of one size; image_id is the path."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select(F.col("path").alias("image_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.col("content").alias("data"))
    return from_bytes(rows, pixel, order)


def read_raw_sized(spark: SparkSession, path: str, sizes: DataFrame, pixel: str | PixelType, order: str = "native") -> ImageFrame:
    """Files of raw pixels, each of its own size: `sizes` has name (the file's, without folders), width and height. Files that it does not name are left out."""
    files = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = files.join(small(sizes.select("name", "width", "height")), "name")
    return from_bytes(rows.select(F.col("path").alias("image_id"), "width", "height", F.col("content").alias("data")), pixel, order)


def save(frame: ImageFrame, path: str) -> None:
    """The frame as Parquet, with the pixel type's name in the schema."""
    fields = [F.col(c).alias(c, metadata={"pixel_type": frame.pixel.name}) if c in frame.pixel.channels else F.col(c) for c in frame.df.columns]
    frame.df.select(*fields).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> ImageFrame:
    df = spark.read.parquet(path)
    names = {f.metadata["pixel_type"] for f in df.schema.fields if "pixel_type" in (f.metadata or {})}
    if len(names) != 1:
        raise PixelTypeError(f"{path} does not name one pixel type")
    return ImageFrame.of(df, names.pop())


def rasterize(points: DataFrame, images: DataFrame, pixel: str | PixelType) -> ImageFrame:
    """Images of the sizes in `images` from rows (image_id, x, y, v); several rows on a pixel add up, none is 0.

    Points are summed before they are shuffled; pixels without points are filled in where the image is put together.
    """
    p = pixel_type(pixel)
    own = points.join(images.select("image_id", "width", "height"), "image_id").filter("x >= 0 and x < width and y >= 0 and y < height")
    sums = own.groupBy("image_id", (F.col("y") * F.col("width") + F.col("x")).cast("int").alias("i")).agg(F.sum(F.col("v").cast("bigint")).alias("v"))
    cells = sums.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_cells"))
    held = lambda v: (F.least(v, F.lit(min(p.max, 2**63 - 1))) if p.max is not None else v).cast(p.sql)
    gap = lambda n: F.array_repeat(F.lit(0).cast(p.sql), n)

    def dense(found: Column) -> Column:
        """Each point behind the zeros since the point before it, and the zeros after the last."""
        parts = F.transform(found, lambda c, k: F.concat(gap(c["i"] - F.coalesce(F.get(found, k - 1)["i"], F.lit(-1)) - 1), F.array(held(c["v"]))))
        last = F.coalesce(F.get(found, F.size(found) - 1)["i"], F.lit(-1))
        return F.concat(F.flatten(parts), gap(F.col("width") * F.col("height") - 1 - last))

    joined = images.join(cells, "image_id", "left")
    found = F.coalesce("_cells", F.array().cast(cells.schema["_cells"].dataType))
    return ImageFrame(joined.select(*KEYS, bound(found, dense).alias(p.channels[0])), p)
