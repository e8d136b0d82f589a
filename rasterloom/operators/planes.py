"""Planes: an image frame keeps each channel in a column of its own, so these are projections and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.errors import ChannelCountMismatch, PixelTypeError
from rasterloom.frame import KEYS, ImageFrame
from rasterloom.pixel import PixelType, pixel_type


def plane(frame: ImageFrame, index: int) -> ImageFrame:
    """Channel number `index` as images of the family's grey type."""
    names = frame.pixel.channels
    if not 0 <= index < len(names):
        raise ChannelCountMismatch(f"{frame.pixel.name} has no channel {index}")
    grey = "SrgbMono" if not frame.pixel.linear else "Mono"
    p = pixel_type(grey + frame.pixel.name[len(frame.pixel.family) :])
    return ImageFrame(frame.df.select(*KEYS, F.col(names[index]).alias("v")), p)


def planes(frame: ImageFrame) -> list[ImageFrame]:
    return [plane(frame, k) for k in range(len(frame.pixel.channels))]


def replace_plane(frame: ImageFrame, index: int, other: ImageFrame) -> ImageFrame:
    """`frame` with one channel from `other`, whose images must have the same sizes."""
    own = planes(frame)
    plane(frame, index)
    return from_planes(own[:index] + [other] + own[index + 1 :], frame.pixel)


def from_planes(parts: list[ImageFrame], pixel: str | PixelType) -> ImageFrame:
    """Single-channel images joined by image_id; fails with SizeMismatch in its message where sizes differ."""
    p = pixel_type(pixel)
    if len(parts) != len(p.channels):
        raise ChannelCountMismatch(f"{len(parts)} planes for the {len(p.channels)} channels of {p.name}")
    for part in parts:
        if len(part.pixel.channels) != 1 or part.pixel.sql != p.sql:
            raise PixelTypeError(f"{part.pixel.name} is no plane of {p.name}")
    sides = [part.df.select("image_id", F.struct("width", "height").alias(f"_s{k}"), F.col(part.pixel.channels[0]).alias(f"_p{k}")) for k, part in enumerate(parts)]
    joined: DataFrame = reduce(lambda a, b: a.join(b, "image_id"), sides)
    same = reduce(lambda a, b: a & b, [F.col("_s0") == F.col(f"_s{k}") for k in range(1, len(parts))], F.lit(True))
    told = F.raise_error(F.concat(F.lit("SizeMismatch: image "), F.col("image_id").cast("string"))).cast("int")
    return ImageFrame(joined.select("image_id", F.when(same, F.col("_s0.width")).otherwise(told).alias("width"), F.col("_s0.height").alias("height"), *(F.col(f"_p{k}").alias(c) for k, c in enumerate(p.channels))), p)


def to_interleaved(frame: ImageFrame) -> DataFrame:
    """image_id, width, height and `data`, one array of pixel structs."""
    return frame.df.select(*KEYS, F.arrays_zip(*frame.pixel.channels).alias("data"))


def from_interleaved(rows: DataFrame, pixel: str | PixelType) -> ImageFrame:
    p = pixel_type(pixel)
    return ImageFrame(rows.select(*KEYS, *(F.col("data")[c].alias(c) for c in p.channels)), p)


def long_form(frame: ImageFrame) -> DataFrame:
    """image_id, channel (number), x, y, v: one row a sample."""
    p = frame.pixel
    pairs = ", ".join(f"{k}, {c}" for k, c in enumerate(p.channels))
    return frame.pixels().selectExpr("image_id", "x", "y", f"stack({len(p.channels)}, {pairs}) as (channel, v)")
