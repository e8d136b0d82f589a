"""Applying a conversion to pixel rows, to image frames, or to a stream of either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.frame import ImageFrame
from rasterloom.functions.conversions import Strategy
from rasterloom.pixel import PixelType, pixel_type


def convert_pixels(pixels: DataFrame, src: str | PixelType, strategy: Strategy, dst: str | PixelType | None = None) -> DataFrame:
    """One projection over rows (keys..., channels): what is no channel of `src` is carried along. Works on streams."""
    a = pixel_type(src)
    b = strategy.target(a, pixel_type(dst) if dst is not None else None)
    out = strategy.apply({c: F.col(c) for c in a.channels}, a, b)
    return pixels.select(*(c for c in pixels.columns if c not in (*a.channels, *b.channels)), *(out[c].alias(c) for c in b.channels))


def convert_image(frame: ImageFrame, strategy: Strategy, dst: str | PixelType | None = None) -> ImageFrame:
    """The same over image frames, by array lambdas; no shuffle."""
    a = frame.pixel
    b = strategy.target(a, pixel_type(dst) if dst is not None else None)
    if len(a.channels) == 1:
        one = a.channels[0]
        columns = {}
        for c in b.channels:
            columns[c] = F.transform(one, lambda v: strategy.apply({one: v}, a, b)[c])  # noqa: B023
        return frame.with_channels(columns, b)
    zipped = F.arrays_zip(*a.channels)
    columns = {}
    for c in b.channels:
        columns[c] = F.transform(zipped, lambda p: strategy.apply({k: p[k] for k in a.channels}, a, b)[c])  # noqa: B023
    return frame.with_channels(columns, b)
