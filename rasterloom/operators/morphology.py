"""Rank filters over a mask: erosion, dilation, what is made of them, and the median."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.frame import KEYS, ImageFrame
from rasterloom.operators import ranks
from rasterloom.operators.combine import PixelSubtract
from rasterloom.operators.neighborhood import Border, Kernel, in_rows, map_neighborhood, require_full


def _extreme(frame: ImageFrame, mask: Kernel, border: Border, pick, what: str) -> ImageFrame:
    frame.pixel.require_ordered(what)
    if border.in_engine:
        least = np.minimum if pick is F.least else np.maximum
        return in_rows(frame, border, frame.pixel, lambda own, fill: ranks.extreme(own, mask, border, fill, least))

    def op(centre: Column, taps: list) -> Column:
        samples = [s for *_, s in taps]
        return pick(centre, *samples) if samples else centre

    return map_neighborhood(frame, mask, border, op)


def erode(frame: ImageFrame, mask: Kernel, border: Border) -> ImageFrame:
    """The least of the centre and the active cells."""
    return _extreme(frame, mask, border, F.least, "erode")


def dilate(frame: ImageFrame, mask: Kernel, border: Border) -> ImageFrame:
    """The greatest of the centre and the active cells."""
    return _extreme(frame, mask, border, F.greatest, "dilate")


def opening(frame: ImageFrame, mask: Kernel, border: Border) -> ImageFrame:
    """Erosion, then dilation, by the same mask."""
    return dilate(erode(frame, mask, border), mask, border)


def closing(frame: ImageFrame, mask: Kernel, border: Border) -> ImageFrame:
    """Dilation, then erosion, by the same mask."""
    return erode(dilate(frame, mask, border), mask, border)


def _difference(frame: ImageFrame, minuend: Callable[[ImageFrame], ImageFrame], subtrahend: Callable[[ImageFrame], ImageFrame]) -> ImageFrame:
    """minuend(frame) - subtrahend(frame), saturating. The first result rides along while the second is made: no join."""
    p, c = frame.pixel, frame.pixel.channels[0]
    own = frame.df.select(*KEYS, c, F.col(c).alias("_own"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    one = minuend(ImageFrame(own, p, ("_own", "_w", "_h"))).df
    again = one.select("image_id", F.col("_w").alias("width"), F.col("_h").alias("height"), F.col("_own").alias(c), F.col(c).alias("_one"))
    two = subtrahend(ImageFrame(again, p, ("_one",)))
    return ImageFrame(two.df.select(*KEYS, F.zip_with("_one", c, lambda a, b: PixelSubtract().channel(a, b, p)).alias(c)), p)


def morphological_gradient(frame: ImageFrame, mask: Kernel, border: Border) -> ImageFrame:
    """Dilation minus erosion."""
    return _difference(frame, lambda f: dilate(f, mask, border), lambda f: erode(f, mask, border))


def top_hat(frame: ImageFrame, mask: Kernel, border: Border) -> ImageFrame:
    """The image minus its opening."""
    require_full(border, "top_hat")
    return _difference(frame, lambda f: f, lambda f: opening(f, mask, border))


def black_hat(frame: ImageFrame, mask: Kernel, border: Border) -> ImageFrame:
    """The closing minus the image."""
    require_full(border, "black_hat")
    return _difference(frame, lambda f: closing(f, mask, border), lambda f: f)


def median_filter(frame: ImageFrame, mask: Kernel, border: Border) -> ImageFrame:
    """The upper median of the active cells."""
    frame.pixel.require_ordered("median_filter")
    if not any(mask.data):
        raise ValueError("a median needs an active cell")
    if border.in_engine:
        is_bytes = frame.pixel.channel.name == "u8"
        return in_rows(frame, border, frame.pixel, lambda own, fill: ranks.median(own, mask, border, fill, is_bytes))

    def op(centre: Column, taps: list) -> Column:
        return F.get(F.array_sort(F.array(*(s for *_, s in taps))), len(taps) // 2)

    return map_neighborhood(frame, mask, border, op)
