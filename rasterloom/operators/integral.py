"""Integral images: running sums along rows, added to the row above.

The table has one row and one column more than the image, the first of each zero. It is built from the image's own
arrays, without a shuffle, in time linear in its pixels; an image that does not fit a row is summed as pixel rows, one
window along its rows and one along its columns. Whether sums can overflow is decided from sizes alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.errors import AccumulatorOverflow, PixelTypeError
from rasterloom.frame import ImageFrame
from rasterloom.joins import lookup, small
from rasterloom.operators.arrays import per_image
from rasterloom.pixel import PixelType, pixel_type, whole
from rasterloom.shapes import Rectangle, Size
from rasterloom.storage import only, written

#: Which table types hold sums, and sums of squares, of which pixel types.
SUMS = {
    "Mono8": ("Mono32", "Mono64", "MonoF64"),
    "Mono16": ("Mono64", "MonoF64"),
    "Mono32": ("Mono64", "MonoF64"),
    "MonoF32": ("MonoF64",),
    "MonoF64": ("MonoF64",),
    "Rgb8": ("Rgb32", "Rgb64", "RgbF64"),
    "Rgb16": ("Rgb64", "RgbF64"),
    "RgbF32": ("RgbF64",),
}
SQUARES = {
    "Mono8": ("Mono64", "MonoF64"),
    "Mono16": ("MonoF64",),
    "Mono32": ("MonoF64",),
    "MonoF32": ("MonoF64",),
    "MonoF64": ("MonoF64",),
    "Rgb8": ("Rgb64", "RgbF64"),
    "Rgb16": ("RgbF64",),
    "RgbF32": ("RgbF64",),
}
#: Integers up to here are exact in a double.
EXACT = 2**53


def capacity(table: PixelType) -> int:
    return table.max if table.max is not None else EXACT


def preflight(size: Size, pixel: str | PixelType, table: str | PixelType, squared: bool = False) -> None:
    """Refuses a size whose largest possible sum exceeds the table's type. Float images are not bounded."""
    p, t = pixel_type(pixel), pixel_type(table)
    if t.name not in (SQUARES if squared else SUMS).get(p.name, ()):
        raise PixelTypeError(f"{t.name} does not hold {'squared ' * squared}sums of {p.name}")
    if p.max is not None and size.area * p.max ** (1 + squared) > capacity(t):
        raise AccumulatorOverflow(f"{size.width} x {size.height} {p.name} can exceed {t.name}")


def _checked(frame: ImageFrame, table: PixelType, squared: bool) -> Column:
    """The width, or an error for an image whose sums could overflow."""
    if frame.pixel.max is None:
        return F.col("width")
    most = capacity(table) // frame.pixel.max ** (1 + squared)
    told = F.raise_error(F.concat(F.lit("AccumulatorOverflow: image "), F.col("image_id").cast("string"))).cast("int")
    area = F.col("width").cast("decimal(38,0)") * F.col("height").cast("decimal(20,0)")
    return F.when(area <= whole(most).cast("decimal(38,0)"), F.col("width")).otherwise(told)


@dataclass(frozen=True)
class IntegralImage:
    """`frame` holds the table, (width + 1) x (height + 1)."""

    frame: ImageFrame
    pixel: PixelType

    def source_sizes(self) -> DataFrame:
        return self.frame.df.select("image_id", (F.col("width") - 1).alias("width"), (F.col("height") - 1).alias("height"))

    def table_sizes(self) -> DataFrame:
        return self.frame.images()

    def region_sum(self, rect: Rectangle) -> DataFrame:
        """image_id and each channel's sum over the rectangle; null where it does not lie inside."""
        inside = F.lit(rect.left >= 0 and rect.top >= 0) & (F.lit(rect.right) < F.col("width")) & (F.lit(rect.bottom) < F.col("height"))
        at = lambda c, x, y: F.get(c, (F.lit(y) * F.col("width") + x).cast("int"))

        def total(c: str) -> Column:
            right = at(c, rect.right, rect.bottom) - at(c, rect.right, rect.top)
            left = at(c, rect.left, rect.bottom) - at(c, rect.left, rect.top)
            return F.when(inside, right - left).cast(self.frame.pixel.sql).alias(c)

        return self.frame.df.select("image_id", *(total(c) for c in self.frame.pixel.channels))

    def region_sums(self, rectangles: DataFrame) -> DataFrame:
        """Sums over a table of rectangles (rect_id, image_id, left, top, width, height)."""
        return region_sums(self.frame.pixels(), self.source_sizes(), self.frame.pixel, rectangles)


#: The corners of a rectangle: which side each lies on, across and down.
_CORNERS = [("left", "top"), ("right", "top"), ("left", "bottom"), ("right", "bottom")]


def region_sums(table: DataFrame, images: DataFrame, pixel: str | PixelType, rectangles: DataFrame) -> DataFrame:
    """Sums over many rectangles at once, from a table given as rows (image_id, x, y, channels; integral_of_pixels) and the images' sizes.

    `rectangles`: rect_id, image_id, left, top, width, height; equal rows count once. Gives these and each channel's sum, null for a
    rectangle that does not lie inside its image, or is of no image. Corners are looked up by an equi-join with the table's rows; one that
    many rectangles share is looked up once and told to them without a crowded task.
    """
    p = pixel_type(pixel)
    keys = ["rect_id", "image_id", "left", "top", "width", "height"]
    sizes = images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    given = rectangles.select(*keys).distinct().join(small(sizes), "image_id", "left").withColumns({"right": right, "bottom": bottom})
    fits = (F.col("left") >= 0) & (F.col("top") >= 0) & (F.col("width") >= 0) & (F.col("height") >= 0) & (F.col("right") <= F.col("_w")) & (F.col("bottom") <= F.col("_h"))
    with only(table.sparkSession) as results:
        held = written(given.withColumn("inside", F.coalesce(fits, F.lit(False))).drop("_w", "_h"), "rectangles")
        corner = [F.struct(F.lit(k).alias("corner"), F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y")) for k, (x, y) in enumerate(_CORNERS)]
        # sums on the table's first row and column are zero
        asked = written(held.filter("inside and width > 0 and height > 0").select(*keys, F.inline(F.array(*corner))).filter("x > 0 and y > 0"), "corners")
        counts = asked.groupBy("image_id", "x", "y").agg(F.count("*").alias("_n"))
        values = written(counts.join(table.select("image_id", "x", "y", *p.channels), ["image_id", "x", "y"]), "values")
        found = lookup(asked, values, ["image_id", "x", "y"], "_n", asked.count())
        zero = F.lit(0).cast(p.sql)
        at = lambda c, k: F.coalesce(F.max(F.when(F.col("corner") == k, F.col(c))), zero)
        sums = found.groupBy(*keys).agg(*((at(c, 3) - at(c, 1) - (at(c, 2) - at(c, 0))).cast(p.sql).alias(c) for c in p.channels))
        told = held.join(sums, keys, "left").select(*keys, *(F.when(F.col("inside"), F.coalesce(c, zero)).alias(c) for c in p.channels))
        out = written(told, "sums")
        results.append(out)
    return out


def _table(frame: ImageFrame, table: PixelType, squared: bool) -> IntegralImage:
    kind = np.dtype("float64" if table.max is None else {"u32": "int64", "u64": "uint64"}[table.channel.name])

    def summed(_, channels: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for samples in channels:
            own = np.zeros((samples.shape[0] + 1, samples.shape[1] + 1), dtype=kind)
            values = samples.astype(kind)
            np.cumsum(values * values if squared else values, axis=1, out=own[1:, 1:])
            out.append(np.cumsum(own, axis=0, out=own))
        return out

    checked = ImageFrame(frame.df.withColumn("width", _checked(frame, table, squared)), frame.pixel, frame.carried)
    return IntegralImage(per_image(checked, table, summed), frame.pixel)


def integral_of_pixels(pixels: DataFrame, images: DataFrame, pixel: str | PixelType, table: str | PixelType, squared: bool = False) -> DataFrame:
    """The table as rows (image_id, x, y, channels), from one row for every pixel and the images' sizes.

    No task holds more than a row or a column of an image.
    """
    p, t = pixel_type(pixel), pixel_type(table)
    preflight(Size(0, 0), p, t, squared)
    kind = "double" if t.max is None else {"u32": "bigint", "u64": "decimal(38,0)"}[t.channel.name]
    sized = images.select("image_id", _checked(ImageFrame(images, p), t, squared).alias("width"), "height")
    value = lambda c: (F.col(c).cast(kind) * F.col(c).cast(kind) if squared else F.col(c).cast(kind)).cast(kind)
    along = lambda fixed, moving: Window.partitionBy("image_id", fixed).orderBy(moving).rowsBetween(Window.unboundedPreceding, 0)
    own = pixels.join(sized.filter("width >= 0").select("image_id"), "image_id")
    rows = own.select("image_id", "x", "y", *(F.sum(value(c)).over(along("y", "x")).cast(kind).alias(c) for c in p.channels))
    sums = rows.select("image_id", (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), *(F.sum(c).over(along("x", "y")).cast(t.sql).alias(o) for c, o in zip(p.channels, t.channels, strict=True)))
    zeros = [F.lit(0).cast(t.sql).alias(o) for o in t.channels]
    top = sized.select("image_id", F.explode(F.sequence(F.lit(0), "width")).alias("x"), F.lit(0).alias("y"), *zeros)
    left = sized.filter("height > 0").select("image_id", F.lit(0).alias("x"), F.explode(F.sequence(F.lit(1), "height")).alias("y"), *zeros)
    return sums.union(top).union(left)


def integral_image(frame: ImageFrame, table: str | PixelType) -> IntegralImage:
    preflight(Size(0, 0), frame.pixel, table)
    return _table(frame, pixel_type(table), False)


def integral_squared_image(frame: ImageFrame, table: str | PixelType) -> IntegralImage:
    preflight(Size(0, 0), frame.pixel, table, True)
    return _table(frame, pixel_type(table), True)
