"""Images as rows.

An ImageFrame has one row an image: `image_id`, `width`, `height`, and one array for each channel, in raster order.
Whatever looks at a pixel's neighbours reads array elements, so it needs no shuffle and parallelises by image;
images too large for one task are cut into tiles with a halo first (operators.tiling). `pixels()` gives the other
form, one row a pixel, for joins and aggregations; an image without pixels survives in the first form only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.errors import PixelTypeError
from rasterloom.pixel import PixelType, pixel_type

KEYS = ("image_id", "width", "height")


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row.

    A lambda that reads a column may otherwise have the column's own expression inlined into it, and pay for the whole
    array at every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def exploded(rows: DataFrame) -> DataFrame:
    """Rows of an outer posexplode into `_i`, without the null rows of empty arrays.

    The inner form would have the optimiser test the array's size first, by working out the whole array once more.
    """
    return rows.filter(F.col("_i").isNotNull())


def grid(width: Column, height: Column, value: Callable[[Column, Column], Column]) -> Column:
    """An array in raster order of value(x, y)."""
    return F.transform(indices(width * height), lambda i: value(i % width, F.floor(i / width).cast("int")))


@dataclass(frozen=True)
class ImageFrame:
    df: DataFrame
    pixel: PixelType
    #: Further columns that operators pass through.
    carried: tuple[str, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, pixel: str | PixelType) -> ImageFrame:
        p = pixel_type(pixel)
        missing = [c for c in (*KEYS, *p.channels) if c not in df.columns]
        if missing:
            raise PixelTypeError(f"{p.name} images lack columns {missing}")
        return cls(df.select(*KEYS, *p.channels), p)

    @classmethod
    def from_pixels(cls, pixels: DataFrame, pixel: str | PixelType, images: DataFrame | None = None) -> ImageFrame:
        """From one row a pixel (image_id, x, y, channels); sizes from `images`, else from the largest coordinates.

        One shuffle by image_id.
        """
        p = pixel_type(pixel)
        cells = F.array_sort(F.collect_list(F.struct("y", "x", *p.channels)))
        rows = pixels.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), cells.alias("_cells"))
        if images is not None:
            rows = images.select(*KEYS).join(rows.select("image_id", "_cells"), "image_id", "left")
            rows = rows.withColumn("_cells", F.coalesce("_cells", F.array().cast(rows.schema["_cells"].dataType)))
        return cls(rows.select(*KEYS, *(F.col("_cells")[c].alias(c) for c in p.channels)), p)

    def pixels(self) -> DataFrame:
        """image_id, x, y and the channels, one row a pixel. No shuffle."""
        if len(self.pixel.channels) == 1:
            one = self.pixel.channels[0]
            rows = exploded(self.df.select("image_id", "width", F.posexplode_outer(one).alias("_i", one)))
            values = [F.col(one)]
        else:
            rows = exploded(self.df.select("image_id", "width", F.posexplode_outer(F.arrays_zip(*self.pixel.channels)).alias("_i", "_p")))
            values = [F.col("_p")[c].alias(c) for c in self.pixel.channels]
        return rows.select("image_id", (F.col("_i") % F.col("width")).alias("x"), F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"), *values)

    def images(self) -> DataFrame:
        return self.df.select(*KEYS)

    def with_channels(self, columns: dict[str, Column], pixel: str | PixelType, width: Column | None = None, height: Column | None = None) -> ImageFrame:
        """The same images with new channel arrays and, if given, new sizes."""
        p = pixel_type(pixel)
        w = F.col("width") if width is None else width
        h = F.col("height") if height is None else height
        # under names of their own first: inside a lambda, an alias of this projection would win over the input's column
        made = {"width": w.cast("int"), "height": h.cast("int"), **{c: columns[c] for c in p.channels}}
        inner = self.df.select("image_id", *(v.alias(f"_new_{n}") for n, v in made.items()), *self.carried)
        df = inner.select("image_id", *(F.col(f"_new_{n}").alias(n) for n in made), *self.carried)
        return ImageFrame(df, p, self.carried)

    def map_channels(self, change: Callable[[Column], Column], pixel: str | PixelType | None = None) -> ImageFrame:
        """Every channel array through the same function of one value."""
        p = pixel_type(pixel) if pixel is not None else self.pixel
        return self.with_channels({c: F.transform(c, change) for c in p.channels}, p)

    def retyped(self, pixel: str | PixelType) -> ImageFrame:
        """The same numbers under another type with the same channels."""
        p = pixel_type(pixel)
        if p.channels != self.pixel.channels:
            raise PixelTypeError(f"{self.pixel.name} and {p.name} differ in channels")
        return self.map_channels(lambda v: v.cast(p.sql), p)

    # Views

    def pixel_at(self, x: int, y: int) -> DataFrame:
        """image_id and the channels at (x, y); null where an image does not reach."""
        inside = (F.lit(x) >= 0) & (F.lit(x) < F.col("width")) & (F.lit(y) >= 0) & (F.lit(y) < F.col("height"))
        at = (F.lit(y) * F.col("width") + x).cast("int")
        return self.df.select("image_id", *(F.when(inside, F.get(c, at)).alias(c) for c in self.pixel.channels))

    def row(self, y: int) -> DataFrame:
        """image_id and each channel's scan line y; null where an image does not reach."""
        inside = (F.lit(y) >= 0) & (F.lit(y) < F.col("height"))
        part = lambda c: F.when(inside & (F.col("width") > 0), F.slice(c, F.lit(y) * F.col("width") + 1, F.col("width")))
        return self.df.select("image_id", *(part(c).alias(c) for c in self.pixel.channels))

    def equals(self, other: ImageFrame) -> DataFrame:
        """(image_id, equal) for every image of either side: same type, size and pixels."""
        if self.pixel != other.pixel:
            raise PixelTypeError(f"{self.pixel.name} and {other.pixel.name} are never equal")
        mine = self.df.select("image_id", F.struct("width", "height", *self.pixel.channels).alias("_a"))
        theirs = other.df.select("image_id", F.struct("width", "height", *self.pixel.channels).alias("_b"))
        return mine.join(theirs, "image_id", "full").select("image_id", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("equal"))
