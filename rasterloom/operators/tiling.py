"""Images too large for one task: tiles with a halo, each processed like an image of its own.

Pixels are dealt to the tiles that need them (a pixel near a cut goes to up to four), one shuffle by (image, tile). A
tile ends where the image ends, so the border policy meets the true edges; what it does at cuts falls into the
halo and is dropped. Where the border wraps round, the halo holds the far side; where the result shrinks, tiles are cut by what comes out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.errors import BorderError
from rasterloom.frame import ImageFrame, exploded
from rasterloom.joins import small
from rasterloom.operators.neighborhood import Border, Wrap
from rasterloom.pixel import PixelType, pixel_type
from rasterloom.shapes import Size


def _placed(out: ImageFrame, left: Column, top: Column) -> DataFrame:
    """Pixel rows of tiles whose corners lie at (left, top); tx and ty come along."""
    names = out.pixel.channels
    rows = exploded(out.df.select("image_id", "width", *out.carried, F.posexplode_outer(F.arrays_zip(*names)).alias("_i", "_p")))
    return rows.select("image_id", "tx", "ty", (left + F.col("_i") % F.col("width")).cast("int").alias("x"), (top + F.floor(F.col("_i") / F.col("width"))).cast("int").alias("y"), *(F.col("_p")[c].alias(c) for c in names))


def _gathered(local: DataFrame, p: PixelType) -> ImageFrame:
    """Tiles as images, from pixels with their tile (tx, ty), its corner (x0, y0) and its size (w, h): one shuffle."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", *p.channels)))
    grouped = local.groupBy("image_id", "tx", "ty", "x0", "y0", "w", "h").agg(cells.alias("_cells"))
    return ImageFrame(grouped.select("image_id", F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), *(F.col("_cells")[c].alias(c) for c in p.channels), "tx", "ty", "x0", "y0"), p, ("tx", "ty", "x0", "y0"))


def _mine(rows: DataFrame, tile: Size) -> DataFrame:
    """Of a tile's pixels those that are its own, not its halo's."""
    own = (F.floor(F.col("x") / tile.width) == F.col("tx")) & (F.floor(F.col("y") / tile.height) == F.col("ty"))
    return rows.filter(own).drop("tx", "ty")


def tiled(pixels: DataFrame, images: DataFrame, pixel: str | PixelType, tile: Size, halo: int, border: Border, op: Callable[[ImageFrame, Border], ImageFrame]) -> DataFrame:
    """op(frame, border) over images given as pixel rows (image_id, x, y, channels) and sizes; pixel rows again.

    `op` must keep the frame and look no further than `halo` pixels. A border that wraps round needs tiled_round, one that
    shrinks the frame tiled_inside.
    """
    p = pixel_type(pixel)
    if isinstance(border, Wrap) or not border.full:
        raise BorderError("tiles need a border policy that keeps the frame and reads near the edge")
    if halo < 0 or tile.width <= halo or tile.height <= halo:
        raise ValueError("a tile is larger than its halo")
    sized = pixels.join(images.select("image_id", "width", "height"), "image_id")

    def tiles(at: str, side: int, whole: str) -> Column:
        last = F.floor((F.col(whole) - 1) / side)
        return F.sequence(F.greatest(F.floor((F.col(at) - halo) / side), F.lit(0)), F.least(F.floor((F.col(at) + halo) / side), last))

    def start(t: str, side: int) -> Column:
        return F.greatest(F.col(t) * side - halo, F.lit(0))

    def end(t: str, side: int, whole: str) -> Column:
        return F.least((F.col(t) + 1) * side + halo, F.col(whole))

    dealt = sized.withColumn("tx", F.explode(tiles("x", tile.width, "width"))).withColumn("ty", F.explode(tiles("y", tile.height, "height")))
    local = dealt.withColumn("x0", start("tx", tile.width)).withColumn("y0", start("ty", tile.height)).withColumn("w", end("tx", tile.width, "width") - F.col("x0")).withColumn("h", end("ty", tile.height, "height") - F.col("y0"))
    return _mine(_placed(op(_gathered(local, p), border), F.col("x0"), F.col("y0")), tile)


def tiled_round(pixels: DataFrame, images: DataFrame, pixel: str | PixelType, tile: Size, halo: int, op: Callable[[ImageFrame, Border], ImageFrame]) -> DataFrame:
    """tiled for the border that wraps round: halos hold what lies on the far side, as often round as an image smaller than the halo needs."""
    p, border = pixel_type(pixel), Wrap()
    if halo < 0 or tile.width <= halo or tile.height <= halo:
        raise ValueError("a tile is larger than its halo")
    sized = pixels.join(images.select("image_id", "width", "height"), "image_id")

    def turns(at: str, side: int, whole: str) -> Column:
        """(tile, place) of every tile that holds the pixel, or one of its images so many turns away."""
        last, most = F.floor((F.col(whole) - 1) / side), F.ceil(F.lit(halo) / F.col(whole))
        one = lambda k: F.col(at) + k * F.col(whole)
        held = lambda t, x: (x >= t * side - halo) & (x < F.least((t + 1) * side, F.col(whole)) + halo)
        near = lambda x: F.filter(F.sequence(F.greatest(F.floor((x - halo) / side) - 1, F.lit(0)), F.greatest(F.least(F.floor((x + halo) / side), last), F.lit(0))), lambda t: (t <= last) & held(t, x))
        return F.flatten(F.transform(F.sequence(-most, most), lambda k: F.transform(near(one(k)), lambda t: F.struct(t.alias("t"), one(k).alias("at")))))

    dealt = sized.withColumn("_x", F.explode(turns("x", tile.width, "width"))).withColumn("_y", F.explode(turns("y", tile.height, "height")))
    corner = lambda t, side: F.col(t) * side - halo
    spread = lambda t, side, whole: F.least((F.col(t) + 1) * side, F.col(whole)) - F.col(t) * side + 2 * halo
    moved = dealt.select("image_id", "width", "height", F.col("_x.at").alias("x"), F.col("_y.at").alias("y"), F.col("_x.t").alias("tx"), F.col("_y.t").alias("ty"), *p.channels)
    local = moved.withColumns({"x0": corner("tx", tile.width), "y0": corner("ty", tile.height), "w": spread("tx", tile.width, "width"), "h": spread("ty", tile.height, "height")})
    rows = _placed(op(_gathered(local, p), border), F.col("x0"), F.col("y0"))
    # what lies right of the last tile is its halo as well
    whole = rows.join(small(images.select("image_id", "width", "height")), "image_id").filter("x >= 0 and y >= 0 and x < width and y < height").drop("width", "height")
    return _mine(whole, tile)


def tiled_inside(pixels: DataFrame, images: DataFrame, pixel: str | PixelType, tile: Size, reach: tuple[int, int], op: Callable[[ImageFrame], ImageFrame]) -> DataFrame:
    """op(frame) for operators whose result shrinks by `reach` (columns, rows): kernels without a border, template scores.

    A tile is cut by output pixels and reads `reach` more to its right and below, so its whole result is its own.
    """
    p, (rx, ry) = pixel_type(pixel), reach
    if rx < 0 or ry < 0 or tile.width < 1 or tile.height < 1:
        raise ValueError("a tile has at least one pixel, and reaches no less than nothing")
    sized = pixels.join(images.select("image_id", "width", "height").filter((F.col("width") > rx) & (F.col("height") > ry)), "image_id")

    def tiles(at: str, side: int, more: int, whole: str) -> Column:
        last = F.floor((F.col(whole) - more - 1) / side)
        first = F.greatest(F.floor((F.col(at) - more) / side), F.lit(0))
        return F.filter(F.sequence(first, F.greatest(first, F.least(F.floor(F.col(at) / side), last))), lambda t: (t <= last) & (F.col(at) >= t * side) & (F.col(at) < (t + 1) * side + more))

    dealt = sized.withColumn("tx", F.explode(tiles("x", tile.width, rx, "width"))).withColumn("ty", F.explode(tiles("y", tile.height, ry, "height")))
    spread = lambda t, side, more, whole: F.least((F.col(t) + 1) * side + more, F.col(whole)) - F.col(t) * side
    local = dealt.withColumns({"x0": F.col("tx") * tile.width, "y0": F.col("ty") * tile.height, "w": spread("tx", tile.width, rx, "width"), "h": spread("ty", tile.height, ry, "height")})
    return _placed(op(_gathered(local, p)), F.col("x0"), F.col("y0")).drop("tx", "ty")
