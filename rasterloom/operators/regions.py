"""Regions, tiles and windows of images: narrow and without a shuffle. Tables of rectangles meet pixel rows in a join by grid cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.frame import ImageFrame, bound, grid
from rasterloom.shapes import Rectangle, Size, Stride


def crop(frame: ImageFrame, left: Column, top: Column, width: Column, height: Column) -> dict[str, Column]:
    """Channel arrays of a rectangle that lies inside."""
    cut = lambda own: grid(width, height, lambda x, y: F.get(own, ((y + top) * F.col("width") + x + left).cast("int")))
    return {c: bound(F.col(c), cut) for c in frame.pixel.channels}


def roi(frame: ImageFrame, rect: Rectangle) -> ImageFrame:
    """The rectangle of every image that holds it whole; other images are left out (a region of them does not exist)."""
    fits = (F.lit(rect.right) <= F.col("width")) & (F.lit(rect.bottom) <= F.col("height")) & F.lit(rect.left >= 0 and rect.top >= 0)
    inner = ImageFrame(frame.df.filter(fits), frame.pixel)
    w, h = F.lit(rect.size.width), F.lit(rect.size.height)
    return inner.with_channels(crop(inner, F.lit(rect.left), F.lit(rect.top), w, h), frame.pixel, w, h)


def _cut(frame: ImageFrame, boxes: Column) -> DataFrame:
    """One row a box: image_id, number, col, row, left, top, width, height and the channels."""
    rows = frame.df.select("*", F.posexplode(boxes).alias("number", "_box"))
    box = [F.col("_box")[k] for k in ("left", "top", "w", "h")]
    cut = crop(frame, *box)
    return rows.select("image_id", "number", F.col("_box")["col"].alias("col"), F.col("_box")["row"].alias("row"), box[0].alias("left"), box[1].alias("top"), *(cut[c].alias(c) for c in frame.pixel.channels), box[2].alias("width"), box[3].alias("height"))


def tiles(frame: ImageFrame, size: Size) -> DataFrame:
    """Tiles in raster order; those at the right and bottom edges are cut to the image."""
    if size.width < 1 or size.height < 1:
        raise ValueError("a tile has at least one pixel")
    across, down = F.ceil(F.col("width") / size.width).cast("int"), F.ceil(F.col("height") / size.height).cast("int")

    def box(col: Column, row: Column) -> Column:
        left, top = col * size.width, row * size.height
        return F.struct(col.alias("col"), row.alias("row"), left.alias("left"), top.alias("top"), F.least(F.lit(size.width), F.col("width") - left).alias("w"), F.least(F.lit(size.height), F.col("height") - top).alias("h"))

    return _cut(frame, grid(across, down, box))


def sliding_windows(frame: ImageFrame, size: Size, stride: Stride = Stride()) -> DataFrame:
    """All windows that lie inside, in raster order; none where the window exceeds the image."""
    if size.width < 1 or size.height < 1:
        raise ValueError("a window has at least one pixel")
    count = lambda side, own, step: F.greatest(F.floor((F.col(side) - own) / step).cast("int") + 1, F.lit(0))
    across = F.when(F.col("width") >= size.width, count("width", size.width, stride.x)).otherwise(0)
    down = F.when(F.col("height") >= size.height, count("height", size.height, stride.y)).otherwise(0)

    def box(col: Column, row: Column) -> Column:
        return F.struct(col.alias("col"), row.alias("row"), (col * stride.x).alias("left"), (row * stride.y).alias("top"), F.lit(size.width).alias("w"), F.lit(size.height).alias("h"))

    return _cut(frame, grid(across, down, box))


def map_tiles(frame: ImageFrame, size: Size, schema: str, function: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """One's own pandas function of each tile (disjoint, so each may be changed freely), where the image lies: no shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(len(part)):
                yield function(part.iloc[k : k + 1].reset_index(drop=True))

    return tiles(frame, size).mapInPandas(run, schema)


#: Side of the largest cells by which pixels and rectangles are brought together.
CELL = 256


def regions_of_pixels(pixels: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Many regions at once, of images given as pixel rows: each pixel with each rectangle that holds it, once.

    `rectangles`: rect_id, image_id, left, top, width, height; repeated rows count once, what lies outside an image is empty.
    Gives rect_id, image_id, x and y within the rectangle, and the pixels' further columns. Rectangles are filed under the cells of a
    grid that they touch, the grid being as fine as a quarter of their larger side (CELL at most), and pixels under
    their cell of each grid in use (nine at most): an equi-join, and a test of what it brings together.
    """
    side = F.least(F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.greatest("width", "height").cast("double"))) - 2, F.lit(0))), F.lit(float(CELL))).cast("int")
    filed = rectangles.select("rect_id", "image_id", "left", "top", "width", "height").distinct().filter("width > 0 and height > 0").withColumn("side", side)
    grids = sorted(r["side"] for r in filed.select("side").distinct().collect())
    if not grids:
        grids = [1]
    cells = lambda at, more: F.explode(F.sequence(F.floor(F.col(at) / F.col("side")), F.floor((F.col(at) + F.col(more) - 1) / F.col("side"))))
    keyed = filed.withColumn("cx", cells("left", "width")).withColumn("cy", cells("top", "height"))
    placed = pixels.withColumn("side", F.explode(F.array(*map(F.lit, grids))))
    placed = placed.withColumns({"cx": F.floor(F.col("x") / F.col("side")), "cy": F.floor(F.col("y") / F.col("side"))})
    inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + F.col("width")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + F.col("height"))
    met = placed.join(keyed, ["image_id", "side", "cx", "cy"]).filter(inside)
    others = [c for c in pixels.columns if c not in ("image_id", "x", "y")]
    return met.select("rect_id", "image_id", (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("top")).alias("y"), *others)


def interior(size: Size, kernel: Size, anchor: tuple[int, int]) -> Rectangle | None:
    """Where a kernel with this anchor lies inside; None if nowhere."""
    w, h = size.width - kernel.width + 1, size.height - kernel.height + 1
    return Rectangle.of(anchor[0], anchor[1], w, h) if w > 0 and h > 0 else None


