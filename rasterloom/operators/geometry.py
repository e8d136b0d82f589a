"""Flips, turns, transposition and resizing.

An image of a frame is one array, so each is one narrow step: rows gathered by index arrays, or a projection for resize methods
of one's own. Images of pixel rows are moved by a projection, and resized by output blocks: each pixel goes to
the blocks that read it, one shuffle, and a block is put together on its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.frame import ImageFrame, bound, grid
from rasterloom.functions.conversions import into
from rasterloom.joins import small
from rasterloom.operators.arrays import ARROW, per_stack
from rasterloom.operators.engine import to_channel
from rasterloom.pixel import PixelType, pixel_type


#: Where pixel (x, y) of an image of width w and height h goes; and whether the sides change places.
MOVES: dict[str, tuple[Callable, bool]] = {
    "flip_h": (lambda x, y, w, h: (w - 1 - x, y), False),
    "flip_v": (lambda x, y, w, h: (x, h - 1 - y), False),
    "rotate_180": (lambda x, y, w, h: (w - 1 - x, h - 1 - y), False),
    "rotate_90": (lambda x, y, w, h: (y, w - 1 - x), True),
    "rotate_270": (lambda x, y, w, h: (h - 1 - y, x), True),
    "transpose": (lambda x, y, w, h: (y, x), True),
}


def _in_place(frame: ImageFrame, change: Callable[[np.ndarray], np.ndarray]) -> ImageFrame:
    """`change` of every channel, for stacks of images."""
    return per_stack(frame, frame.pixel, lambda channels: [change(c) for c in channels])


def flip_h(frame: ImageFrame) -> ImageFrame:
    return _in_place(frame, lambda c: c[:, :, ::-1])


def flip_v(frame: ImageFrame) -> ImageFrame:
    return _in_place(frame, lambda c: c[:, ::-1])


def rotate_180(frame: ImageFrame) -> ImageFrame:
    """The array reversed."""
    return frame.with_channels({c: F.reverse(c) for c in frame.pixel.channels}, frame.pixel)


def rotate_90(frame: ImageFrame) -> ImageFrame:
    """Counter-clockwise: (x, y) goes to (y, width - 1 - x)."""
    return _in_place(frame, lambda c: c.transpose(0, 2, 1)[:, ::-1])


def rotate_270(frame: ImageFrame) -> ImageFrame:
    """Clockwise: (x, y) goes to (height - 1 - y, x)."""
    return _in_place(frame, lambda c: c.transpose(0, 2, 1)[:, :, ::-1])


def transpose(frame: ImageFrame) -> ImageFrame:
    return _in_place(frame, lambda c: c.transpose(0, 2, 1))


def move_pixels(pixels: DataFrame, images: DataFrame, move: str) -> DataFrame:
    """One of MOVES for images given as pixel rows (image_id, x, y, channels) and sizes; pixel rows again, without a shuffle of pixels if the sizes are few."""
    if move not in MOVES:
        raise ValueError(f"no move {move}; there are {', '.join(MOVES)}")
    sized = pixels.join(small(images.select("image_id", "width", "height")), "image_id")
    x, y = MOVES[move][0](F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return sized.select("image_id", x.cast("int").alias("x"), y.cast("int").alias("y"), *(c for c in pixels.columns if c not in ("image_id", "x", "y")))


class ResizeMethod:
    """How an output sample reads the input; extend it for one's own."""

    def target(self, p: PixelType, dst: PixelType | None) -> PixelType:
        raise NotImplementedError

    def sample(self, read: Callable[[Column, Column], Column], x: Column, y: Column, p: PixelType, dst: PixelType) -> Column:
        """The output channel for the float position (x, y); read(x, y) gives an input sample."""
        raise NotImplementedError

    def gather(self, read: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, last: tuple[int, int], p: PixelType, dst: PixelType) -> np.ndarray:
        """`sample` for arrays: of the columns at positions x and the rows at positions y, read(xs, ys) being the samples where both meet.

        `last` are the input's last column and row. A method that has it needs no interpreted expression.
        """
        raise NotImplementedError

    @property
    def gathers(self) -> bool:
        return type(self).gather is not ResizeMethod.gather


class NearestNeighbor(ResizeMethod):
    """The pixel left and above: positions are cut off, not rounded. Any type, or one that can hold its values."""

    def target(self, p, dst):
        out = dst or p
        into(F.lit(None), p, out)
        return out

    def sample(self, read, x, y, p, dst):
        return into(read(x.cast("int"), y.cast("int")), p, dst)

    def gather(self, read, x, y, last, p, dst):
        return read(x.astype(np.int64), y.astype(np.int64))


class Bilinear(ResizeMethod):
    """Blends of the four pixels around, in single precision; linear types only."""

    def target(self, p, dst):
        p.require_linear("Bilinear")
        return dst or p

    def sample(self, read, x, y, p, dst):
        kind = p.channel.accumulator
        x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
        x1, y1 = F.least(x0 + 1, F.col("width") - 1), F.least(y0 + 1, F.col("height") - 1)
        dx, dy = (x - x0.cast("float")).cast(kind), (y - y0.cast("float")).cast(kind)
        one = F.lit(1.0).cast(kind)
        mix = lambda a, b, t: b * t + a * (one - t)
        at = lambda u, v: read(u, v).cast(kind)
        return dst.from_linear(mix(mix(at(x0, y0), at(x1, y0), dx), mix(at(x0, y1), at(x1, y1), dx), dy))

    def gather(self, read, x, y, last, p, dst):
        kind = np.dtype({"float": "float32", "double": "float64"}[p.channel.accumulator])
        x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
        x1, y1 = np.minimum(x0 + 1, last[0]), np.minimum(y0 + 1, last[1])
        dx, dy = (x - x0.astype(np.float32)).astype(kind), (y - y0.astype(np.float32)).astype(kind)[:, None]
        one = kind.type(1)
        mix = lambda a, b, t: b * t + a * (one - t)
        at = lambda u, v: read(u, v).astype(kind)
        with np.errstate(all="ignore"):
            return to_channel(mix(mix(at(x0, y0), at(x1, y0), dx), mix(at(x0, y1), at(x1, y1), dx), dy), dst)


def _step(own: int, new: int) -> np.float32:
    """Input positions an output pixel: corners meet corners."""
    return np.float32((own - 1) / (new - 1)) if own > 1 and new > 1 else np.float32(0)


def resize(frame: ImageFrame, width: int, height: int, method: ResizeMethod, pixel: str | PixelType | None = None) -> ImageFrame:
    """Corners meet corners: a step of (in - 1) / (out - 1) in single precision, 0 where either side is 1 or less."""
    p = frame.pixel
    out = method.target(p, pixel_type(pixel) if pixel is not None else None)
    if method.gathers:

        def gathered(channels: list[np.ndarray]) -> list[np.ndarray]:
            n, h, w = channels[0].shape
            if not h * w:
                return [np.zeros((n, 0, 0), c.dtype) for c in channels]
            x, y = np.arange(width, dtype=np.float32) * _step(w, width), np.arange(height, dtype=np.float32) * _step(h, height)
            return [method.gather(lambda xs, ys: c[:, ys[:, None], xs], x, y, (w - 1, h - 1), p, out) for c in channels]  # noqa: B023

        return per_stack(frame, out, gathered)
    w, h = F.col("width"), F.col("height")

    def step(own: Column, new: int) -> Column:
        return F.when((own <= 1) | F.lit(new <= 1), F.lit(0.0)).otherwise((own - 1) / F.lit(float(max(new - 1, 1)))).cast("float")

    sx, sy = step(w, width), step(h, height)

    def resampled(own: Column) -> Column:
        read = lambda x, y: F.get(own, (y * w + x).cast("int"))
        return grid(F.lit(width), F.lit(height), lambda x, y: method.sample(read, x.cast("float") * sx, y.cast("float") * sy, frame.pixel, out))

    some = (w > 0) & (h > 0)
    columns = {o: F.when(some, bound(F.col(c), resampled)).otherwise(F.array().cast(f"array<{out.sql}>")) for c, o in zip(frame.pixel.channels, out.channels, strict=True)}
    return frame.with_channels(columns, out, F.when(some, F.lit(width)).otherwise(0), F.when(some, F.lit(height)).otherwise(0))


#: Side of an output block of an image of pixel rows.
BLOCK = 256


def resize_pixels(pixels: DataFrame, images: DataFrame, pixel: str | PixelType, width: int, height: int, method: ResizeMethod, dst: str | PixelType | None = None, block: int = BLOCK) -> DataFrame:
    """resize for images given as pixel rows and sizes, for a method that gathers; pixel rows again.

    A pixel goes to the output blocks that read it (what lies between two output positions, to none), one shuffle by (image, block);
    a task holds a block and the few input pixels that each of its pixels reads.
    """
    p = pixel_type(pixel)
    out = method.target(p, pixel_type(dst) if dst is not None else None)
    if not method.gathers:
        raise ValueError("blocks need a method that gathers")
    sized = pixels.join(small(images.select("image_id", "width", "height").filter("width > 0 and height > 0")), "image_id")

    def blocks(at: str, own: str, new: int) -> Column:
        """Blocks with output pixels whose position lies within 2 of an input pixel: those read it, and rounding moves none so far."""
        step = (F.col(own) - 1) / F.lit(float(max(new - 1, 1)))
        first, last = F.greatest(F.ceil((F.col(at) - 2) / step), F.lit(0)), F.least(F.floor((F.col(at) + 2) / step), F.lit(new - 1))
        some = F.when(first <= last, F.sequence(F.floor(first / block), F.floor(last / block)))
        every = F.when(F.col(at) <= 1, F.sequence(F.lit(0).cast("long"), F.lit((new - 1) // block).cast("long")))
        return F.when((F.col(own) > 1) & F.lit(new > 1), some).otherwise(every)

    dealt = sized.withColumn("_bx", F.explode(blocks("x", "width", width))).withColumn("_by", F.explode(blocks("y", "height", height)))
    own = dealt.select("image_id", "_bx", "_by", "width", "height", "x", "y", *p.channels)
    schema = T.StructType([own.schema["image_id"], T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), *(T.StructField(c, T._parse_datatype_string(out.sql)) for c in out.channels)])

    def put_together(table: pa.Table) -> pa.Table:
        one = lambda c: table[c][0].as_py()
        w, h = one("width"), one("height")
        xs, ys = (np.arange(b * block, min((b + 1) * block, new)) for b, new in ((one("_bx"), width), (one("_by"), height)))
        at_x, at_y = xs.astype(np.float32) * _step(w, width), ys.astype(np.float32) * _step(h, height)
        px, py = np.asarray(table["x"]).astype(np.int64), np.asarray(table["y"]).astype(np.int64)
        left, up = np.unique(px), np.unique(py)
        cell = np.searchsorted(up, py) * len(left) + np.searchsorted(left, px)
        made = []
        for c in p.channels:
            values = table[c].combine_chunks()
            flat = (values.cast(pa.uint64()) if pa.types.is_decimal(values.type) else values).to_numpy(zero_copy_only=False)
            held = np.zeros(len(up) * len(left), flat.dtype)
            held[cell] = flat
            held = held.reshape(len(up), len(left))
            look = lambda u, v: held[np.searchsorted(up, v)[:, None], np.searchsorted(left, u)]  # noqa: B023, E731
            made.append(method.gather(look, at_x, at_y, (w - 1, h - 1), p, out))
        columns = [pa.array(np.tile(xs, len(ys)).astype(np.int32)), pa.array(np.repeat(ys, len(xs)).astype(np.int32)), *(pa.array(np.ascontiguousarray(m).ravel()).cast(ARROW[out.sql]) for m in made)]
        ids = table["image_id"].combine_chunks().take(pa.array(np.zeros(len(xs) * len(ys), np.int64)))
        return pa.Table.from_arrays([ids, *columns], names=[f.name for f in schema.fields])

    return own.groupBy("image_id", "_bx", "_by").applyInArrow(put_together, schema)
