"""Two images, pixel by pixel: an equi-join on image_id, then one pass over both images' arrays.

Joining whole images moves each pixel once and needs no key for coordinates. Both sides must be of one pixel type, unless
the combiner says that it mixes types. Images must agree in size; where they do not, the query fails with SizeMismatch in
its message. Images without a partner are left out; with `paired`, they fail the query with MissingPartner in its message.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.errors import PixelTypeError
from rasterloom.frame import KEYS, ImageFrame
from rasterloom.pixel import PixelType, pixel_type, value_type


class Combiner:
    """Joins one channel of two pixels. `target` is the result's type, given that of the first input."""

    #: Whether the second image may be of another type with as many channels.
    mixes = False

    def target(self, p: PixelType) -> PixelType:
        return p

    def channel(self, a: Column, b: Column, p: PixelType) -> Column:
        raise NotImplementedError


def _wide(p: PixelType, v: Column) -> Column:
    return v.cast(value_type(p))


class PixelAdd(Combiner):
    """a + b, kept within the type."""

    def channel(self, a, b, p):
        return p.saturate(_wide(p, a) + _wide(p, b))


class PixelSubtract(Combiner):
    """a - b, kept within the type (integers stop at 0)."""

    def channel(self, a, b, p):
        return p.saturate(_wide(p, a) - _wide(p, b))


class PixelMultiply(Combiner):
    """a * b, kept within the type."""

    def channel(self, a, b, p):
        return p.saturate(_wide(p, a) * _wide(p, b))


class AbsDiff(Combiner):
    """|a - b|; NaN stays NaN."""

    def channel(self, a, b, p):
        return F.abs(_wide(p, a) - _wide(p, b)).cast(p.sql)


class Min(Combiner):
    """The smaller, channel by channel; integers and booleans."""

    def channel(self, a, b, p):
        if not p.channel.integral:
            raise PixelTypeError(f"Min needs ordered channels; those of {p.name} are not")
        return F.least(a, b)


class Max(Combiner):
    """The larger, channel by channel; integers and booleans."""

    def channel(self, a, b, p):
        if not p.channel.integral:
            raise PixelTypeError(f"Max needs ordered channels; those of {p.name} are not")
        return F.greatest(a, b)


@dataclass(frozen=True)
class LinearCombine(Combiner):
    """b * wb + a * wa in the accumulator; linear types only."""

    wa: float
    wb: float

    def target(self, p):
        p.require_linear(type(self).__name__)
        return p.accumulator()

    def channel(self, a, b, p):
        kind = p.channel.accumulator
        return b.cast(kind) * F.lit(self.wb).cast(kind) + a.cast(kind) * F.lit(self.wa).cast(kind)


@dataclass(frozen=True)
class Blend(Combiner):
    """b * alpha + a * (1 - alpha) in the accumulator; linear types only."""

    alpha: float

    def target(self, p):
        p.require_linear("Blend")
        return p.accumulator()

    def channel(self, a, b, p):
        return blend(a, b, F.lit(self.alpha), p)


def blend(a: Column, b: Column, alpha: Column, p: PixelType) -> Column:
    """One channel of a blend, in the accumulator's precision."""
    kind = p.channel.accumulator
    w = alpha.cast(kind)
    return b.cast(kind) * w + a.cast(kind) * (F.lit(1.0).cast(kind) - w)


class Magnitude(Combiner):
    """sqrt(a^2 + b^2) of float channels, as for gradients."""

    def target(self, p):
        if p.max is not None:
            raise PixelTypeError(f"Magnitude needs float channels; {p.name} has integers")
        return p

    def channel(self, a, b, p):
        return F.hypot(a, b).cast(p.sql)


@dataclass(frozen=True)
class ClosureCombine(Combiner):
    """One's own function of two channels, and the type it gives; with `mixes`, of images of two types."""

    function: Callable[[Column, Column], Column]
    pixel: PixelType
    mixes: bool = False

    def target(self, p):
        return self.pixel

    def channel(self, a, b, p):
        return self.function(a, b).cast(self.pixel.sql)


def zip_pixels(a: ImageFrame, b: ImageFrame, paired: bool = False) -> DataFrame:
    """image_id, width, height, the channels of `a`, and those of `b` as _b_0, _b_1 and so on; sizes must agree."""
    right = b.df.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"), *(F.col(c).alias(f"_b_{k}") for k, c in enumerate(b.pixel.channels)))
    joined = a.df.join(right, "image_id", "full" if paired else "inner")
    same = (F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h"))
    told = lambda what: F.raise_error(F.concat(F.lit(f"{what}: image "), F.col("image_id").cast("string"))).cast("int")
    alone = F.col("width").isNull() | F.col("_w").isNull()
    return joined.withColumn("width", F.when(alone, told("MissingPartner")).when(same, F.col("width")).otherwise(told("SizeMismatch")))


def combine_images(a: ImageFrame, b: ImageFrame, combiner: Combiner, paired: bool = False) -> ImageFrame:
    """Images with the same image_id, combined channel by channel."""
    if a.pixel != b.pixel and not (combiner.mixes and len(a.pixel.channels) == len(b.pixel.channels)):
        raise PixelTypeError(f"{a.pixel.name} and {b.pixel.name} cannot be combined")
    p, out = a.pixel, combiner.target(a.pixel)
    joined = zip_pixels(a, b, paired)
    if len(out.channels) != len(p.channels):
        raise PixelTypeError(f"a combiner of {p.name} gave {out.name}")
    columns = [F.zip_with(c, f"_b_{k}", lambda x, y: combiner.channel(x, y, p)).alias(o) for k, (c, o) in enumerate(zip(p.channels, out.channels, strict=True))]
    return ImageFrame(joined.select(*KEYS, *columns), out)


def combine_images_fn(a: ImageFrame, b: ImageFrame, function: Callable[[Column, Column], Column], pixel: str | PixelType | None = None, mixes: bool = False) -> ImageFrame:
    return combine_images(a, b, ClosureCombine(function, pixel_type(pixel) if pixel is not None else a.pixel, mixes))


def add(a: ImageFrame, b: ImageFrame) -> ImageFrame:
    return combine_images(a, b, PixelAdd())


def subtract(a: ImageFrame, b: ImageFrame) -> ImageFrame:
    return combine_images(a, b, PixelSubtract())


def abs_diff(a: ImageFrame, b: ImageFrame) -> ImageFrame:
    return combine_images(a, b, AbsDiff())


def image_min(a: ImageFrame, b: ImageFrame) -> ImageFrame:
    return combine_images(a, b, Min())


def image_max(a: ImageFrame, b: ImageFrame) -> ImageFrame:
    return combine_images(a, b, Max())
