"""Arithmetic of single channels as Column expressions, by pixel type.

Integer results stay within their type instead of wrapping; floats follow IEEE. Everything is built in, so whole-stage
code generation covers it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.errors import PixelTypeError
from rasterloom.pixel import MAX_LABEL, PixelType, value_type


def _wide(v: Column, p: PixelType) -> Column:
    return v.cast(value_type(p))


def saturating_add(a: Column, b: Column, p: PixelType) -> Column:
    return p.saturate(_wide(a, p) + _wide(b, p))


def saturating_sub(a: Column, b: Column, p: PixelType) -> Column:
    return p.saturate(_wide(a, p) - _wide(b, p))


def saturating_mul(a: Column, b: Column, p: PixelType) -> Column:
    return p.saturate(_wide(a, p) * _wide(b, p))


def saturating_div(a: Column, b: Column, p: PixelType) -> Column:
    """Whole quotients of integers; division by zero fails the query. Floats divide."""
    if p.max is None:
        quotient = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
        by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).otherwise(F.signum(a.cast("double")) * float("inf"))
        return F.coalesce(quotient, by_zero).cast(p.sql)
    wide_a, wide_b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    safe = F.when(wide_b == 0, F.raise_error(F.lit("division by zero")).cast("decimal(38,0)")).otherwise(wide_b)
    return ((wide_a - wide_a % safe) / safe).cast(p.sql)


def times_float(v: Column, factor: Column | float, p: PixelType) -> Column:
    """An integer channel times a float: rounded, and kept within the type (negative products are 0)."""
    f = factor if isinstance(factor, Column) else F.lit(factor)
    return p.from_linear(p.to_accumulator(v) * f.cast(p.channel.accumulator))


def magnitude(v: Column) -> Column:
    return F.abs(v)


def scale(v: Column, factor: Column | float, p: PixelType) -> Column:
    """factor * v in the accumulator."""
    f = factor if isinstance(factor, Column) else F.lit(factor)
    return p.to_accumulator(v) * f.cast(p.channel.accumulator)


def scale_add(v: Column, factor: Column | float, addend: Column, p: PixelType) -> Column:
    """factor * v + addend in the accumulator."""
    return scale(v, factor, p) + addend.cast(p.channel.accumulator)


def uniform(value: float, p: PixelType) -> dict[str, Column]:
    """The accumulator pixel with the same value in every channel."""
    kind = p.channel.accumulator
    if kind is None:
        raise PixelTypeError(f"{p.name} has no accumulator")
    return {c: F.lit(value).cast(kind) for c in p.channels}


def channel(pixel: Column, index: int, p: PixelType) -> Column:
    """Channel number `index` of a pixel struct."""
    return pixel[p.channels[index]]


def set_channel(pixel: Column, index: int, value: Column, p: PixelType) -> Column:
    return pixel.withField(p.channels[index], value.cast(p.sql))


def from_channels(values: list[Column], p: PixelType) -> Column:
    if len(values) != len(p.channels):
        raise PixelTypeError(f"{p.name} has {len(p.channels)} channels")
    return F.struct(*(v.cast(p.sql).alias(c) for v, c in zip(values, p.channels, strict=True)))


def to_channels(pixel: Column, p: PixelType) -> Column:
    return F.array(*(pixel[c] for c in p.channels))


def from_label_index(index: Column) -> Column:
    """A component number as a label pixel; fails the query beyond the largest label."""
    i = index.cast("bigint")
    return F.when((i >= 0) & (i <= MAX_LABEL), i).otherwise(F.raise_error(F.lit("LabelOverflow")).cast("bigint"))


def to_label_index(label: Column) -> Column:
    return label.cast("bigint")
