"""Per-pixel conversions as Column expressions.

A strategy turns the channels of a pixel, as Columns, into those of the target type. It knows which pairs of types
it serves and refuses the rest when the plan is built. The same strategy works on pixel rows (a projection, fully
code-generated), on image frames (array lambdas, no shuffle) and on streams.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.errors import PixelTypeError
from rasterloom.pixel import PixelType, pixel_type, whole

Pixel = Mapping[str, Column]

_STANDARD = ("u8", "u16", "u32", "u64", "f32", "f64")


class Strategy:
    """A conversion. `target` names the result type, `apply` builds its channels."""

    def target(self, src: PixelType, dst: PixelType | None) -> PixelType:
        """The result type, given the type asked for (None: the natural one); raises PixelTypeError for pairs not served."""
        if dst is not None and dst != src:
            raise PixelTypeError(f"{type(self).__name__} does not turn {src.name} into {dst.name}")
        return src

    def apply(self, pixel: Pixel, src: PixelType, dst: PixelType) -> dict[str, Column]:
        return {c: self.channel(pixel[c], src, dst) for c in src.channels}

    def channel(self, value: Column, src: PixelType, dst: PixelType) -> Column:
        raise NotImplementedError

    def then(self, after: Strategy, mid: str | PixelType | None = None) -> Then:
        """This conversion, then another, in one pass."""
        return Then(self, after, pixel_type(mid) if mid is not None else None)

    def _refuse(self, src: PixelType, dst: PixelType | None) -> None:
        raise PixelTypeError(f"{type(self).__name__} does not turn {src.name} into {dst.name if dst else 'anything'}")


@dataclass(frozen=True)
class Then(Strategy):
    first: Strategy
    second: Strategy
    mid: PixelType | None = None

    def target(self, src, dst):
        return self.second.target(self.first.target(src, self.mid), dst)

    def apply(self, pixel, src, dst):
        mid = self.first.target(src, self.mid)
        return self.second.apply(self.first.apply(pixel, src, mid), mid, dst)


def _exact_div(n: Column, by: int) -> Column:
    """Integer quotient of non-negative decimals, exact beyond 64 bits."""
    d = whole(by).cast("decimal(38,0)")
    return ((n - n % d) / d).cast("decimal(38,0)")


def scaled(value: Column, a: PixelType, b: PixelType) -> Column:
    """A channel of range a as one of range b, so that the extremes meet."""
    if a.max is not None and b.max is not None:
        if a.max == b.max:
            return value.cast(b.sql)
        if b.max % a.max == 0:
            factor = b.max // a.max
            if b.channel.name == "u64":
                return (value.cast("decimal(38,0)") * whole(factor).cast("decimal(20,0)")).cast(b.sql)
            return (value.cast("bigint") * factor).cast(b.sql)
        if a.max % b.max == 0:
            factor = a.max // b.max
            if a.channel.name == "u64":
                return _exact_div(value.cast("decimal(38,0)") + whole(factor // 2), factor).cast(b.sql)
            return F.floor((value.cast("bigint") + factor // 2) / F.lit(factor)).cast(b.sql) if factor < 2**20 else _exact_div(value.cast("decimal(38,0)") + whole(factor // 2), factor).cast(b.sql)
        return _exact_div(value.cast("decimal(38,0)") * whole(b.max).cast("decimal(20,0)") + whole(a.max // 2), a.max).cast(b.sql)
    if a.max is not None:  # to a float
        if b.sql == "float" and a.channel.name != "u64":
            return (value.cast("float") / F.lit(float(a.max)).cast("float")).cast("float")
        return (value.cast("double") / float(a.max)).cast(b.sql)
    if b.max is None:
        return value.cast(b.sql)
    # a float to an integer: clamped, plus a half, cut off; NaN is 0. Products stay in the source's precision up to 16 bits.
    wide = "double" if a.sql == "double" or b.channel.name in ("u32", "u64") else "float"
    held = F.greatest(F.lit(0.0).cast(wide), F.least(F.lit(1.0).cast(wide), value.cast(wide)))
    x = F.floor(held * F.lit(float(b.max)).cast(wide) + F.lit(0.5).cast(wide))
    if b.channel.name == "u64":
        full = held * F.lit(float(b.max)) + 0.5
        big = F.when(full >= float(2**64), whole(b.max).cast("decimal(20,0)")).when(full < float(2**53), F.floor(F.least(full, F.lit(float(2**53)))).cast("decimal(20,0)")).otherwise(F.least(full, F.lit(float(2**64) - 2048.0)).cast("decimal(20,0)"))
        return F.when(F.isnan(value), F.lit(0).cast(b.sql)).otherwise(big)
    top = F.least(x, F.lit(min(b.max, 2**63 - 1)))
    return F.when(F.isnan(value), F.lit(0)).otherwise(top).cast(b.sql)


class FullRange(Strategy):
    """Depth to depth so that black stays black and white white. Linear types of one family; Mono of 10 to 14 bits widens."""

    def target(self, src, dst):
        narrow_source = src.bits is not None and src.family == "Mono"
        if dst is None or not src.linear or src.family != dst.family or src.channel.name not in _STANDARD or dst.channel.name not in _STANDARD:
            self._refuse(src, dst)
        if dst.bits is not None or (src.bits is not None and not narrow_source):
            self._refuse(src, dst)
        return dst

    def channel(self, value, src, dst):
        return scaled(value, src, dst)


class Narrow(Strategy):
    """Values as they are; what does not fit becomes the largest value. Integer types of one family."""

    def target(self, src, dst):
        if dst is None or not src.linear or src.family != dst.family or src.max is None or dst.max is None:
            self._refuse(src, dst)
        if (src.bits or dst.bits) and src.family != "Mono":
            self._refuse(src, dst)
        return dst

    def channel(self, value, src, dst):
        if dst.max >= src.max:
            return value.cast(dst.sql)
        return F.least(value, whole(dst.max).cast(src.sql)).cast(dst.sql)


_COLOUR = {"Rgb": "Mono", "Bgr": "Mono", "Rgba": "MonoA", "Bgra": "MonoA"}


class Luminance(Strategy):
    """BT.601 luma: (77 r + 150 g + 29 b + 128) >> 8 for integers, weighted floats else. Alpha is dropped or kept, as the target asks."""

    def target(self, src, dst):
        if src.family not in _COLOUR or src.bits or src.channel.name not in _STANDARD:
            self._refuse(src, dst)
        suffix = src.name[len(src.family) :]
        fits = [pixel_type("Mono" + suffix)] + ([pixel_type("MonoA" + suffix)] if src.alpha else [])
        if dst is None:
            return fits[0]
        if dst not in fits:
            self._refuse(src, dst)
        return dst

    def apply(self, pixel, src, dst):
        r, g, b = pixel["r"], pixel["g"], pixel["b"]
        if src.max is None:
            w = [F.lit(x).cast(src.sql) for x in (0.299, 0.587, 0.114)]
            out = {"v": (w[0] * r + w[1] * g + w[2] * b).cast(dst.sql)}
        elif src.channel.name == "u64":
            d = [c.cast("decimal(30,0)") for c in (r, g, b)]
            out = {"v": _exact_div((d[0] * 77 + d[1] * 150 + d[2] * 29 + 128).cast("decimal(38,0)"), 256).cast(dst.sql)}
        else:
            d = [c.cast("bigint") for c in (r, g, b)]
            out = {"v": F.shiftright(d[0] * 77 + d[1] * 150 + d[2] * 29 + 128, 8).cast(dst.sql)}
        if dst.alpha:
            out["a"] = pixel["a"]
        return out


class Broadcast(Strategy):
    """Grey to colour: the value in every colour channel; alpha is kept, or full where the target alone has it."""

    def target(self, src, dst):
        wanted = {"Mono": ("Rgb", "Bgr", "Rgba", "Bgra"), "MonoA": ("Rgba", "Bgra")}.get(src.family, ())
        if dst is None or dst.family not in wanted or dst.channel != src.channel or src.bits or dst.bits:
            self._refuse(src, dst)
        return dst

    def apply(self, pixel, src, dst):
        out = {c: pixel["v"] for c in dst.channels}
        if dst.alpha:
            out["a"] = pixel["a"] if src.alpha else dst.full
        return out


_SWAPPED = {"Rgb": "Bgr", "Rgba": "Bgra", "Srgb": "SrgbBgr", "Srgba": "SrgbBgra"}
_SWAPPED |= {v: k for k, v in _SWAPPED.items()}


class ColorSwap(Strategy):
    """RGB to BGR order and back."""

    def target(self, src, dst):
        if src.family not in _SWAPPED or src.bits:
            self._refuse(src, dst)
        out = pixel_type(_SWAPPED[src.family] + src.name[len(src.family) :])
        if dst not in (None, out):
            self._refuse(src, dst)
        return out

    def apply(self, pixel, src, dst):
        return {c: pixel[c] for c in dst.channels}


_OPAQUE = {"Rgb": "Rgba", "Bgr": "Bgra", "Mono": "MonoA", "Srgb": "Srgba", "SrgbMono": "SrgbMonoA", "SrgbBgr": "SrgbBgra"}


class AddAlpha(Strategy):
    """Adds full alpha."""

    def target(self, src, dst):
        if src.family not in _OPAQUE or src.bits:
            self._refuse(src, dst)
        out = pixel_type(_OPAQUE[src.family] + src.name[len(src.family) :])
        if dst not in (None, out):
            self._refuse(src, dst)
        return out

    def apply(self, pixel, src, dst):
        return {**{c: pixel[c] for c in src.channels}, "a": dst.full}


_GAMMA = {"Srgb": "Rgb", "Srgba": "Rgba", "SrgbMono": "Mono", "SrgbMonoA": "MonoA", "SrgbBgr": "Bgr", "SrgbBgra": "Bgra"}
_LINEAR = {v: k for k, v in _GAMMA.items()}


def srgb_to_linear(s: Column) -> Column:
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


class SrgbGamma(Strategy):
    """sRGB integers to linear f32 and back; alpha is linear on either side. Worked out in double precision."""

    def target(self, src, dst):
        if src.family in _GAMMA:
            out = pixel_type(_GAMMA[src.family] + "F32")
            if dst not in (None, out):
                self._refuse(src, dst)
            return out
        if src.family not in _LINEAR or src.channel.name != "f32" or dst is None or dst.family != _LINEAR[src.family]:
            self._refuse(src, dst)
        return dst

    def apply(self, pixel, src, dst):
        out = {}
        for c in src.channels:
            v = pixel[c]
            if c == "a":
                out[c] = scaled(v, src, dst)
            elif src.max is not None:
                out[c] = srgb_to_linear(v.cast("double") / float(src.max)).cast("float")
            else:
                held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double")))
                out[c] = F.when(F.isnan(v), F.lit(0)).otherwise(F.least(F.floor(linear_to_srgb(held) * float(dst.max) + 0.5), F.lit(dst.max).cast("bigint"))).cast(dst.sql)
        return out


def _per_channel(value, src: PixelType, what: str) -> dict[str, Column]:
    """A threshold or bound for each channel, from a number, a sequence or a mapping."""
    if isinstance(value, Mapping):
        given = dict(value)
    elif isinstance(value, Sequence):
        if len(value) != len(src.channels):
            raise PixelTypeError(f"{what}: {len(value)} values for {len(src.channels)} channels")
        given = dict(zip(src.channels, value, strict=True))
    else:
        given = dict.fromkeys(src.channels, value)
    return {c: (v if isinstance(v, Column) else F.lit(v)).cast(src.sql) for c, v in given.items()}


@dataclass(frozen=True)
class _Threshold(Strategy):
    thresh: object

    def target(self, src, dst):
        if self._white and src.max is None:
            raise PixelTypeError(f"{type(self).__name__} needs a white value; {src.name} has none")
        return super().target(src, dst)

    _white = False

    def apply(self, pixel, src, dst):
        t = _per_channel(self.thresh, src, type(self).__name__)
        return {c: self.pick(pixel[c], t[c], src) for c in src.channels}


class BinaryThreshold(_Threshold):
    """v > t: white, else 0; every channel, alpha too."""

    _white = True

    def pick(self, v, t, src):
        return F.when(v > t, src.white).otherwise(F.lit(0).cast(src.sql))


class BinaryThresholdInv(_Threshold):
    """v > t: 0, else white."""

    _white = True

    def pick(self, v, t, src):
        return F.when(v > t, F.lit(0).cast(src.sql)).otherwise(src.white)


class TruncateThreshold(_Threshold):
    """min(v, t)."""

    def pick(self, v, t, src):
        return F.when(v > t, t).otherwise(v)


class ToZeroThreshold(_Threshold):
    """v > t: v, else 0."""

    def pick(self, v, t, src):
        return F.when(v > t, v).otherwise(F.lit(0).cast(src.sql))


class ToZeroThresholdInv(_Threshold):
    """v > t: 0, else v."""

    def pick(self, v, t, src):
        return F.when(v > t, F.lit(0).cast(src.sql)).otherwise(v)


@dataclass(frozen=True)
class BinaryMask(Strategy):
    """True where every channel is above its threshold."""

    thresh: object

    def target(self, src, dst):
        out = pixel_type("Bool")
        if dst not in (None, out):
            self._refuse(src, dst)
        return out

    def apply(self, pixel, src, dst):
        t = _per_channel(self.thresh, src, "BinaryMask")
        above = F.lit(True)
        for c in src.channels:
            above = above & (pixel[c] > t[c])
        return {"v": above}


class Invert(Strategy):
    """white - v in every channel, alpha too; not for floats."""

    def target(self, src, dst):
        if src.max is None or src.channel.name == "bool":
            self._refuse(src, dst)
        return super().target(src, dst)

    def channel(self, value, src, dst):
        return (src.white - value).cast(src.sql)


@dataclass(frozen=True)
class Clamp(Strategy):
    """Every channel kept between lo and hi."""

    lo: object
    hi: object

    def __post_init__(self) -> None:
        pairs = zip(self.lo, self.hi, strict=True) if isinstance(self.lo, Sequence) else [(self.lo, self.hi)]
        if any(a > b for a, b in pairs):
            raise ValueError("Clamp: lo exceeds hi")

    def apply(self, pixel, src, dst):
        lo, hi = _per_channel(self.lo, src, "Clamp"), _per_channel(self.hi, src, "Clamp")
        return {c: F.when(pixel[c] < lo[c], lo[c]).when(pixel[c] > hi[c], hi[c]).otherwise(pixel[c]) for c in src.channels}


@dataclass(frozen=True)
class BrightnessContrast(Strategy):
    """contrast * v + brightness in the accumulator, rounded and clamped back."""

    brightness: float = 0.0
    contrast: float = 1.0

    def target(self, src, dst):
        src.require_linear("BrightnessContrast")
        return super().target(src, dst)

    def channel(self, value, src, dst):
        kind = src.channel.accumulator
        return src.from_linear(value.cast(kind) * F.lit(self.contrast).cast(kind) + F.lit(self.brightness).cast(kind))


@dataclass(frozen=True)
class Lut(Strategy):
    """A table of 256 pixels of any type, looked up by a Mono8 value."""

    table: tuple
    pixel: PixelType

    @classmethod
    def of(cls, table: Sequence, pixel: str | PixelType) -> Lut:
        p = pixel_type(pixel)
        rows = tuple(tuple(r) if isinstance(r, Sequence) else (r,) for r in table)
        if len(rows) != 256 or any(len(r) != len(p.channels) for r in rows):
            raise ValueError("a table has 256 entries, each with all channels")
        return cls(rows, p)

    @classmethod
    def from_fn(cls, f: Callable[[int], object], pixel: str | PixelType) -> Lut:
        return cls.of([f(i) for i in range(256)], pixel)

    def lookup(self, i: int):
        row = self.table[i]
        return row[0] if len(row) == 1 else row

    def target(self, src, dst):
        if src.name != "Mono8" or dst not in (None, self.pixel):
            self._refuse(src, dst)
        return self.pixel

    def apply(self, pixel, src, dst):
        return {c: F.get(F.lit([r[k] for r in self.table]).cast(f"array<{dst.sql}>"), pixel["v"]) for k, c in enumerate(dst.channels)}


@dataclass(frozen=True)
class ChannelLut(Strategy):
    """A table of 256 bytes, looked up by every channel of an 8-bit pixel."""

    table: tuple[int, ...]

    def __post_init__(self) -> None:
        if len(self.table) != 256 or not all(0 <= v <= 255 for v in self.table):
            raise ValueError("a table has 256 entries of 0 to 255")

    @classmethod
    def from_fn(cls, f: Callable[[int], int]) -> ChannelLut:
        return cls(tuple(f(i) for i in range(256)))

    def lookup(self, i: int) -> int:
        return self.table[i]

    def target(self, src, dst):
        if src.channel.name != "u8" or src.family == "Indexed":
            self._refuse(src, dst)
        return super().target(src, dst)

    def channel(self, value, src, dst):
        return F.get(F.lit(list(self.table)).cast("array<int>"), value)


@dataclass(frozen=True)
class Depalettize(Strategy):
    """Indexed8 to the pixels of a palette; indices beyond it are zero."""

    palette: tuple
    pixel: PixelType

    @classmethod
    def of(cls, palette: Sequence, pixel: str | PixelType) -> Depalettize:
        if len(palette) > 256:
            raise ValueError("a palette has 256 entries at most")
        p = pixel_type(pixel)
        zero = (0,) * len(p.channels)
        rows = [tuple(r) if isinstance(r, Sequence) else (r,) for r in palette]
        return cls(tuple(rows + [zero] * (256 - len(rows))), p)

    def target(self, src, dst):
        if src.family != "Indexed" or dst not in (None, self.pixel):
            self._refuse(src, dst)
        return self.pixel

    def apply(self, pixel, src, dst):
        return {c: F.get(F.lit([r[k] for r in self.palette]).cast(f"array<{dst.sql}>"), pixel["v"]) for k, c in enumerate(dst.channels)}


@dataclass(frozen=True)
class PixelMap(Strategy):
    """One's own function of a pixel: takes and returns channels as Columns, so the optimiser sees through it."""

    function: Callable[[Pixel], Mapping[str, Column]]
    pixel: PixelType

    @classmethod
    def of(cls, function: Callable[[Pixel], Mapping[str, Column]], pixel: str | PixelType) -> PixelMap:
        return cls(function, pixel_type(pixel))

    def target(self, src, dst):
        if dst not in (None, self.pixel):
            self._refuse(src, dst)
        return self.pixel

    def apply(self, pixel, src, dst):
        out = self.function(pixel)
        return {c: out[c].cast(dst.sql) for c in dst.channels}


def into(value: Column, src: PixelType, dst: PixelType) -> Column:
    """The lossless change of container that nearest-neighbour resizing applies: the same number, under a type that can hold it."""
    same = src.channels == dst.channels and src.linear == dst.linear
    if not same or (src.max is not None and dst.max is not None and dst.max < src.max) or (src.max is None and (dst.max is not None or src.channel.nbytes > dst.channel.nbytes)):
        raise PixelTypeError(f"{src.name} does not fit {dst.name}")
    return value.cast(dst.sql)

