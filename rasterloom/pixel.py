"""The registry of pixel types: what a channel can hold and which operations its meaning allows.

A pixel type travels with an image frame on the driver; operators ask it before they build a plan, so gamma-encoded
samples are never blended and channel orders never mixed by accident. It costs nothing at run time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.errors import PixelTypeError


def whole(n: int) -> Column:
    """An integer literal of any size: decimal where 64 signed bits do not hold it."""
    return F.lit(n) if abs(n) < 2**63 else F.lit(str(n)).cast("decimal(20,0)")


@dataclass(frozen=True)
class Channel:
    """A primitive: SQL type, byte size, numpy code, largest value (None for floats), and the type of its accumulator."""

    name: str
    sql: str
    nbytes: int
    code: str
    max: int | None
    accumulator: str | None
    integral: bool = True


#: The primitives.
CHANNELS = {
    c.name: c
    for c in (
        Channel("u8", "int", 1, "u1", 2**8 - 1, "float"),
        Channel("u16", "int", 2, "u2", 2**16 - 1, "float"),
        Channel("u32", "bigint", 4, "u4", 2**32 - 1, "double"),
        Channel("u64", "decimal(20,0)", 8, "u8", 2**64 - 1, "double"),
        Channel("i8", "tinyint", 1, "i1", 2**7 - 1, None),
        Channel("i16", "smallint", 2, "i2", 2**15 - 1, None),
        Channel("i32", "int", 4, "i4", 2**31 - 1, None),
        Channel("i64", "bigint", 8, "i8", 2**63 - 1, None),
        Channel("f32", "float", 4, "f4", None, "float", False),
        Channel("f64", "double", 8, "f8", None, "double", False),
        Channel("bool", "boolean", 1, "?", 1, None),
    )
}


@dataclass(frozen=True)
class PixelType:
    """`family` names the channels' meaning and order; `bits` narrows an integer channel (10, 12 or 14 bits in 16)."""

    name: str
    family: str
    channel: Channel
    channels: tuple[str, ...]
    linear: bool = True
    bits: int | None = None

    @property
    def max(self) -> int | None:
        return (1 << self.bits) - 1 if self.bits else self.channel.max

    @property
    def white(self) -> Column:
        """The largest value as a literal; floats have none."""
        if self.max is None:
            raise PixelTypeError(f"{self.name} has no white value")
        return whole(self.max).cast(self.sql)

    @property
    def sql(self) -> str:
        return self.channel.sql

    @property
    def nbytes(self) -> int:
        return self.channel.nbytes * len(self.channels)

    @property
    def alpha(self) -> str | None:
        return "a" if "a" in self.channels else None

    @property
    def full(self) -> Column:
        """Opaque alpha: the largest value, or 1 for floats."""
        return (F.lit(1.0) if self.max is None else whole(self.max)).cast(self.sql)

    @property
    def ordered(self) -> bool:
        """Whether whole pixels have a total order, as rank filters need."""
        return len(self.channels) == 1 and self.channel.integral

    def accumulator(self) -> PixelType:
        """The float type in which this type's sums are kept."""
        if self.channel.accumulator is None:
            raise PixelTypeError(f"{self.name} has no accumulator")
        return pixel_type(f"{self.family}{'F32' if self.channel.accumulator == 'float' else 'F64'}") if self.linear else self._gamma_accumulator()

    def _gamma_accumulator(self) -> PixelType:
        kind = CHANNELS["f32" if self.channel.accumulator == "float" else "f64"]
        return replace(self, name=f"{self.name}Accumulator", channel=kind, bits=None)

    def require_linear(self, what: str) -> None:
        if not self.linear or self.channel.accumulator is None:
            raise PixelTypeError(f"{what} needs a linear pixel type; {self.name} is not")

    def require_ordered(self, what: str) -> None:
        if not self.ordered:
            raise PixelTypeError(f"{what} needs pixels with a total order; {self.name} has none")

    def from_linear(self, value: Column) -> Column:
        """An accumulator value as a channel: rounded half away from zero and clamped; NaN becomes 0 for integers."""
        if self.max is None:
            return value.cast(self.sql)
        v = value.cast("double")
        held = F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(float(self.max)))
        if self.channel.name == "u64":
            exact = F.when(held >= float(2**63), whole(self.max).cast("decimal(20,0)"))
            rounded = F.when(held < float(2**64), held.cast("decimal(20,0)"))
            return F.when(F.isnan(v), F.lit(0).cast(self.sql)).otherwise(F.coalesce(rounded, exact)).cast(self.sql)
        return F.when(F.isnan(v), F.lit(0)).otherwise(held.cast("bigint")).cast(self.sql)

    def to_accumulator(self, value: Column) -> Column:
        if self.channel.accumulator is None:
            raise PixelTypeError(f"{self.name} has no accumulator")
        return value.cast(self.channel.accumulator)

    def saturate(self, value: Column) -> Column:
        """An exact integer result kept within the type; floats pass."""
        if self.max is None:
            return value.cast(self.sql)
        return F.least(F.greatest(value, F.lit(0).cast(value_type(self))), whole(self.max).cast(value_type(self))).cast(self.sql)


def value_type(p: PixelType) -> str:
    """The SQL type wide enough for sums and products of two of the type's channels."""
    return {"u8": "int", "u16": "bigint", "u32": "decimal(38,0)", "u64": "decimal(38,0)"}.get(p.channel.name, p.sql)


_REGISTRY: dict[str, PixelType] = {}


def register(p: PixelType) -> PixelType:
    """Adds a type of one's own."""
    if p.name in _REGISTRY and _REGISTRY[p.name] != p:
        raise PixelTypeError(f"{p.name} is another type already")
    _REGISTRY[p.name] = p
    return p


def pixel_type(name: str | PixelType) -> PixelType:
    if isinstance(name, PixelType):
        return name
    if name not in _REGISTRY:
        raise PixelTypeError(f"no pixel type {name}")
    return _REGISTRY[name]


def _fill() -> None:
    linear = {"Mono": "v", "MonoA": "va", "Rgb": "rgb", "Rgba": "rgba", "Bgr": "bgr", "Bgra": "bgra"}
    for family, names in linear.items():
        for kind in ("u8", "u16", "u32", "u64", "f32", "f64"):
            suffix = kind.upper() if kind[0] == "f" else kind[1:]
            register(PixelType(f"{family}{suffix}", family, CHANNELS[kind], tuple(names)))
        if family != "MonoA":
            for bits in (10, 12, 14):
                register(PixelType(f"{family}{bits}", family, CHANNELS["u16"], tuple(names), bits=bits))
    gamma = {"Srgb": "rgb", "Srgba": "rgba", "SrgbMono": "v", "SrgbMonoA": "va", "SrgbBgr": "bgr", "SrgbBgra": "bgra"}
    for family, names in gamma.items():
        for kind in ("u8", "u16"):
            register(PixelType(f"{family}{kind[1:]}", family, CHANNELS[kind], tuple(names), linear=False))
    register(PixelType("Indexed8", "Indexed", CHANNELS["u8"], ("v",), linear=False))
    register(PixelType("Label32", "Label", CHANNELS["u32"], ("v",), linear=False))
    register(PixelType("Bool", "Bool", CHANNELS["bool"], ("v",), linear=False))


_fill()

#: Largest label of the label type; 0 is the background.
MAX_LABEL = 2**32 - 1


def registered() -> list[PixelType]:
    return sorted(_REGISTRY.values(), key=lambda p: p.name)
