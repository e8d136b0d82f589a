"""Neighbourhoods: kernels, border policies, and the two ways in which windowed operators are run.

Those that accumulate (operators.engine) run kernel cells outside and whole rows inside, on arrays padded by the border
policy. A closure of Columns gets array reads instead: for every output pixel each active kernel cell becomes
`get(channel, index)`, its index mapped by the border policy. Cells come in row-major order in both, so float sums add
up in that order, and both are one narrow step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.errors import BorderError
from rasterloom.frame import ImageFrame, bound, grid
from rasterloom.operators import engine
from rasterloom.operators.arrays import per_stack
from rasterloom.pixel import PixelType, pixel_type


@dataclass(frozen=True)
class Kernel:
    """Weights by row, and the anchor cell (x, y) that lies on the output pixel."""

    width: int
    height: int
    data: tuple
    anchor: tuple[int, int]

    @classmethod
    def of(cls, rows, anchor: tuple[int, int] | None = None) -> Kernel:
        rows = [list(r) for r in rows]
        height, width = len(rows), len(rows[0]) if rows else 0
        if not height or not width or any(len(r) != width for r in rows):
            raise ValueError("a kernel is a non-empty rectangle")
        at = anchor if anchor is not None else (width // 2, height // 2)
        if not (0 <= at[0] < width and 0 <= at[1] < height):
            raise ValueError("the anchor lies outside the kernel")
        return cls(width, height, tuple(v for r in rows for v in r), at)

    def positions(self) -> list[tuple[int, int, object]]:
        """(dx, dy, weight) of every cell, row by row, relative to the anchor."""
        return [(i % self.width - self.anchor[0], i // self.width - self.anchor[1], w) for i, w in enumerate(self.data)]

    def flipped(self) -> Kernel:
        """Turned by 180 degrees, the anchor with it."""
        return Kernel(self.width, self.height, self.data[::-1], (self.width - 1 - self.anchor[0], self.height - 1 - self.anchor[1]))

    def rows(self) -> list[tuple]:
        return [self.data[k * self.width : (k + 1) * self.width] for k in range(self.height)]

    def separated(self) -> SeparableKernel | None:
        """Two one-dimensional kernels whose product this is, if it has rank one."""
        rows = self.rows()
        pivot = next((r for r in rows if any(r)), None)
        if pivot is None:
            return None
        at = next(k for k, v in enumerate(pivot) if v)
        column = [r[at] / pivot[at] for r in rows]
        if any(abs(r[k] - column[j] * pivot[k]) > 1e-12 for j, r in enumerate(rows) for k in range(self.width)):
            return None
        return SeparableKernel(Kernel.of([pivot], (self.anchor[0], 0)), Kernel.of([[v] for v in column], (0, self.anchor[1])))


@dataclass(frozen=True)
class SeparableKernel:
    """A row and a column, applied in turn."""

    horizontal: Kernel
    vertical: Kernel

    @classmethod
    def of(cls, horizontal, vertical, anchors: tuple[int, int] | None = None) -> SeparableKernel:
        ax, ay = anchors if anchors is not None else (len(horizontal) // 2, len(vertical) // 2)
        return cls(Kernel.of([horizontal], (ax, 0)), Kernel.of([[v] for v in vertical], (0, ay)))

    @classmethod
    def symmetric(cls, taps) -> SeparableKernel:
        return cls.of(taps, taps)

    def flipped(self) -> SeparableKernel:
        return SeparableKernel(self.horizontal.flipped(), self.vertical.flipped())


def _full(width: int, height: int, value) -> Kernel:
    return Kernel.of([[value] * width] * height)


def _transposed(k: Kernel) -> Kernel:
    return Kernel.of(list(zip(*k.rows(), strict=True)))


#: The predefined kernels. Those named after x hold the vertical gradient and the other way round.
BOX_BLUR_3X3 = _full(3, 3, 1 / 9)
GAUSSIAN_3X3 = Kernel.of([[1, 2, 1], [2, 4, 2], [1, 2, 1]])
SOBEL_X = Kernel.of([[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
SOBEL_Y = _transposed(SOBEL_X)
SCHARR_X = Kernel.of([[-3, -10, -3], [0, 0, 0], [3, 10, 3]])
SCHARR_Y = _transposed(SCHARR_X)
PREWITT_X = Kernel.of([[-1, -1, -1], [0, 0, 0], [1, 1, 1]])
PREWITT_Y = _transposed(PREWITT_X)
LAPLACIAN = Kernel.of([[0, -1, 0], [-1, 4, -1], [0, -1, 0]])
LAPLACIAN_8 = Kernel.of([[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]])
SHARPEN = Kernel.of([[0, -1, 0], [-1, 5, -1], [0, -1, 0]])
IDENTITY_3X3 = Kernel.of([[0, 0, 0], [0, 1, 0], [0, 0, 0]])
EMBOSS = Kernel.of([[-2, -1, 0], [-1, 1, 1], [0, 1, 2]])
GAUSSIAN_5X5 = Kernel.of([[a * b for b in (1, 4, 6, 4, 1)] for a in (1, 4, 6, 4, 1)])
BOX_BLUR_5X5 = _full(5, 5, 1 / 25)
IDENTITY_5X5 = Kernel.of([[int(x == y == 2) for x in range(5)] for y in range(5)])
GAUSSIAN_3, GAUSSIAN_5 = SeparableKernel.symmetric([1, 2, 1]), SeparableKernel.symmetric([1, 4, 6, 4, 1])
BOX_3, BOX_5 = SeparableKernel.symmetric([1 / 3] * 3), SeparableKernel.symmetric([1 / 5] * 5)
FULL_RECT_3X3, FULL_RECT_5X5 = _full(3, 3, True), _full(5, 5, True)
CROSS_3X3 = Kernel.of([[x == 1 or y == 1 for x in range(3)] for y in range(3)])
DIAMOND_3X3 = CROSS_3X3
CROSS_5X5 = Kernel.of([[x == 2 or y == 2 for x in range(5)] for y in range(5)])
DIAMOND_5X5 = Kernel.of([[abs(x - 2) + abs(y - 2) <= 2 for x in range(5)] for y in range(5)])
CIRCLE_5X5 = Kernel.of([[not (x in (0, 4) and y in (0, 4)) for x in range(5)] for y in range(5)])


class Border:
    """What lies outside: a map of coordinates, or a value. `full` policies keep the frame's size."""

    full = True

    def place(self, at: Column, n: Column) -> Column:
        """The coordinate inside 0..n-1 that stands for `at`."""
        raise NotImplementedError

    def outside(self, p: PixelType, channel: str) -> Column | None:
        """The value of pixels outside, if they have one."""
        return None

    def locate(self, at: np.ndarray, n: int) -> np.ndarray:
        """`place` for arrays of coordinates; a policy that has it runs in the engine."""
        raise NotImplementedError

    def fill(self, p: PixelType, channel: str) -> object | None:
        """`outside` as a plain value."""
        return None

    @property
    def in_engine(self) -> bool:
        """Whether what `place` and `outside` say is said for arrays too."""
        kind = type(self)
        return (kind.locate is not Border.locate or kind.fill is not Border.fill) and (kind.outside is Border.outside or kind.fill is not Border.fill)


class Skip(Border):
    """Only pixels whose whole neighbourhood lies inside; the result shrinks and starts at (0, 0) again."""

    full = False

    def place(self, at, n):
        return at

    def locate(self, at, n):
        return at


class ClampBorder(Border):
    """The nearest pixel of the edge."""

    def place(self, at, n):
        return F.least(F.greatest(at, F.lit(0)), n - 1)

    def locate(self, at, n):
        return np.clip(at, 0, n - 1)


class Mirror(Border):
    """Reflection that does not repeat the edge."""

    def place(self, at, n):
        period = F.greatest((n - 1) * 2, F.lit(1))
        folded = F.pmod(at, period)
        return F.when(n == 1, 0).otherwise(F.least(folded, period - folded))

    def locate(self, at, n):
        period = max(2 * (n - 1), 1)
        return np.minimum(at % period, period - at % period) if n > 1 else np.zeros_like(at)


class Wrap(Border):
    """The opposite side."""

    def place(self, at, n):
        return F.pmod(at, n)

    def locate(self, at, n):
        return at % n


@dataclass(frozen=True)
class Constant(Border):
    """A fixed pixel; a number, or a tuple of channels."""

    value: object

    def place(self, at, n):
        return at

    def _own(self, p: PixelType, channel: str) -> object:
        return self.value[p.channels.index(channel)] if isinstance(self.value, tuple | list) else self.value

    def outside(self, p, channel):
        return F.lit(self._own(p, channel)).cast(p.sql)

    def fill(self, p, channel):
        v = self._own(p, channel)
        return bool(v) if p.sql == "boolean" else int(v) if p.channel.integral else float(v)


def require_full(border: Border, what: str) -> None:
    if not border.full:
        raise BorderError(f"{what} needs a border policy that keeps the frame")


def output_size(border: Border, kernel: Kernel) -> tuple[Column, Column]:
    """Width and height of the result; nothing is left where a kernel exceeds the image under Skip."""
    w, h = F.col("width"), F.col("height")
    if border.full:
        return w, h
    nw, nh = w - (kernel.width - 1), h - (kernel.height - 1)
    some = (nw > 0) & (nh > 0)
    return F.when(some, nw).otherwise(0), F.when(some, nh).otherwise(0)


Tap = tuple[int, int, object, Column]


def window(frame: ImageFrame, kernel: Kernel, border: Border, channel: str, value: Callable[[list[Tap], Column], Column], active: Callable[[object], bool] = lambda w: True) -> Column:
    """The array of value(taps, centre) over all output pixels; taps are (dx, dy, weight, sample) in row-major order."""
    w, h = F.col("width"), F.col("height")
    shift = (0, 0) if border.full else kernel.anchor
    cells = [c for c in kernel.positions() if active(c[2])]
    fill = border.outside(frame.pixel, channel)

    def at(own: Column, x: Column, y: Column) -> Column:
        cx, cy = x + shift[0], y + shift[1]

        def sample(dx: int, dy: int) -> Column:
            sx, sy = cx + dx, cy + dy
            if border.full and fill is None:
                sx, sy = (border.place(sx, w) if dx else cx), (border.place(sy, h) if dy else cy)
            got = F.get(own, (sy * w + sx).cast("int"))
            if fill is None:
                return got
            return F.when((sx >= 0) & (sx < w) & (sy >= 0) & (sy < h), got).otherwise(fill)

        return value([(dx, dy, weight, sample(dx, dy)) for dx, dy, weight in cells], F.get(own, (cy * w + cx).cast("int")))

    ow, oh = output_size(border, kernel)
    return bound(F.col(channel), lambda own: grid(ow, oh, lambda x, y: at(own, x, y)))


def in_rows(frame: ImageFrame, border: Border, pixel: str | PixelType, step: Callable[[np.ndarray, object], np.ndarray]) -> ImageFrame:
    """step(channel, fill) of every channel of images of one size, stacked, where they lie; `fill` is what the border has outside, if anything."""
    if not border.in_engine:
        raise BorderError(f"{type(border).__name__} does not say where arrays of coordinates lie")
    out, fills = pixel_type(pixel), [border.fill(frame.pixel, c) for c in frame.pixel.channels]
    return per_stack(frame, out, lambda channels: [step(own, fill) for own, fill in zip(channels, fills, strict=True)])


def fold_neighborhood(frame: ImageFrame, kernel: Kernel, border: Border, fold: engine.FoldOp | Callable[[list[Tap]], Column], pixel: str | PixelType) -> ImageFrame:
    """Each channel's weighted neighbourhood folded by one's own accumulator, or by a function of the ordered taps."""
    p = pixel_type(pixel)
    if isinstance(fold, engine.FoldOp):
        return in_rows(frame, border, p, lambda own, fill: engine.folded(own, kernel, border, fill, fold))
    columns = {o: window(frame, kernel, border, c, lambda taps, _: fold(taps).cast(p.sql)) for c, o in zip(frame.pixel.channels, p.channels, strict=True)}
    return frame.with_channels(columns, p, *output_size(border, kernel))


def map_neighborhood(frame: ImageFrame, mask: Kernel, border: Border, op: engine.MapOp | Callable[[Column, list[Tap]], Column], pixel: str | PixelType | None = None) -> ImageFrame:
    """Each channel's masked neighbourhood, with its centre, through one's own accumulator or function."""
    p = pixel_type(pixel) if pixel is not None else frame.pixel
    if isinstance(op, engine.MapOp):
        return in_rows(frame, border, p, lambda own, fill: engine.mapped(own, mask, border, fill, op))
    columns = {o: window(frame, mask, border, c, lambda taps, centre: op(centre, taps).cast(p.sql), bool) for c, o in zip(frame.pixel.channels, p.channels, strict=True)}
    return frame.with_channels(columns, p, *output_size(border, mask))


def weighted_sum(kind: str, finite: bool = True) -> Callable[[list[Tap]], Column]:
    """engine.WeightedSum as a function of taps, for borders that only place Columns."""

    def fold(taps: list[Tap]) -> Column:
        parts = [s.cast(kind) * F.lit(float(w)).cast(kind) for _, _, w, s in taps if w or not finite]
        return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0).cast(kind)

    return fold
