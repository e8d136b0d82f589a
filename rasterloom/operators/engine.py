"""The engine of windowed operators: kernel cells outside, whole rows of an image inside.

An image is padded once by its border policy; a kernel cell is then a view of the padded array, the same for all output
pixels, and what an operator does with it is one array operation. Rows are taken a band at a time, so that a band's state stays
near the processor. Neither the plan nor the work a pixel depends on how the kernel is written.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from rasterloom.pixel import PixelType

#: Samples of a band.
BAND = 1 << 15


class FoldOp:
    """A weighted neighbourhood folded step by step: init, then accumulate for every cell in row-major order, then finalize.

    States and samples are arrays of one shape (images of one size, a band of their rows, columns), so each step speaks for all of their pixels.
    """

    def init(self, shape: tuple[int, ...]) -> object:
        raise NotImplementedError

    def accumulate(self, state: object, samples: np.ndarray, weight: object) -> object:
        raise NotImplementedError

    def finalize(self, state: object) -> np.ndarray:
        """Values that the result's pixel type holds as they are."""
        raise NotImplementedError


class MapOp:
    """The same over a mask's active cells, with the centre at hand."""

    def init(self, centre: np.ndarray) -> object:
        raise NotImplementedError

    def accumulate(self, state: object, centre: np.ndarray, samples: np.ndarray) -> object:
        raise NotImplementedError

    def finalize(self, state: object, centre: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def to_channel(values: np.ndarray, p: PixelType) -> np.ndarray:
    """Accumulator values as a channel: rounded half away from zero and clamped; NaN becomes 0 for integers."""
    if p.max is None:
        return values.astype(p.channel.code)
    with np.errstate(invalid="ignore"):
        v = values.astype(np.float64)
        whole = np.trunc(v)
        held = np.clip(np.where(np.abs(v - whole) >= 0.5, whole + np.copysign(1.0, v), whole), 0.0, float(p.max))
    held[np.isnan(held)] = 0
    if p.channel.name != "u64":
        return held.astype(np.int64)
    top = held >= 2.0**64
    return np.where(top, np.uint64(p.max), np.where(top, 0.0, held).astype(np.uint64))


class WeightedSum(FoldOp):
    """Sum of weight * sample in the accumulator's type, in the cells' order, as `out` holds it.

    Where samples are `finite` zero weights change nothing and are left out; zero times NaN or infinity is NaN.
    """

    def __init__(self, kind: str, finite: bool, out: PixelType):
        self.kind, self.finite, self.out = np.dtype({"float": "float32", "double": "float64"}[kind]), finite, out

    def init(self, shape):
        return shape

    def accumulate(self, state, samples, weight):
        if not weight and self.finite:
            return state
        part = samples.astype(self.kind) * self.kind.type(weight)
        return part if isinstance(state, tuple) else np.add(state, part, out=state)

    def finalize(self, state):
        return to_channel(np.zeros(state, self.kind) if isinstance(state, tuple) else state, self.out)


class Source:
    """Images of one size, padded for a kernel: `view(x, y)` are the samples at that cell of all output pixels."""

    def __init__(self, own: np.ndarray, kernel, border, fill: object):
        self.count, h, w = own.shape
        (ax, ay), kw, kh = kernel.anchor, kernel.width, kernel.height
        self.anchor = (ax, ay)
        self.samples = own
        if not border.full:
            nh, nw = h - kh + 1, w - kw + 1
            self.height, self.width = (nh, nw) if nh > 0 and nw > 0 else (0, 0)
            return
        self.height, self.width = h, w
        if not h * w or (kw, kh) == (1, 1):
            return
        if fill is not None:
            self.samples = np.full((self.count, h + kh - 1, w + kw - 1), fill, dtype=own.dtype)
            self.samples[:, ay : ay + h, ax : ax + w] = own
        else:
            ys, xs = border.locate(np.arange(-ay, h + kh - 1 - ay), h), border.locate(np.arange(-ax, w + kw - 1 - ax), w)
            self.samples = own[:, ys[:, None], xs]

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.count, self.height, self.width

    def view(self, x: int, y: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The samples of cell (x, y), counted from the kernel's corner, for output rows lo to hi."""
        hi = self.height if hi is None else hi
        return self.samples[:, lo + y : hi + y, x : x + self.width]

    def centre(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        return self.view(*self.anchor, lo, hi)

    def by_bands(self, part: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """part(lo, hi) of all bands of output rows, one under another."""
        if not self.height * self.width:
            return part(0, 0).reshape(self.shape)
        rows = max(1, BAND // (self.count * self.width))
        parts = [part(lo, min(self.height, lo + rows)) for lo in range(0, self.height, rows)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)


def folded(own: np.ndarray, kernel, border, fill: object, op: FoldOp) -> np.ndarray:
    source = Source(own, kernel, border, fill)
    cells = [(k % kernel.width, k // kernel.width, weight) for k, weight in enumerate(kernel.data)]

    def part(lo: int, hi: int) -> np.ndarray:
        state = op.init((source.count, hi - lo, source.width))
        if hi > lo:
            for x, y, weight in cells:
                state = op.accumulate(state, source.view(x, y, lo, hi), weight)
        return op.finalize(state)

    with np.errstate(all="ignore"):
        return source.by_bands(part)


def mapped(own: np.ndarray, mask, border, fill: object, op: MapOp) -> np.ndarray:
    source = Source(own, mask, border, fill)
    cells = [(k % mask.width, k // mask.width) for k, active in enumerate(mask.data) if active]

    def part(lo: int, hi: int) -> np.ndarray:
        centre = source.centre(lo, hi) if hi > lo else np.zeros((source.count, 0, source.width), own.dtype)
        state = op.init(centre)
        if hi > lo:
            for x, y in cells:
                state = op.accumulate(state, centre, source.view(x, y, lo, hi))
        return op.finalize(state, centre)

    with np.errstate(all="ignore"):
        return source.by_bands(part)
