"""Extrema and medians of sliding masks, at a cost that does not grow with the mask's area."""

from __future__ import annotations

import numpy as np

from rasterloom.operators.engine import Source

#: Active cells up to which a median is picked from the samples themselves.
FEW_CELLS = 32


def runs(mask) -> list[tuple[int, int, int]]:
    """(y, x0, x1) of every stretch of active cells of a row, x1 behind its end."""
    out = []
    for y in range(mask.height):
        row = [False, *map(bool, mask.data[y * mask.width : (y + 1) * mask.width]), False]
        begins = [x for x in range(mask.width) if row[x + 1] and not row[x]]
        ends = [x + 1 for x in range(mask.width) if row[x + 1] and not row[x + 2]]
        out += [(y, a, b) for a, b in zip(begins, ends, strict=True)]
    return out


def rectangles(mask) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of disjoint rectangles that cover the active cells: equal stretches of consecutive rows are one."""
    out: list[list[int]] = []
    last: dict[tuple[int, int], list[int]] = {}
    for y in range(mask.height):
        now = {}
        for _, a, b in (r for r in runs(mask) if r[0] == y):
            found = last.get((a, b))
            if found is None:
                found = [a, y, b - a, 0]
                out.append(found)
            found[3] += 1
            now[a, b] = found
        last = now
    return [tuple(r) for r in out]


def sliding(values: np.ndarray, k: int, axis: int, pick: np.ufunc) -> np.ndarray:
    """pick over all stretches of k along an axis, from extrema of prefixes and suffixes of blocks of k: three picks a sample for any k."""
    n = values.shape[axis] - k + 1
    if k == 1:
        return values
    blocks = -(-values.shape[axis] // k)
    spare = [(0, 0)] * values.ndim
    spare[axis] = (0, blocks * k - values.shape[axis])
    full = np.pad(values, spare, mode="edge")
    cut = full.reshape(*full.shape[:axis], blocks, k, *full.shape[axis + 1 :])
    fore = pick.accumulate(cut, axis=axis + 1).reshape(full.shape)
    back = np.flip(pick.accumulate(np.flip(cut, axis + 1), axis=axis + 1), axis + 1).reshape(full.shape)
    along = lambda a, lo: a[(slice(None),) * axis + (slice(lo, lo + n),)]
    return pick(along(back, 0), along(fore, k - 1))


def extreme(own: np.ndarray, mask, border, fill: object, pick: np.ufunc) -> np.ndarray:
    """pick of the centre and all active cells: the mask's rectangles one after another, each by rows and then by columns."""
    source = Source(own, mask, border, fill)
    n, oh, ow = source.shape
    if not oh * ow:
        return np.zeros((n, oh, ow), own.dtype)
    out = source.centre()
    for x, y, w, h in rectangles(mask):
        part = source.samples[:, y : y + oh + h - 1, x : x + ow + w - 1]
        out = pick(out, sliding(sliding(part, w, 2, pick), h, 1, pick))
    return out


def _median_of_bytes(source: Source, stretches: list[tuple[int, int, int]], rank: int) -> np.ndarray:
    """Histograms of all rows' masks slide one column a step: each stretch of the mask gains a sample and loses one.

    16 coarse counts lie above the 256, so finding the rank looks at 32.
    """
    n, oh, ow = source.shape
    columns = np.ascontiguousarray(source.samples.transpose(2, 0, 1).astype(np.int32))
    rows = np.arange(n * oh)
    fine, coarse = np.zeros(len(rows) * 256, np.int32), np.zeros(len(rows) * 16, np.int32)
    fine_at, coarse_at = rows * 256, rows * 16

    def count(y: int, x: int, by: int) -> None:
        v = columns[x, :, y : y + oh].ravel()
        fine[fine_at + v] += by
        coarse[coarse_at + (v >> 4)] += by

    for y, a, b in stretches:
        for x in range(a, b):
            count(y, x, 1)
    out = np.empty((ow, n, oh), np.int32)
    for at in range(ow):
        if at:
            for y, a, b in stretches:
                count(y, at - 1 + a, -1)
                count(y, at - 1 + b, 1)
        upto = coarse.reshape(-1, 16).cumsum(axis=1)
        block = (upto <= rank).sum(axis=1)
        before = upto[rows, block] - coarse[coarse_at + block]
        within = fine.reshape(-1, 16, 16)[rows, block].cumsum(axis=1) + before[:, None]
        out[at] = (16 * block + (within <= rank).sum(axis=1)).reshape(n, oh)
    return out.transpose(1, 2, 0)


def median(own: np.ndarray, mask, border, fill: object, is_bytes: bool) -> np.ndarray:
    """The upper median of the active cells. Bytes slide histograms; other types, and small masks, pick from the samples."""
    source = Source(own, mask, border, fill)
    n, oh, ow = source.shape
    if not oh * ow:
        return np.zeros((n, oh, ow), own.dtype)
    stretches = runs(mask)
    cells = [(x, y) for y, a, b in stretches for x in range(a, b)]
    rank = len(cells) // 2
    if is_bytes and len(cells) > FEW_CELLS:
        return _median_of_bytes(source, stretches, rank)
    rows = max(1, (1 << 20) // (n * ow * len(cells)))
    parts = [np.partition(np.stack([source.view(x, y, lo, min(oh, lo + rows)) for x, y in cells]), rank, axis=0)[rank] for lo in range(0, oh, rows)]
    return np.concatenate(parts, axis=1)
