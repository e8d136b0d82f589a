"""Template matching: a score for every place where the template lies inside the image.

The template is a value of the driver (it is small by nature). The named methods pass over its samples one by one, each
for all places of an image at once. Larger templates of integer pixels take two of them another way: sums of samples and of their squares
come from integral tables, cross products from Fourier transforms of tiles, rounded to the integers that they are, so both ways give
the same scores. A method of one's own is an expression over array reads, its samples literals of the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.errors import PixelTypeError, TemplateTooLarge
from rasterloom.frame import ImageFrame, bound, grid
from rasterloom.operators.arrays import per_image
from rasterloom.pixel import pixel_type
from rasterloom.shapes import Size


class Template:
    """Samples by channel, in raster order."""

    def __init__(self, size: Size, *channels):
        if size.area == 0:
            raise ValueError("an empty template matches nothing")
        if any(len(c) != size.area for c in channels):
            raise ValueError("a template's channels fill its size")
        self.size, self.channels = size, [list(c) for c in channels]


class MatchMethod:
    """A score from (image sample, template sample) pairs, as doubles."""

    def score(self, pairs: list[tuple[Column, float]]) -> Column:
        raise NotImplementedError


class _Scanned(MatchMethod):
    """A score from such pairs as they come, in raster order, the image samples being those of all places at once."""

    def scan(self, pairs: Iterator[tuple[np.ndarray, float]]) -> np.ndarray:
        raise NotImplementedError


class SAD(_Scanned):
    """Sum of absolute differences, in single precision."""

    def scan(self, pairs):
        total = np.float32(0)
        for i, t in pairs:
            total = total + np.abs(i.astype(np.float32) - np.float32(t))
        return total


class _Tabled(_Scanned):
    """A score that follows from sums over the pairs: their number, t, t^2, i, i^2 and i t."""

    def of_sums(self, n: float, t1: float, t2: float, s1: np.ndarray, s2: np.ndarray, cross: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class SSD(_Tabled):
    """Sum of squared differences."""

    def of_sums(self, n, t1, t2, s1, s2, cross):
        return s2 - 2.0 * cross + t2

    def scan(self, pairs):
        total = 0.0
        for i, t in pairs:
            total = total + (i - t) * (i - t)
        return total


class NCC(_Tabled):
    """Normalised cross-correlation; 0 where either side has next to no variance, NaN where rounding makes it negative."""

    def scan(self, pairs):
        n, t1, t2, s1, s2, cross = 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
        for i, t in pairs:
            n, t1, t2, s1, s2, cross = n + 1.0, t1 + t, t2 + t * t, s1 + i, s2 + i * i, cross + i * t
        return self.of_sums(n, t1, t2, s1, s2, cross)

    def of_sums(self, n, t1, t2, s1, s2, cross):
        mean = s1 / n
        spread = (s2 / n - mean * mean) * (t2 / n - (t1 / n) * (t1 / n))
        root = np.sqrt(np.maximum(spread, 0.0))
        score = np.where(root < 1e-12, 0.0, (cross / n - mean * (t1 / n)) / np.where(root < 1e-12, 1.0, root))
        return np.where(spread < 0, np.nan, score)


#: Template samples from which tables and transforms are used; side of the tiles that are transformed.
TABLED, TILE = 64, 1024


def window_sums(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Sums of integers over all windows, from their integral table."""
    table = np.zeros((values.shape[0] + 1, values.shape[1] + 1), np.int64)
    np.cumsum(values, axis=1, out=table[1:, 1:])
    np.cumsum(table, axis=0, out=table)
    return table[height:, width:] - table[:-height, width:] - table[height:, :-width] + table[:-height, :-width]


def _bytes_correlated(image: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Sums of products of 8-bit samples at all places: tiles are transformed, and the results, off by far less than a half, rounded."""
    th, tw = shape.shape
    oh, ow = image.shape[0] - th + 1, image.shape[1] - tw + 1
    side = lambda own, part: 1 << min(max(TILE, 2 * part) - 1, own - 1).bit_length()
    fy, fx = side(image.shape[0], th), side(image.shape[1], tw)
    other = np.conj(np.fft.rfft2(shape, (fy, fx)))
    out = np.empty((oh, ow), np.int64)
    for y in range(0, oh, fy - th + 1):
        for x in range(0, ow, fx - tw + 1):
            found = np.fft.irfft2(np.fft.rfft2(image[y : y + fy, x : x + fx], (fy, fx)) * other, (fy, fx))
            h, w = min(fy - th + 1, oh - y), min(fx - tw + 1, ow - x)
            out[y : y + h, x : x + w] = np.rint(found[:h, :w])
    return out


def cross_products(image: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Sums of image * template at all places, for samples of up to 16 bits: by bytes, each exact."""
    digits = lambda a: [a & 255, a >> 8] if a.max(initial=0) > 255 else [a]
    return sum(_bytes_correlated(i, t) << (8 * (j + k)) for j, i in enumerate(digits(image)) for k, t in enumerate(digits(shape)))


def _by_tables(method: _Tabled, channels: list[np.ndarray], template: Template) -> np.ndarray:
    size = template.size
    shapes = [np.array(c, np.int64).reshape(size.height, size.width) for c in template.channels]
    whole = [c.astype(np.int64) for c in channels]
    s1 = sum(window_sums(c, size.height, size.width) for c in whole)
    s2 = sum(window_sums(c * c, size.height, size.width) for c in whole)
    cross = sum(cross_products(c, t) for c, t in zip(whole, shapes, strict=True))
    sums = [sum(int((t**k).sum()) for t in shapes) for k in (1, 2)]
    return method.of_sums(float(size.area * len(shapes)), *map(float, sums), *(a.astype(np.float64) for a in (s1, s2, cross)))


def check_template(image: Size, template: Size) -> None:
    """For sizes known beforehand."""
    if template.width > image.width or template.height > image.height:
        raise TemplateTooLarge(f"a template of {template.width} x {template.height} in {image.width} x {image.height}")


def match_template(frame: ImageFrame, template: Template, method: MatchMethod) -> ImageFrame:
    """Scores as MonoF32 images of (W - w + 1) x (H - h + 1); an image smaller than the template fails the query."""
    p = frame.pixel
    if len(template.channels) != len(p.channels) or p.channel.accumulator is None or not p.linear:
        raise PixelTypeError(f"the template does not have the linear channels of {p.name}")
    size, out = template.size, pixel_type("MonoF32")
    if isinstance(method, _Scanned):
        # whole numbers throughout, below what a double holds exactly
        whole = p.max is not None and p.max < 1 << 16 and all(float(t).is_integer() and 0 <= t <= p.max for c in template.channels for t in c)
        tabled = isinstance(method, _Tabled) and whole and size.area >= TABLED and 4 * size.area * len(p.channels) * p.max**2 < 1 << 53

        def scanned(image: object, channels: list[np.ndarray]) -> list[np.ndarray]:
            oh, ow = channels[0].shape[0] - size.height + 1, channels[0].shape[1] - size.width + 1
            if oh < 1 or ow < 1:
                raise TemplateTooLarge(f"TemplateTooLarge: image {image}")
            if tabled:
                with np.errstate(all="ignore"):
                    return [np.asarray(_by_tables(method, channels, template)).astype(np.float32)]
            places = ((ty, tx, k) for ty in range(size.height) for tx in range(size.width) for k in range(len(channels)))
            pairs = ((channels[k][ty : ty + oh, tx : tx + ow], float(template.channels[k][ty * size.width + tx])) for ty, tx, k in places)
            with np.errstate(all="ignore"):
                return [np.asarray(method.scan(pairs)).astype(np.float32)]

        return per_image(frame, out, scanned, "float64")
    w, h = F.col("width"), F.col("height")
    fits = (w >= size.width) & (h >= size.height)
    told = F.raise_error(F.concat(F.lit("TemplateTooLarge: image "), F.col("image_id").cast("string"))).cast("int")
    ow, oh = F.when(fits, w - (size.width - 1)).otherwise(told), h - (size.height - 1)

    def scores(data: Column) -> Column:
        def at(x: Column, y: Column) -> Column:
            pairs = []
            for ty in range(size.height):
                for tx in range(size.width):
                    for k, c in enumerate(p.channels):
                        sample = F.get(data[c], ((y + ty) * w + x + tx).cast("int"))
                        pairs.append((sample.cast("double"), float(template.channels[k][ty * size.width + tx])))
            return method.score(pairs).cast("float")

        return grid(ow, oh, at)

    return frame.with_channels({"v": bound(F.struct(*p.channels), scores)}, out, ow, oh)
