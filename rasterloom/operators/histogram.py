"""Histograms, Otsu thresholds and equalisation.

Images of a frame are counted where they lie, all bins at once, without a shuffle; masks and equalisation look their values up in
the same step. Samples given as rows are counted by a group-by, before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rasterloom.errors import InvalidBinningStrategy, PixelTypeError
from rasterloom.frame import ImageFrame
from rasterloom.operators.arrays import PIXELS, per_image
from rasterloom.pixel import PixelType, pixel_type

NAN, UNDERFLOW, OVERFLOW = -1, -2, -3


class BinningStrategy:
    """Bins of a channel: how many, which one a value falls in (or NAN, UNDERFLOW, OVERFLOW), and their limits."""

    count: int

    def check(self, p: PixelType) -> None:
        """Refuses pixel types that these bins do not serve."""

    def bin(self, v: Column) -> Column:
        raise NotImplementedError

    def range(self, k: int) -> tuple[float, float]:
        raise NotImplementedError


class NaturalBins(BinningStrategy):
    """A bin for each 8-bit value."""

    count = 256

    def check(self, p):
        if p.channel.name != "u8":
            raise PixelTypeError(f"natural bins are for 8-bit channels; those of {p.name} are not")

    def bin(self, v):
        return v.cast("int")

    def range(self, k):
        return k, k + 1


def _outliers(v: Column, low: float, high: float, inside: Column) -> Column:
    return F.when(F.isnan(v), NAN).when(v < low, UNDERFLOW).when(v > high, OVERFLOW).otherwise(inside)


@dataclass(frozen=True)
class LinearBins(BinningStrategy):
    """Equal bins from min to max; the last one holds max too."""

    min: float
    max: float
    count: int

    def __post_init__(self) -> None:
        if self.count < 1 or not (math.isfinite(self.min) and math.isfinite(self.max)) or self.min >= self.max:
            raise InvalidBinningStrategy("linear bins need a finite min below a finite max, and one bin at least")

    def bin(self, v):
        d = v.cast("double")
        at = F.floor((d - self.min) / (self.max - self.min) * self.count)
        return _outliers(d, self.min, self.max, F.least(F.when((d >= self.min) & (d <= self.max), at), F.lit(self.count - 1).cast("bigint"))).cast("int")

    def range(self, k):
        step = (self.max - self.min) / self.count
        return self.min + k * step, self.max if k == self.count - 1 else self.min + (k + 1) * step


@dataclass(frozen=True)
class CustomBins(BinningStrategy):
    """Bins between rising edges; the last one holds its upper edge too."""

    edges: tuple[float, ...]

    @classmethod
    def of(cls, edges: Sequence[float]) -> CustomBins:
        e = tuple(float(x) for x in edges)
        if len(e) < 2 or not all(map(math.isfinite, e)) or any(b <= a for a, b in zip(e, e[1:], strict=False)):
            raise InvalidBinningStrategy("custom bins need two edges at least, finite and rising")
        return cls(e)

    @property
    def count(self) -> int:
        return len(self.edges) - 1

    def bin(self, v):
        d = v.cast("double")
        passed = sum((d >= e).cast("int") for e in self.edges[1:-1]) if len(self.edges) > 2 else F.lit(0)
        return _outliers(d, self.edges[0], self.edges[-1], passed).cast("int")

    def range(self, k):
        return self.edges[k], self.edges[k + 1]


def histogram_samples(samples: DataFrame, strategy: BinningStrategy) -> DataFrame:
    """From rows (image_id, channel, v): the occupied bins, outliers under their negative codes."""
    return samples.groupBy("image_id", "channel", strategy.bin(F.col("v")).alias("bin")).agg(F.count("*").alias("count"))


#: Codes below 0 that a count has room for; the last stands for values without a bin.
_CODES = 4


def _counted(frame: ImageFrame, strategy: BinningStrategy) -> DataFrame:
    """(image_id, channel, counts) of every image where it lies: counts of the _CODES, the lowest first, then of all bins."""
    strategy.check(frame.pixel)
    names, slots = frame.pixel.channels, _CODES + strategy.count
    bins = [F.transform(c, lambda v: F.coalesce(strategy.bin(v), F.lit(-_CODES)).cast("int")).alias(f"_{k}") for k, c in enumerate(names)]
    own = frame.df.select("image_id", *bins)
    schema = T.StructType([own.schema["image_id"], T.StructField("channel", T.IntegerType()), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for k in range(len(names)):
                lists = batch.column(1 + k)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
                step = max(1, PIXELS // slots)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for lo in range(0, batch.num_rows, step):
                    hi = min(lo + step, batch.num_rows)
                    image = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                    counts = np.bincount(image * slots + flat[ends[lo] : ends[hi]] + _CODES, minlength=(hi - lo) * slots)
                    lists_out = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * slots), pa.array(counts.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, k, np.int32)), lists_out], names=["image_id", "channel", "counts"])

    return own.mapInArrow(run, schema)


def histogram(frame: ImageFrame, strategy: BinningStrategy) -> DataFrame:
    """image_id, channel, bin, count for every bin of every channel, empty bins too. No shuffle: an image is counted where it lies."""
    return _counted(frame, strategy).select("image_id", "channel", F.posexplode(F.slice("counts", _CODES + 1, strategy.count)).alias("bin", "count"))


def outliers(frame: ImageFrame, strategy: BinningStrategy) -> DataFrame:
    """image_id, channel, nan_count, underflow_count, overflow_count, total_count (outliers included), for images with pixels."""
    of = lambda code, name: F.get("counts", _CODES + code).alias(name)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("total_count")
    return _counted(frame, strategy).select("image_id", "channel", of(NAN, "nan_count"), of(UNDERFLOW, "underflow_count"), of(OVERFLOW, "overflow_count"), total).filter("total_count > 0")


def _by_bin():
    return Window.partitionBy("image_id", "channel").orderBy("bin")


def cumulative(hist: DataFrame) -> DataFrame:
    """The histogram with running totals, outliers left out."""
    return hist.withColumn("cumulative", F.sum("count").over(_by_bin()))


def count_at_bin(hist: DataFrame, k: int) -> DataFrame:
    return hist.filter(F.col("bin") == k)


def count_for(hist: DataFrame, strategy: BinningStrategy, value: float) -> DataFrame:
    """The bin that `value` falls in; no row for an outlier."""
    return hist.filter(F.col("bin") == strategy.bin(F.lit(value)))


def otsu_thresholds(hist: DataFrame) -> DataFrame:
    """image_id, channel, threshold: the first value that separates two classes best; null with under two occupied bins.

    `hist` has natural bins; empty ones may be missing, as the first best value is always an occupied one. A window
    over one channel's 256 bins at most.
    """
    whole = Window.partitionBy("image_id", "channel")
    w0, s0 = F.sum("count").over(_by_bin()), F.sum(F.col("count") * F.col("bin")).over(_by_bin())
    rows = hist.select("image_id", "channel", "bin", w0.alias("w0"), s0.alias("s0"), F.sum("count").over(whole).alias("n"), F.sum(F.col("count") * F.col("bin")).over(whole).alias("s"))
    w1 = F.col("n") - F.col("w0")
    gap = F.col("s0") / F.col("w0").cast("double") - (F.col("s") - F.col("s0")) / w1.cast("double")
    variance = F.col("w0").cast("double") * w1.cast("double") * gap * gap
    scored = rows.select("image_id", "channel", "bin", F.when((F.col("w0") > 0) & (w1 > 0), variance).alias("variance"))
    top = F.max(F.when(F.col("variance").isNotNull(), F.struct(F.col("variance"), (-F.col("bin")).alias("neg"))))
    return scored.groupBy("image_id", "channel").agg((-top["neg"]).cast("int").alias("threshold"))


def _threshold(counts: np.ndarray) -> int:
    """otsu_thresholds for one channel's counts; 0 where it has none."""
    w0, s0 = np.cumsum(counts), np.cumsum(counts * np.arange(len(counts)))
    w1, s = w0[-1] - w0, s0[-1]
    some = (w0 > 0) & (w1 > 0)
    if not some.any():
        return 0
    with np.errstate(all="ignore"):
        gap = s0 / w0.astype(np.float64) - (s - s0) / w1.astype(np.float64)
        variance = np.where(some, w0.astype(np.float64) * w1.astype(np.float64) * gap * gap, -1.0)
    return int(np.argmax(variance))


def otsu_binary_mask(frame: ImageFrame) -> ImageFrame:
    """Pixels above their image's threshold (0 where it has none); single-channel 8-bit images. Counted and masked where they lie."""
    if len(frame.pixel.channels) != 1:
        raise PixelTypeError("an Otsu mask needs one channel")
    NaturalBins().check(frame.pixel)
    return per_image(frame, pixel_type("Bool"), lambda _, channels: [channels[0] > _threshold(np.bincount(channels[0].ravel(), minlength=256))])


def equalization_luts(hist: DataFrame) -> DataFrame:
    """image_id, channel, bin, value, one row for each row of `hist`; the identity where one bin holds everything."""
    whole = Window.partitionBy("image_id", "channel")
    cdf = F.sum("count").over(_by_bin())
    rows = hist.select("image_id", "channel", "bin", cdf.alias("cdf"), F.sum("count").over(whole).alias("n"))
    rows = rows.withColumn("least", F.min(F.when(F.col("cdf") > 0, F.col("cdf"))).over(whole))
    level = F.round((F.greatest(F.col("cdf") - F.col("least"), F.lit(0)).cast("double") * 255.0) / (F.col("n") - F.col("least")).cast("double"))
    flat = F.col("least").isNull() | (F.col("n") <= F.col("least"))
    return rows.select("image_id", "channel", "bin", F.when(flat, F.col("bin")).otherwise(F.least(level, F.lit(255.0)).cast("int")).alias("value"))


def _levels(counts: np.ndarray) -> np.ndarray:
    """equalization_luts for one channel's counts."""
    cdf = np.cumsum(counts)
    n, least = cdf[-1], int(cdf[cdf > 0][0]) if cdf[-1] else 0
    if n <= least:
        return np.arange(len(counts), dtype=np.int32)
    level = np.maximum(cdf - least, 0).astype(np.float64) * 255.0 / float(n - least)
    return np.minimum(np.floor(level) + (level - np.floor(level) >= 0.5), 255).astype(np.int32)


def equalize_image(frame: ImageFrame) -> ImageFrame:
    """Every channel through its own table. Counted and looked up where the image lies."""
    NaturalBins().check(frame.pixel)
    return per_image(frame, frame.pixel, lambda _, channels: [_levels(np.bincount(c.ravel(), minlength=256))[c] for c in channels])
