"""Operators that need a whole image at once and no shuffle: numpy on Arrow batches, an image at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import types as T

from rasterloom.frame import KEYS, ImageFrame
from rasterloom.pixel import PixelType

#: Pixels of results that are handed on together.
PIXELS = 1 << 20
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "decimal(20,0)": pa.decimal128(20, 0)}


def samples(lists: pa.Array, kind: np.dtype | None = None) -> np.ndarray:
    """All samples of a column of arrays, end to end; decimals as `kind` or else unsigned 64-bit integers."""
    flat = lists.flatten()
    if pa.types.is_decimal(flat.type):
        flat = flat.cast(pa.from_numpy_dtype(kind or np.dtype("uint64")))
    values = flat.to_numpy(zero_copy_only=False)
    return values if kind is None else values.astype(kind, copy=False)


def arrays(parts: list[np.ndarray], sql: str) -> pa.Array:
    """A column of arrays with a channel's SQL type."""
    sizes = np.array([p.size for p in parts], dtype=np.int64)
    flat = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat).cast(ARROW[sql]))


def _schema(own, frame: ImageFrame, out: PixelType) -> T.StructType:
    lists = [T.StructField(c, T.ArrayType(T._parse_datatype_string(out.sql))) for c in out.channels]
    return T.StructType([own.schema["image_id"], T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), *(own.schema[c] for c in frame.carried), *lists])


def per_stack(frame: ImageFrame, out: PixelType, function: Callable[[list[np.ndarray]], list[np.ndarray]], kind: str | None = None) -> ImageFrame:
    """function(channels) of images of one size that come one after another, stacked: arrays of images x height x width.

    Small images cost a few array operations for many of them; a stack has at most PIXELS pixels, or one image.
    """
    names, n = (*KEYS, *frame.carried), len(frame.pixel.channels)
    own = frame.df.select(*names, *frame.pixel.channels)
    schema = _schema(own, frame, out)
    dtype = np.dtype(kind) if kind else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [samples(batch.column(len(names) + k), dtype) for k in range(n)]
            width, height = (np.asarray(batch.column(k)).astype(np.int64) for k in (1, 2))
            area = np.cumsum(np.concatenate([[0], width * height]))
            lo = 0
            while lo < batch.num_rows:
                w, h = int(width[lo]), int(height[lo])
                other = np.flatnonzero((width[lo:] != w) | (height[lo:] != h))
                hi = min(lo + int(other[0]) if len(other) else batch.num_rows, lo + max(1, PIXELS // max(w * h, 1)))
                made = function([c[area[lo] : area[hi]].reshape(hi - lo, h, w) for c in flat])
                sides = [pa.array(np.full(hi - lo, made[0].shape[k], np.int32)) for k in (2, 1)]
                kept = [batch.column(k).slice(lo, hi - lo) for k in range(3, len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *sides, *kept, *(arrays(list(m), out.sql) for m in made)], names=[f.name for f in schema.fields])
                lo = hi

    return ImageFrame(own.mapInArrow(run, schema), out, frame.carried)


def per_image(frame: ImageFrame, out: PixelType, function: Callable[[object, list[np.ndarray]], list[np.ndarray]], kind: str | None = None) -> ImageFrame:
    """function(image_id, channels) of every image, its channels as height x width arrays; what it gives must be arrays of one size."""
    names, n = (*KEYS, *frame.carried), len(frame.pixel.channels)
    own = frame.df.select(*names, *frame.pixel.channels)
    schema = _schema(own, frame, out)
    dtype = np.dtype(kind) if kind else None

    def sent(part: pa.RecordBatch, made: list[list[np.ndarray]]) -> pa.RecordBatch:
        sides = [pa.array([m[0].shape[k] for m in made], type=pa.int32()) for k in (1, 0)]
        kept = [part.column(k) for k in range(3, len(names))]
        return pa.RecordBatch.from_arrays([part.column(0), *sides, *kept, *(arrays([m[k] for m in made], out.sql) for k in range(len(out.channels)))], names=[f.name for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [samples(batch.column(len(names) + k), dtype) for k in range(n)]
            at, since, held, made = 0, 0, 0, []
            for row, (image, w, h) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                made.append(function(image, [c[at : at + w * h].reshape(h, w) for c in flat]))
                at, held = at + w * h, held + made[-1][0].size
                if held >= PIXELS:
                    yield sent(batch.slice(since, row + 1 - since), made)
                    since, held, made = row + 1, 0, []
            if made:
                yield sent(batch.slice(since), made)

    return ImageFrame(own.mapInArrow(run, schema), out, frame.carried)
