"""Raw images as a Spark data source: files of scan lines behind a small header, read by bands.

Writing makes a file an image; reading gives a row a scan line. A partition is bands of files, each a range of a file's bytes, so a file larger
than a task's memory is read by as many tasks as it needs. The driver lists files and their lengths; headers, with sizes and pixel types, are read
by the tasks. Many small bands share a task, so tasks grow with the bytes and not with the files. Columns are
the channels, or those that the option `channels` names. Files are reached through Arrow's file systems, so a path may be
local or a URI of a store that Arrow knows (file, hdfs, s3, gs).

    raw.register(spark)
    frame.df.write.format("rasterloom_raw").option("pixel", "Rgb8").mode("append").save(path)
    lines = spark.read.format("rasterloom_raw").option("pixel", "Rgb8").option("channels", "r,b").load(path)

A task writes under names of its own, and the driver renames them when all are done, so a lost task leaves nothing that is read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from os.path import commonprefix
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from rasterloom.errors import LengthMismatch, PixelTypeError
from rasterloom.frame import ImageFrame
from rasterloom.operators.arrays import arrays, samples
from rasterloom.pixel import PixelType, pixel_type

FORMAT = "rasterloom_raw"
#: What a file begins with, its ending, and the header's numbers (version, length of the pixel type's name, width, height).
MAGIC, ENDING, HEADER = b"RLRAWIMG", ".raw", struct.Struct("<HHQQ")
VERSION = 1
#: Bytes of a band.
BAND_BYTES = 16 << 20
#: Smaller bands are made larger, and share a task, up to BAND_BYTES each, while there are more than so many bands and tasks.
BANDS, PARTS = 1024, 64
#: Bytes that a task reads and hands on at once.
BATCH_BYTES = 1 << 20
#: What opening a file costs, in bytes read.
OPEN_BYTES = 1 << 12
#: Files that the driver renames at once, as stores answer one by one.
RENAMES = 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Bands(InputPartition):
    """What a task reads: (name, size, lo, hi) for the lines that begin at bytes lo to hi of a file of that size; names go on from `top`."""

    def __init__(self, top: str, bands: list[tuple[str, int, int, int]]):
        super().__init__(bands)
        self.top, self.bands = top, bands


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: the names that they shall have, in order; until then they are numbered behind its own."""

    hidden: str
    names: list[str]


def _header(f: pa.NativeFile, path: str, size: int, p: PixelType) -> tuple[int, int, int]:
    """Width, height and where the pixels begin; fails where the file is of another type, or of another length than it says."""
    head = f.read(len(MAGIC) + HEADER.size)
    if len(head) < len(MAGIC) + HEADER.size or not head.startswith(MAGIC):
        raise LengthMismatch(f"LengthMismatch: {path} is no raw image")
    version, n, width, height = HEADER.unpack(head[len(MAGIC) :])
    name = f.read(n).decode()
    start = len(head) + n
    if version != VERSION or name != p.name:
        raise PixelTypeError(f"{path} holds {name} (version {version}), not {p.name}")
    if size != start + width * height * p.nbytes:
        raise LengthMismatch(f"LengthMismatch: {path} has {size} bytes for {width} x {height} {p.name}")
    return width, height, start


class _Reader(DataSourceReader):
    def __init__(self, path: str, p: PixelType, channels: list[str], band: int):
        self.path, self.p, self.channels, self.band = path, p, channels, band

    def partitions(self) -> list[Bands]:
        store, top = _store(self.path)
        info = store.get_file_info(top)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        named = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.base_name.endswith(ENDING) and not f.base_name.startswith(("_", ".")))
        held = sum(size for _, size in named)
        band = max(self.band, min(BAND_BYTES, held // BANDS))
        opened = sum(max(1, -(-size // band)) for _, size in named)
        most = max(self.band, min(BAND_BYTES, (held + OPEN_BYTES * opened) // PARTS))
        top = commonprefix([named[0][0], named[-1][0]]) if named else ""
        out: list[list[tuple[str, int, int, int]]] = []
        held = 0
        for path, size in named:
            for lo in range(0, max(size, 1), band):
                hi = lo + band if lo + band < size else size + 1
                if not out or held + hi - lo + OPEN_BYTES > most:
                    out.append([])
                    held = 0
                out[-1].append((path[len(top) :], size, lo, hi))
                held += hi - lo + OPEN_BYTES
        return [Bands(top, bands) for bands in out]

    def read(self, partition: Bands | None) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        held, n = [], 0
        for name, size, lo, hi in partition.bands if partition else ():  # there is none where there are no files
            for batch in self._lines(store, partition.top + name, size, lo, hi):
                held.append(batch)
                n += batch.nbytes
                if n >= BATCH_BYTES:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _lines(self, store: fs.FileSystem, path: str, size: int, since: int, until: int) -> Iterator[pa.RecordBatch]:
        p = self.p
        dtype = np.dtype(p.channel.code).newbyteorder("<")
        image = unquote(path.rsplit("/", 1)[-1][: -len(ENDING)])
        with store.open_input_file(path) as f:
            width, height, start = _header(f, path, size, p)
            line = width * p.nbytes
            # the number of lines that begin before a byte
            before = lambda at: min(height, max(0, -((start - at) // line))) if line else height * (start < at)
            step, end = max(1, BATCH_BYTES // max(line, 1)), before(until)
            for lo in range(before(since), end, step):
                n = min(step, end - lo)
                f.seek(start + lo * line)
                data = np.frombuffer(f.read(n * line), dtype).reshape(n, width, len(p.channels))
                columns = [arrays(list(data[:, :, p.channels.index(c)].astype(dtype.newbyteorder("="))), p.sql) for c in self.channels]
                same = lambda v, kind, n=n: pa.array([v] * n, kind)
                yield pa.RecordBatch.from_arrays([same(image, pa.string()), same(width, pa.int32()), same(height, pa.int32()), pa.array(np.arange(lo, lo + n, dtype=np.int32)), *columns], names=["image_id", "width", "height", "y", *self.channels])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, p: PixelType):
        self.path, self.p = path, p

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, top = _store(self.path)
        store.create_dir(top, recursive=True)
        p, out = self.p, Written(f"_{uuid.uuid4().hex}", [])
        dtype = np.dtype(p.channel.code).newbyteorder("<")
        for batch in batches:
            own = {n: batch.column(batch.schema.get_field_index(n)) for n in ("image_id", "width", "height", *p.channels)}
            for k, (image, width, height) in enumerate(zip(*(own[n].to_pylist() for n in ("image_id", "width", "height")), strict=True)):
                parts = [samples(own[c].slice(k, 1)) for c in p.channels]
                if any(len(part) != width * height for part in parts):
                    raise LengthMismatch(f"LengthMismatch: image {image}")
                with store.open_output_stream(f"{top}/{out.hidden}-{len(out.names)}") as f:
                    f.write(MAGIC + HEADER.pack(VERSION, len(p.name.encode()), width, height) + p.name.encode())
                    f.write(np.stack(parts, axis=1).astype(dtype).tobytes())
                out.names.append(f"{quote(str(image), safe='')}{ENDING}")
        return out

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        last: dict[str, str] = {}
        for message in filter(None, messages):
            for k, name in enumerate(message.names):
                if name in last:
                    store.delete_file(last[name])
                last[name] = f"{top}/{message.hidden}-{k}"
        with ThreadPoolExecutor(RENAMES) as pool:
            for _ in pool.map(lambda name: store.move(last[name], f"{top}/{name}"), last):
                pass

    def abort(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        for message in filter(None, messages):
            for k in range(len(message.names)):
                store.delete_file(f"{top}/{message.hidden}-{k}")


class RawImages(DataSource):
    """Options: path, pixel (a type's name), channels (names with commas between them; all if absent), band (bytes of a band; many small ones are joined)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _pixel(self) -> PixelType:
        return pixel_type(self.options["pixel"])

    def _channels(self) -> list[str]:
        p = self._pixel()
        wanted = [c.strip() for c in self.options["channels"].split(",")] if self.options.get("channels") else list(p.channels)
        if any(c not in p.channels for c in wanted):
            raise PixelTypeError(f"{p.name} has no channels {wanted}")
        return wanted

    def schema(self) -> str:
        kind = self._pixel().sql
        return "image_id string, width int, height int, y int, " + ", ".join(f"{c} array<{kind}>" for c in self._channels())

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], self._pixel(), self._channels(), int(self.options.get("band", BAND_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("files are only added; write to a folder of its own")
        return _Writer(self.options["path"], self._pixel())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawImages)


def write(frame: ImageFrame, path: str) -> None:
    """A file for each image, named after its image_id; files that are there already under another name stay."""
    register(frame.df.sparkSession)
    frame.df.select("image_id", "width", "height", *frame.pixel.channels).write.format(FORMAT).option("pixel", frame.pixel.name).mode("append").save(path)


def read_lines(spark: SparkSession, path: str, pixel: str | PixelType, channels: list[str] | None = None, band: int = BAND_BYTES) -> DataFrame:
    """image_id (text), width, height, y and an array for each channel asked for: one row a scan line."""
    register(spark)
    reader = spark.read.format(FORMAT).option("pixel", pixel_type(pixel).name).option("band", band)
    return (reader.option("channels", ",".join(channels)) if channels else reader).load(path)


def pixels_of_lines(lines: DataFrame, channels: list[str]) -> DataFrame:
    """One row a pixel (image_id, x, y, channels), without a shuffle: what tiles, blocks and integral tables of pixel rows take."""
    rows = lines.select("image_id", "y", F.posexplode(F.arrays_zip(*channels)).alias("x", "_p"))
    return rows.select("image_id", "x", "y", *(F.col("_p")[c].alias(c) for c in channels))
