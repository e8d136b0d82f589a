"""Connected components of binary images.

Pixels are joined to runs within rows; runs of neighbouring rows that touch are edges; final labels count components in
raster order of their first pixels.

An image is one row of a frame, so by default its runs are found and joined where that row lies: numpy on Arrow
batches, all images of a batch at once, no shuffle. Masks too large for that (pixel rows, or `distributed=True`) are cut into
tiles: each tile is labelled on its own, many small ones at once, components that touch across tile edges are edges of a graph, that graph
is contracted, and what it says is joined back to the tiles' components. An image of few such edges is contracted by one task, many
images at once; for the others rounds depend on what crosses tile edges, not on pixels or runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rasterloom.errors import LabelOverflow, PixelTypeError
from rasterloom.frame import ImageFrame, exploded
from rasterloom.joins import small
from rasterloom.pixel import MAX_LABEL
from rasterloom.storage import discard, only, written

CONNECTIVITY_4, CONNECTIVITY_8 = 0, 1
#: Side of the tiles that are labelled on their own.
TILE = 512


@dataclass(frozen=True)
class Labeling:
    """`labelled_runs`: image_id, y, x0, x1, label; a run that crosses a tile's edge is told in parts. `images`: the sizes."""

    labelled_runs: DataFrame
    images: DataFrame

    def pixels(self) -> DataFrame:
        """image_id, x, y, label of the foreground; everything else is 0."""
        return self.labelled_runs.select("image_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "label")

    def counts(self) -> DataFrame:
        """image_id, label_count, for images without components too."""
        some = self.labelled_runs.groupBy("image_id").agg(F.max("label").alias("label_count"))
        return self.images.select("image_id").join(some, "image_id", "left").select("image_id", F.coalesce("label_count", F.lit(0)).cast("bigint").alias("label_count"))

    def stats(self) -> DataFrame:
        """image_id, label, area, bounding box, coordinate sums, centroid and aspect ratio, from runs alone."""
        n = (F.col("x1") - F.col("x0") + 1).cast("bigint")
        rows = self.labelled_runs.groupBy("image_id", "label").agg(
            F.sum(n).alias("area"), F.min("x0").alias("min_x"), F.min("y").alias("min_y"), F.max("x1").alias("max_x"), F.max("y").alias("max_y"), F.sum(F.floor((F.col("x0") + F.col("x1")) * n / 2).cast("bigint")).alias("sum_x"), F.sum(F.col("y") * n).alias("sum_y")
        )
        share = F.lit(1.0) / F.col("area")
        ratio = (F.col("max_x") - F.col("min_x") + 1).cast("double") / (F.col("max_y") - F.col("min_y") + 1).cast("double")
        return rows.select("*", (F.col("sum_x") * share).alias("centroid_x"), (F.col("sum_y") * share).alias("centroid_y"), ratio.alias("aspect_ratio"))


def check_labels(provisional: int, max_label: int = MAX_LABEL) -> None:
    if provisional > max_label:
        raise LabelOverflow(f"{provisional} provisional labels exceed {max_label}")


def _rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]


def _joined_runs(img: np.ndarray, row: np.ndarray, x0: np.ndarray, x1: np.ndarray, height: np.ndarray, room: int, connectivity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each run's root, the first run of its component, and whether it touches none above; runs lie in order of image, row and x0."""
    # rows of all images one under another, with an empty one between images; each row has room for its reach
    line = (np.cumsum(height + 1) - (height + 1))[img] + row + 1
    begins, ends = line * (room + 4) + x0 + 2, line * (room + 4) + x1 + 2
    lo = np.searchsorted(ends, begins - (room + 4) - connectivity, "left")
    hi = np.searchsorted(begins, ends - (room + 4) + connectivity, "right")
    n = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(len(img)), n)
    above = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return _rooted(len(img), above, below), n == 0


def _label_batch(width: np.ndarray, height: np.ndarray, on: np.ndarray, connectivity: int, max_label: int) -> tuple[np.ndarray, ...]:
    """(image, y, x0, x1, label) of all runs of the images whose pixels `on` holds end to end."""
    area = width * height
    image = np.repeat(np.arange(len(area)), area)
    place = np.arange(len(on)) - np.repeat(np.cumsum(area) - area, area)
    x, y = place % width[image], place // width[image]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1] | (x[1:] == 0)
    last[:-1] &= ~on[1:] | (x[1:] == 0)
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    img, row, x0, x1 = image[s], y[s], x[s], x[e]
    root, alone = _joined_runs(img, row, x0, x1, height, int(width.max(initial=0)), connectivity)
    fresh = np.bincount(img[alone], minlength=1)
    check_labels(int(fresh.max(initial=0)), max_label)
    roots = np.unique(root)
    number = np.arange(len(roots)) - np.searchsorted(img[roots], img[roots])
    return img, row, x0, x1, number[np.searchsorted(roots, root)] + 1


def _labelled_in_place(mask: ImageFrame, connectivity: int, max_label: int) -> DataFrame:
    schema = T.StructType([mask.df.schema["image_id"], *(T.StructField(c, T.IntegerType()) for c in ("y", "x0", "x1")), T.StructField("label", T.LongType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, width, height, v = (part.column(k) for k in range(4))
                on = v.flatten().to_numpy(zero_copy_only=False).astype(bool)
                img, *columns = _label_batch(np.asarray(width).astype(np.int64), np.asarray(height).astype(np.int64), on, connectivity, max_label)
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(img)), *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))], names=[f.name for f in schema.fields])

    return mask.df.select("image_id", "width", "height", "v").mapInArrow(run, schema)


#: Rows of an image whose components are numbered together.
BAND = 16


def _numbered(rooted: DataFrame) -> DataFrame:
    """(image_id, run, label) from (image_id, run, y, root): components counted in order of their roots.

    Roots are counted by bands of rows, the bands of an image are summed up, and only a band's own roots are put in order.
    """
    band = F.floor(F.col("y") / BAND).alias("band")
    roots = rooted.filter("run = root").select("image_id", "root", band)
    before = Window.partitionBy("image_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = roots.groupBy("image_id", "band").count().select("image_id", "band", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("image_id", "band").orderBy("root"))
    labels = roots.select("image_id", "root", "band", within.alias("n")).join(offsets, ["image_id", "band"]).select("image_id", "root", (F.col("n") + F.col("offset")).cast("bigint").alias("label"))
    return rooted.join(labels, ["image_id", "root"]).select("image_id", "run", "label")


#: Rows that a task takes at once, if no group is larger.
ROWS = 1 << 17


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row differs from the one before in any of the keys."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for key in keys:
        column = table[key].combine_chunks()
        new |= np.asarray(pa.compute.fill_null(pa.compute.not_equal(column[1:], column[:-1]), True))
    return np.flatnonzero(np.append(True, new)) if table.num_rows else np.zeros(0, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of the keys, many whole groups at once, with the groups' starts; a group that goes on is held back."""
    held, n, most = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut), starts[:-1]
        held = table.slice(cut).to_batches()
        n -= cut
        most = max(ROWS, 2 * n)
    if n:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, keys)


def _tile_runs(on: DataFrame, connectivity: int, side: int) -> DataFrame:
    """(image_id, y, x0, x1, run, root) of the runs of every tile, from true pixels (image_id, x, y).

    `run` tells a run's first pixel and follows raster order, `root` is that of the first run of its component within the tile. Pixels are
    sorted by tile, so a task holds some tiles' pixels, whatever the number of tiles.
    """
    schema = T.StructType([on.schema["image_id"], *(T.StructField(c, T.IntegerType()) for c in ("y", "x0", "x1")), T.StructField("run", T.LongType()), T.StructField("root", T.LongType())])
    tile = ["image_id", "ty", "tx"]

    def labelled(batches):
        for table, starts in _groups(batches, tile):
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            x, y, tx, ty = (np.asarray(table[c]).astype(np.int64) for c in ("x", "y", "tx", "ty"))
            # a pixel's place, with a gap after each row and each tile; told twice, it counts once
            place, once = np.unique(((group * (side + 1)) + y - ty * side) * (side + 1) + x - tx * side, return_index=True)
            apart = np.diff(place) != 1
            s, e = once[np.append(True, apart)], once[np.append(apart, True)]
            row, x0, x1 = y[s], x[s], x[e]
            root, _ = _joined_runs(group[s], row - ty[s] * side, x0 - tx[s] * side, x1 - tx[s] * side, np.full(len(starts), side), side, connectivity)
            run = (row << 32) + x0
            yield pa.RecordBatch.from_arrays([table["image_id"].combine_chunks().take(pa.array(s)), *(pa.array(c, type=pa.int32()) for c in (row, x0, x1)), pa.array(run), pa.array(run[root])], names=[f.name for f in schema.fields])

    at = lambda c: F.floor(F.col(c) / side).cast("int").alias(f"t{c}")
    tiles = on.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).select("image_id", at("y"), at("x"), "x", "y")
    return tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(labelled, schema)


def _crossings(found: DataFrame, connectivity: int, side: int) -> DataFrame:
    """(image_id, a, b): roots of runs that touch across an edge between tiles, each pair once, the larger first."""
    near = lambda at: F.explode(F.sequence(F.col(at) - connectivity, F.col(at) + connectivity)).alias(at)
    east = found.filter(F.pmod("x1", F.lit(side)) == side - 1).select("image_id", (F.col("x1") + 1).alias("x"), near("y"), F.col("root").alias("p"))
    west = found.filter(F.pmod("x0", F.lit(side)) == 0).select("image_id", F.col("x0").alias("x"), "y", F.col("root").alias("q"))
    cells = F.explode(F.sequence("x0", "x1")).alias("x")
    low = found.filter(F.pmod("y", F.lit(side)) == side - 1).select("image_id", cells, "y", "root").select("image_id", near("x"), (F.col("y") + 1).alias("y"), F.col("root").alias("p"))
    high = found.filter(F.pmod("y", F.lit(side)) == 0).select("image_id", cells, "y", F.col("root").alias("q"))
    met = east.join(west, ["image_id", "x", "y"]).union(low.join(high, ["image_id", "x", "y"]))
    return met.filter("p <> q").select("image_id", F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()


#: Edges of an image that one task contracts.
ALONE = 1 << 20


def _contracted_alone(edges: DataFrame) -> DataFrame:
    """What contracted() gives, many images at once, each in one task."""
    schema = T.StructType([edges.schema["image_id"], T.StructField("root", T.LongType()), T.StructField("low", T.LongType())])

    def run(batches):
        for table, starts in _groups(batches, ["image_id"]):
            n = table.num_rows
            group = np.tile(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n))), 2)
            ends = np.concatenate([np.asarray(table["a"]), np.asarray(table["b"])])
            order = np.lexsort((ends, group))
            new = np.append(True, (np.diff(ends[order]) != 0) | (np.diff(group[order]) != 0))
            node = np.empty(2 * n, np.int64)
            node[order] = np.cumsum(new) - 1
            first = order[new]
            root = _rooted(len(first), node[:n], node[n:])
            moved = np.flatnonzero(root != np.arange(len(root)))
            ids = table["image_id"].combine_chunks().take(pa.array(first[moved] % n))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ends[first[moved]]), pa.array(ends[first[root[moved]]])], names=[f.name for f in schema.fields])

    return edges.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(run, schema)


def contracted(edges: DataFrame) -> DataFrame:
    """(image_id, root, low): the smallest node that each node of the edges (image_id, a, b), a > b, reaches.

    Images of up to ALONE edges are contracted where they lie, the others by rounds.
    """
    found = written(edges, "crossings")
    large = written(found.groupBy("image_id").count().filter(F.col("count") > ALONE).select("image_id"), "large")
    if large.isEmpty():
        return _contracted_alone(found)
    # each has over ALONE edges, so they are few
    rest = found.join(F.broadcast(large), "image_id", "left_anti")
    return _contracted_alone(rest).union(_contracted_by_rounds(found.join(F.broadcast(large), "image_id", "left_semi")))


def _contracted_by_rounds(edges: DataFrame) -> DataFrame:
    """Larger neighbours move to the smallest node that a node sees, then smaller ones to the smallest of them, in turn, until every
    component is a star; each round halves what is left to do, and is written, so lineage stays short.
    """
    now, mark = written(edges, "crossings"), None
    while True:
        stat = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("image_id", "a", "b").cast("decimal(38,0)"))).first())
        if stat[0] == 0 or stat == mark:
            return now.select("image_id", F.col("a").alias("root"), F.col("b").alias("low"))
        mark = stat
        both = now.union(now.select("image_id", "b", "a"))
        seen = both.groupBy("image_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(seen, ["image_id", "a"]).select("image_id", F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("image_id", "a").agg(F.min("b").alias("m"))
        moved = large.join(least, ["image_id", "a"]).filter("b <> m").select("image_id", F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, written(moved.union(least.select("image_id", "a", "m")).distinct(), "crossings")
        discard(last)


def _labelled_apart(on: DataFrame, connectivity: int, max_label: int, side: int) -> DataFrame:
    """Labels of the runs of true pixels (image_id, x, y); no task holds more than some tiles, or a few rows' components, of an image.

    The labels that max_label bounds are the final ones: a tile's own are numbers that never leave it.
    """
    with only(on.sparkSession) as results:
        found = written(_tile_runs(on, connectivity, side), "runs")
        low = contracted(_crossings(found, connectivity, side))
        own = found.filter("run = root").join(low, ["image_id", "root"], "left")
        rooted = own.select("image_id", F.col("root").alias("run"), "y", F.coalesce("low", "root").alias("root"))
        labels = written(_numbered(rooted), "labels")
        check_labels(labels.agg(F.max("label")).first()[0] or 0, max_label)
        out = written(found.join(labels.withColumnRenamed("run", "root"), ["image_id", "root"]).select("image_id", "y", "x0", "x1", "label"), "labelled")
        results.append(out)
    return out


def connected_components(mask: ImageFrame, connectivity: int = CONNECTIVITY_4, max_label: int = MAX_LABEL, distributed: bool = False, tile: int = TILE) -> Labeling:
    if mask.pixel.name != "Bool":
        raise PixelTypeError(f"components need a binary image, not {mask.pixel.name}")
    if not distributed:
        return Labeling(_labelled_in_place(mask, connectivity, max_label), mask.images())
    on = exploded(mask.df.select("image_id", "width", F.posexplode_outer("v").alias("_i", "v"))).filter("v")
    at = on.select("image_id", (F.col("_i") % F.col("width")).alias("x"), F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"))
    return Labeling(_labelled_apart(at, connectivity, max_label, tile), mask.images())


def components_of_pixels(pixels: DataFrame, images: DataFrame, connectivity: int = CONNECTIVITY_4, max_label: int = MAX_LABEL, tile: int = TILE) -> Labeling:
    """Components of masks given as pixel rows (image_id, x, y, v) and sizes, for images that do not fit a row; rows of false pixels may be absent."""
    on = pixels.filter("v").select("image_id", "x", "y").join(small(images.select("image_id")), "image_id", "left_semi")
    return Labeling(_labelled_apart(on, connectivity, max_label, tile), images)


def connected_components_with_stats(mask: ImageFrame, connectivity: int = CONNECTIVITY_4, distributed: bool = False) -> tuple[Labeling, DataFrame]:
    labels = connected_components(mask, connectivity, distributed=distributed)
    return labels, labels.stats()
