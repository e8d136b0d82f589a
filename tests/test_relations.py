"""Tables of rectangles against plain loops, and raw files that are written and read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import errors, joins
from rasterloom.operators import integral, regions
from rasterloom.shapes import Rectangle
from rasterloom.sources import images as src
from rasterloom.sources import raw


def noisy(spark, *sizes, pixel="Mono8"):
    rng = np.random.default_rng(1)
    made = [rng.integers(0, 256, (h, w)) for w, h in sizes]
    return made, src.from_rows(spark, [(k, a.shape[1], a.shape[0], a.ravel().tolist()) for k, a in enumerate(made)], pixel)


def boxes(spark, images, n):
    r = random.Random(2)
    rows = [(k, r.randrange(images + 1), r.randrange(-2, 20), r.randrange(-2, 20), r.randrange(0, 15), r.randrange(0, 15)) for k in range(n)]
    rows += [(n, 0, 0, 0, 20, 17), (n, 0, 0, 0, 20, 17), (n + 1, 0, None, 0, 1, 1), (n + 2, None, 0, 0, 1, 1), (n + 3, 0, 0, 0, 0, 0)] + [(n + 4 + k, 0, 20 - k % 3 - 1, 16, k % 3 + 1, 1) for k in range(40)]
    return rows, spark.createDataFrame(rows, "rect_id long, image_id long, left int, top int, width int, height int")


def test_region_sums_of_many_rectangles(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW", 3)
    made, frame = noisy(spark, (20, 17), (3, 30))
    rows, rects = boxes(spark, 2, 120)
    table = integral.integral_of_pixels(frame.pixels(), frame.images(), "Mono8", "Mono64")
    by_rows = integral.region_sums(table, frame.images(), "Mono64", rects).collect()
    by_images = integral.integral_image(frame, "MonoF64").region_sums(rects).collect()
    for got, kind in ((by_rows, int), (by_images, float)):
        assert len(got) == len(set(rows))
        for r in got:
            a = made[r.image_id] if r.image_id in (0, 1) else None
            fits = a is not None and r.left is not None and min(r.left, r.top) >= 0 and r.left + r.width <= a.shape[1] and r.top + r.height <= a.shape[0]
            assert r.v == (kind(a[r.top : r.top + r.height, r.left : r.left + r.width].sum()) if fits else None), r
    one = integral.integral_image(frame, "Mono64")
    same = {r.image_id: r.v for r in one.region_sum(Rectangle.of(1, 2, 2, 5)).collect()}
    told = one.region_sums(spark.createDataFrame([(k, k, 1, 2, 2, 5) for k in (0, 1)], rects.schema)).collect()
    assert {r.image_id: r.v for r in told} == same


def test_regions_bring_each_pixel_and_rectangle_together_once(spark, monkeypatch):
    made, frame = noisy(spark, (20, 17), (3, 30))
    rows, rects = boxes(spark, 2, 60)
    for cell in (1, 4, 256):
        monkeypatch.setattr(regions, "CELL", cell)
        got = sorted(map(tuple, regions.regions_of_pixels(frame.pixels(), rects).collect()))
        expect = []
        for k, image, left, top, w, h in {r for r in rows if None not in r and r[1] < 2}:
            a = made[image]
            expect += [(k, image, x - left, y - top, int(a[y, x])) for y in range(max(top, 0), min(top + h, a.shape[0])) for x in range(max(left, 0), min(left + w, a.shape[1]))]
        assert got == sorted(expect)
    assert regions.regions_of_pixels(frame.pixels(), rects.limit(0)).collect() == []


@pytest.mark.parametrize("pixel", ["Mono8", "Mono16", "Mono64", "MonoF32", "Bool", "Rgb8", "Rgba16"])
def test_raw_files_round_trip(spark, tmp_path, pixel):
    p = src.pixel_type(pixel)
    values = lambda k: [bool(k % 3)] * len(p.channels) if pixel == "Bool" else [min(p.max or 9**9, 251 * k * (c + 1)) for c in range(len(p.channels))]
    rows = [("a/b", 3, 5), ("c d", 1, 1), ("e", 0, 0), ("f", 2, 4)]
    frame = src.from_rows(spark, [(i, w, h, [tuple(values(k)) if len(p.channels) > 1 else values(k)[0] for k in range(w * h)]) for i, w, h in rows], pixel)
    raw.write(frame, str(tmp_path / "x"))
    assert len(list((tmp_path / "x").iterdir())) == 4
    for band in (1, 40, 1 << 20):
        lines = raw.read_lines(spark, str(tmp_path / "x"), pixel, band=band)
        got = raw.pixels_of_lines(lines, list(p.channels)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, frame.pixels().collect()))
        assert lines.count() == 10
    if pixel == "Rgb8":
        assert raw.read_lines(spark, "file://" + str(tmp_path / "x"), pixel, ["b"]).columns == ["image_id", "width", "height", "y", "b"]
        with pytest.raises(Exception, match="no channels"):
            raw.read_lines(spark, str(tmp_path / "x"), pixel, ["q"])


def test_raw_files_that_are_broken_or_of_another_type(spark, tmp_path):
    _, frame = noisy(spark, (4, 4))
    raw.write(frame, str(tmp_path))
    with pytest.raises(Exception, match="holds Mono8"):
        raw.read_lines(spark, str(tmp_path), "Mono16").collect()
    name = next(f for f in tmp_path.iterdir() if f.suffix == raw.ENDING)
    name.write_bytes(name.read_bytes()[:-1])
    with pytest.raises(Exception, match="LengthMismatch"):
        raw.read_lines(spark, str(tmp_path), "Mono8").collect()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert raw.read_lines(spark, str(empty), "Mono8").collect() == []


def test_raw_files_are_planned_by_their_lengths(spark, tmp_path):
    rng = np.random.default_rng(3)
    shapes = [(1, 3000), (700, 2), (5, 0), (0, 5), *[(2, 2)] * 600]
    images = [(f"i{k}", w, h, rng.integers(0, 256, w * h).tolist()) for k, (w, h) in enumerate(shapes)]
    raw.write(src.from_rows(spark, images, "Mono8"), str(tmp_path))
    reader = raw._Reader(str(tmp_path), src.pixel_type("Mono8"), ["v"], 10)
    lines = {}
    parts = reader.partitions()
    assert len(parts) <= 2 * raw.PARTS
    for part in parts:
        for batch in reader.read(part):
            for row in batch.to_pylist():
                assert (row["image_id"], row["y"]) not in lines
                lines[row["image_id"], row["y"]] = row["v"]
    assert lines == {(i, y): v[y * w : (y + 1) * w] for i, w, h, v in images for y in range(h)}
    assert sum(len(part.bands) for part in parts) > len(images)  # a file is cut
    (tmp_path / "i7.raw").write_bytes(b"RLRA")
    assert len(reader.partitions()) == len(parts)  # no file is opened for a plan
    with pytest.raises(errors.LengthMismatch):
        [b for part in parts for b in reader.read(part)]


def test_raw_bytes_of_their_own_sizes(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(bytes([1, 2, 3]))
    (tmp_path / "q.bin").write_bytes(bytes([4, 5, 6, 7]))
    sizes = spark.createDataFrame([("p.bin", 3, 1), ("q.bin", 2, 2)], "name string, width int, height int")
    got = src.read_raw_sized(spark, str(tmp_path), sizes, "Mono8").df.select(F.element_at(F.split("image_id", "/"), -1).alias("n"), "width", "height", "v").collect()
    assert sorted((r.n, r.width, r.height, r.v) for r in got) == [("p.bin", 3, 1, [1, 2, 3]), ("q.bin", 2, 2, [4, 5, 6, 7])]
    with pytest.raises(Exception, match="LengthMismatch"):
        src.read_raw_sized(spark, str(tmp_path), sizes.withColumn("width", F.lit(9)), "Mono8").df.collect()
    assert errors.LengthMismatch
