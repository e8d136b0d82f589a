"""Images of pixel rows, large masks and large templates against what whole images and plain loops give."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom import errors
from rasterloom.operators import components, engine, filters, geometry, histogram, morphology, template, tiling
from rasterloom.operators import neighborhood as nb
from rasterloom.pixel import pixel_type
from rasterloom.shapes import Size
from rasterloom.sources import images as src

BORDERS = [nb.Skip(), nb.ClampBorder(), nb.Mirror(), nb.Wrap(), nb.Constant(9)]


def frame(spark, *arrays, pixel="Mono8"):
    return src.from_rows(spark, [(k, a.shape[1], a.shape[0], a.ravel().tolist()) for k, a in enumerate(arrays)], pixel)


def arrays(f):
    return {r.image_id: np.array(r[f.pixel.channels[0]]).reshape(r.height, r.width) for r in f.df.collect()}


def rows(df):
    return sorted(map(tuple, df.collect()))


def noise(seed, *shapes, top=256):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, top, s) for s in shapes]


def taps(a, kernel, border, y, x):
    """(weight, sample) of the cells at output (x, y), by the meaning of each border."""
    h, w = a.shape
    ax, ay = (0, 0) if not border.full else kernel.anchor
    fold = lambda k, n: 0 if n == 1 else min(k % (2 * n - 2), 2 * n - 2 - k % (2 * n - 2))
    out = []
    for k, weight in enumerate(kernel.data):
        v, u = y + k // kernel.width - ay, x + k % kernel.width - ax
        if isinstance(border, nb.ClampBorder):
            v, u = min(max(v, 0), h - 1), min(max(u, 0), w - 1)
        elif isinstance(border, nb.Mirror):
            v, u = fold(v, h), fold(u, w)
        elif isinstance(border, nb.Wrap):
            v, u = v % h, u % w
        out.append((weight, int(a[v, u]) if 0 <= v < h and 0 <= u < w else border.value))
    return out


def whole(a, kernel, border, value):
    h, w = a.shape if border.full else (max(a.shape[0] - kernel.height + 1, 0), max(a.shape[1] - kernel.width + 1, 0))
    h, w = (h, w) if h * w else (0, 0)
    at = (0, 0) if border.full else (kernel.anchor[1], kernel.anchor[0])
    return np.array([[value(taps(a, kernel, border, y, x), int(a[y + at[0], x + at[1]])) for x in range(w)] for y in range(h)]).reshape(h, w)


def masks():
    rng = np.random.default_rng(1)
    yield nb._full(7, 4, True)
    yield nb.Kernel.of([[bool(v) for v in r] for r in rng.random((5, 9)) < 0.4], (8, 0))
    yield nb.Kernel.of([[(x - 5) ** 2 + (y - 5) ** 2 <= 25 for x in range(11)] for y in range(11)])


@pytest.mark.parametrize("border", BORDERS, ids=lambda b: type(b).__name__)
def test_extrema_medians_and_sums_of_any_mask(spark, border):
    images = noise(2, (1, 1), (3, 17), (13, 14), (13, 14), (12, 6))
    f = frame(spark, *images)
    for mask in masks():
        expect = {"erode": lambda t, c: min([c, *(v for w, v in t if w)]), "dilate": lambda t, c: max([c, *(v for w, v in t if w)]), "median": lambda t, c: sorted(v for w, v in t if w)[sum(map(bool, mask.data)) // 2]}  # noqa: B023
        for name, op in (("erode", morphology.erode), ("dilate", morphology.dilate), ("median", morphology.median_filter)):
            got = arrays(op(f, mask, border))
            for k, a in enumerate(images):
                assert np.array_equal(got[k], whole(a, mask, border, expect[name])), (name, k)
        kernel = nb.Kernel.of([[int(w) * (x - y) for x, w in enumerate(r)] for y, r in enumerate(mask.rows())], mask.anchor)
        got = arrays(filters.correlate(f, kernel, border))
        for k, a in enumerate(images):
            assert np.array_equal(got[k], whole(a, kernel, border, lambda t, c: float(sum(w * v for w, v in t))))


def test_medians_of_wide_types(spark):
    images = noise(3, (9, 8), top=60000)
    mask = nb._full(7, 7, True)
    got = arrays(morphology.median_filter(frame(spark, *images, pixel="Mono16"), mask, nb.Mirror()))
    assert np.array_equal(got[0], whole(images[0], mask, nb.Mirror(), lambda t, c: sorted(v for _, v in t)[24]))
    flags = frame(spark, images[0] % 2 == 0, pixel="Bool")
    assert arrays(morphology.erode(flags, mask, nb.ClampBorder()))[0].tolist() == (whole(images[0] % 2 == 0, mask, nb.ClampBorder(), lambda t, c: min([c, *(v for _, v in t)])) > 0).tolist()


def own_operators():
    """Classes made in a function travel to workers as they are; others must be importable there."""

    class Spread(engine.FoldOp):
        def init(self, shape):
            return np.full(shape, 2**31), np.full(shape, -(2**31))

        def accumulate(self, state, samples, weight):
            return np.minimum(state[0], samples * weight), np.maximum(state[1], samples * weight)

        def finalize(self, state):
            return (state[1] - state[0]).astype(np.int32)

    class Brighter(engine.MapOp):
        def init(self, centre):
            return np.zeros(centre.shape, np.int32)

        def accumulate(self, state, centre, samples):
            return state + (samples > centre)

        def finalize(self, state, centre):
            return state

    return Spread(), Brighter()


def test_own_accumulators(spark):
    spread, brighter = own_operators()
    images = noise(4, (7, 9), (5, 5))
    f = frame(spark, *images)
    for border in BORDERS:
        kernel = nb.Kernel.of([[1, 2, 3], [0, 1, 0]])
        got = arrays(nb.fold_neighborhood(f, kernel, border, spread, "Mono8"))
        more = arrays(nb.map_neighborhood(f, nb.CROSS_3X3, border, brighter))
        for k, a in enumerate(images):
            assert np.array_equal(got[k], whole(a, kernel, border, lambda t, c: max(w * v for w, v in t) - min(w * v for w, v in t)))
            assert np.array_equal(more[k], whole(a, nb.CROSS_3X3, border, lambda t, c: sum(v > c for w, v in t if w)))


def test_bands_make_no_difference(monkeypatch):
    a = np.stack(noise(14, (23, 9), (23, 9)))
    kernel, op = nb.Kernel.of([[1, -2, 3], [0.5, 1, 0], [2, 2, 2]]), engine.WeightedSum("float", True, pixel_type("MonoF32"))
    once = [engine.folded(a, kernel, b, None if not isinstance(b, nb.Constant) else 9, op) for b in BORDERS]
    monkeypatch.setattr(engine, "BAND", 20)
    again = [engine.folded(a, kernel, b, None if not isinstance(b, nb.Constant) else 9, op) for b in BORDERS]
    assert all(np.array_equal(x, y) for x, y in zip(once, again, strict=True))


class Edge(nb.Border):
    """A policy of one's own that only places Columns."""

    def place(self, at, n):
        return F.least(F.greatest(at, F.lit(0)), n - 1)


def test_own_borders_without_arrays_still_run(spark):
    images = noise(5, (6, 5))
    f = frame(spark, *images)
    for op in (lambda b: filters.sobel_x(f, b), lambda b: filters.box_blur_3x3(f, b), lambda b: morphology.erode(f, nb.CROSS_3X3, b), lambda b: morphology.median_filter(f, nb.FULL_RECT_3X3, b)):
        assert np.array_equal(arrays(op(Edge()))[0], arrays(op(nb.ClampBorder()))[0])
    with pytest.raises(errors.BorderError):
        nb.fold_neighborhood(f, nb.FULL_RECT_3X3, Edge(), own_operators()[0], "Mono8")


def test_templates_by_tables_equal_the_scan(spark, monkeypatch):
    for pixel, top in (("Mono8", 256), ("Mono16", 65536), ("Mono8", 2)):
        image, shape = noise(6, (70, 90), (9, 12), top=top)
        f = frame(spark, image, image[:30, :40], pixel=pixel)
        shown = template.Template(Size(12, 9), shape.ravel().tolist())
        for method in (template.SSD(), template.NCC()):
            monkeypatch.setattr(template, "TABLED", 64)
            by_tables = arrays(template.match_template(f, shown, method))
            monkeypatch.setattr(template, "TABLED", 10**9)
            scanned = arrays(template.match_template(f, shown, method))
            assert all(np.array_equal(by_tables[k], scanned[k], equal_nan=True) for k in (0, 1))
    colours = src.from_rows(spark, [(0, 20, 18, [tuple(map(int, v)) for v in noise(7, (360, 3))[0]])], "Rgb8")
    shown = template.Template(Size(8, 8), *(c.tolist() for c in noise(8, (64,), (64,), (64,))))
    monkeypatch.setattr(template, "TABLED", 64)
    one = arrays(template.match_template(colours, shown, template.NCC()))[0]
    monkeypatch.setattr(template, "TABLED", 10**9)
    assert np.array_equal(one, arrays(template.match_template(colours, shown, template.NCC()))[0])


def test_cross_products_are_exact(monkeypatch):
    monkeypatch.setattr(template, "TILE", 128)
    for seed, shape, size, top in ((1, (400, 300), (64, 64), 256), (2, (257, 129), (128, 100), 65536)):
        image, part = noise(seed, shape, size, top=top)
        got = template.cross_products(image, part)
        rng = np.random.default_rng(seed)
        for _ in range(50):
            y, x = rng.integers(0, got.shape[0]), rng.integers(0, got.shape[1])
            assert got[y, x] == (image[y : y + size[0], x : x + size[1]] * part).sum()


@pytest.mark.parametrize("side", [1, 3, 8, 64])
def test_components_by_tiles_equal_those_in_place(spark, side):
    rng = np.random.default_rng(9)
    spiral = np.zeros((21, 21), bool)
    for k in range(0, 11, 2):
        spiral[k, k : 21 - k] = spiral[20 - k, k : 21 - k] = True
        spiral[k : 21 - k, 20 - k] = True
        spiral[k + 2 : 21 - k, k] = True
    images = [rng.random((17, 19)) < 0.6, spiral, np.ones((9, 9), bool), np.zeros((4, 4), bool), np.indices((12, 13)).sum(axis=0) % 2 == 0]
    f = frame(spark, *images, pixel="Bool")
    for connectivity in (components.CONNECTIVITY_4, components.CONNECTIVITY_8):
        mine = components.components_of_pixels(f.pixels(), f.images(), connectivity, tile=side)
        there = components.connected_components(f, connectivity)
        assert rows(mine.pixels().select("image_id", "x", "y", "label")) == rows(there.pixels().select("image_id", "x", "y", "label"))
        assert rows(mine.counts()) == rows(there.counts())
        assert rows(mine.stats()) == rows(there.stats())
    with pytest.raises(errors.LabelOverflow):
        components.components_of_pixels(f.pixels(), f.images(), max_label=20, tile=side)


def test_tiles_are_labelled_many_at_once(spark):
    rng = np.random.default_rng(16)
    images = list(rng.random((40, 8, 8)) < 0.5)
    f = frame(spark, *images, pixel="Bool")
    found = components._tile_runs(f.pixels().filter("v"), components.CONNECTIVITY_4, 3)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    twice = f.pixels().union(f.pixels()).withColumn("image_id", F.concat(F.lit("image "), "image_id"))
    named = f.images().withColumn("image_id", F.concat(F.lit("image "), "image_id"))
    got = components.components_of_pixels(twice, named, tile=3).pixels()
    assert rows(got) == rows(components.connected_components(f).pixels().withColumn("image_id", F.concat(F.lit("image "), "image_id")).select(*got.columns))


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_groups_stay_whole(monkeypatch, most):
    monkeypatch.setattr(components, "ROWS", most)
    keys = [0] * 3 + [1] * 7 + [None] + [2] * 2 + [3]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 2], pa.int64()), pa.array(range(k, min(k + 2, len(keys))))], names=["g", "v"]) for k in range(0, len(keys), 2)]
    got = []
    for table, starts in components._groups(iter(batches), ["g"]):
        got += [table["v"][int(a) : int(b)].to_pylist() for a, b in itertools.pairwise([*starts, table.num_rows])]
    assert got == [[0, 1, 2], [3, 4, 5, 6, 7, 8, 9], [10], [11, 12], [13]]
    assert list(components._groups(iter(()), ["g"])) == []


@pytest.mark.parametrize("alone", [0, 30, 1 << 20])
def test_images_of_many_crossings_are_contracted_by_rounds(spark, monkeypatch, alone):
    monkeypatch.setattr(components, "ALONE", alone)
    rng = np.random.default_rng(15)
    edges, expect = [], set()
    for image, n in (("a", 12), ("b", 60), ("c", 61)):
        pairs = [tuple(map(int, sorted(p, reverse=True))) for p in rng.integers(0, 80, (n, 2)) if p[0] != p[1]]
        low = list(range(80))
        while any(low[a] != low[b] for a, b in pairs):
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        edges += [(image, *p) for p in set(pairs)]
        expect |= {(image, k, v) for k, v in enumerate(low) if k != v}
    assert set(rows(components.contracted(spark.createDataFrame(edges, "image_id string, a long, b long")))) == expect
    assert rows(components.contracted(spark.createDataFrame([], "image_id string, a long, b long"))) == []


def test_tiles_that_wrap_and_tiles_that_shrink(spark):
    images = noise(10, (17, 23), (4, 5), (1, 2))
    f = frame(spark, *images)
    ops = (lambda g, b: filters.sharpen(g, b), lambda g, b: morphology.median_filter(g, nb.CROSS_5X5, b))
    for op, size in itertools.product(ops, (Size(6, 5), Size(40, 40))):
        assert rows(tiling.tiled_round(f.pixels(), f.images(), "Mono8", size, 2, op)) == rows(op(f, nb.Wrap()).pixels())
        assert rows(tiling.tiled_inside(f.pixels(), f.images(), "Mono8", size, (4, 4), lambda g: morphology.median_filter(g, nb.CROSS_5X5, nb.Skip()))) == rows(morphology.median_filter(f, nb.CROSS_5X5, nb.Skip()).pixels())
    shown = template.Template(Size(3, 2), [1, 200, 3, 90, 5, 6])
    large = frame(spark, *images[:2])
    got = tiling.tiled_inside(large.pixels(), large.images(), "Mono8", Size(7, 4), (2, 1), lambda g: template.match_template(g, shown, template.SSD()))
    assert rows(got) == rows(template.match_template(large, shown, template.SSD()).pixels())


def test_moves_and_resizing_of_pixel_rows(spark):
    images = noise(11, (9, 14), (1, 6), (5, 1), (30, 31))
    f = frame(spark, *images)
    for name in geometry.MOVES:
        assert rows(geometry.move_pixels(f.pixels(), f.images(), name)) == rows(getattr(geometry, name)(f).pixels()), name
    with pytest.raises(ValueError):
        geometry.move_pixels(f.pixels(), f.images(), "turn")
    for (w, h), method, block in itertools.product(((7, 40), (1, 3), (33, 2), (3, 3)), (geometry.Bilinear(), geometry.NearestNeighbor()), (4, 64)):
        got = geometry.resize_pixels(f.pixels(), f.images(), "Mono8", w, h, method, block=block)
        assert rows(got) == rows(geometry.resize(f, w, h, method).pixels()), (w, h, block)
    colours = src.from_rows(spark, [(0, 4, 4, [(k, 2 * k, 3 * k) for k in range(16)])], "RgbF64")
    assert rows(geometry.resize_pixels(colours.pixels(), colours.images(), "RgbF64", 7, 5, geometry.Bilinear())) == rows(geometry.resize(colours, 7, 5, geometry.Bilinear()).pixels())


class Column(geometry.Bilinear):
    """The same, by its expression alone."""

    gathers = False


def test_resizing_by_arrays_equals_the_expression(spark):
    for pixel, values in (("Mono8", noise(12, (6, 7))[0]), ("MonoF32", noise(12, (6, 7))[0] / 7), ("Mono32", noise(12, (6, 7), top=2**32)[0])):
        f = frame(spark, values, pixel=pixel)
        for w, h in ((13, 5), (2, 2), (1, 9)):
            assert arrays(geometry.resize(f, w, h, geometry.Bilinear()))[0].tolist() == arrays(geometry.resize(f, w, h, Column()))[0].tolist()


def test_histograms_in_place(spark):
    images = noise(13, (5, 5), (2, 3), (1, 1))
    f = frame(spark, *images)
    got = {(r.image_id, r.bin): r["count"] for r in histogram.histogram(f, histogram.NaturalBins()).collect()}
    assert len(got) == 3 * 256
    assert all(got[k, b] == (a == b).sum() for k, a in enumerate(images) for b in range(256))
    by_rows = {r.image_id: r.threshold for r in histogram.otsu_thresholds(histogram.histogram(f, histogram.NaturalBins())).collect()}
    masked = arrays(histogram.otsu_binary_mask(f))
    assert all(np.array_equal(masked[k], a > (by_rows[k] or 0)) for k, a in enumerate(images))
    luts = {(r.image_id, r.bin): r.value for r in histogram.equalization_luts(histogram.histogram(f, histogram.NaturalBins())).collect()}
    flat = arrays(histogram.equalize_image(f))
    assert all(flat[k][y, x] == luts[k, a[y, x]] for k, a in enumerate(images) for y, x in np.ndindex(*a.shape))
    empty = src.from_rows(spark, [(0, 0, 0, [])], "Mono8")
    assert histogram.histogram(empty, histogram.NaturalBins()).agg(F.sum("count")).first()[0] == 0 and histogram.outliers(empty, histogram.LinearBins(0, 255, 4)).collect() == []
    assert arrays(histogram.equalize_image(empty))[0].size == 0 and arrays(histogram.otsu_binary_mask(empty))[0].size == 0


