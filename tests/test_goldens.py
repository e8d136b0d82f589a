"""Small images whose results were worked out by hand, and laws that hold for any image."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rasterloom import errors
from rasterloom.functions import conversions as cv
from rasterloom.functions import scalars as sc
from rasterloom.operators import combine, components, filters, geometry, histogram, integral, morphology, planes, regions, template
from rasterloom.operators import neighborhood as nb
from rasterloom.operators.convert import convert_image
from rasterloom.operators.tiling import tiled
from rasterloom.pixel import PixelType, pixel_type, register, registered
from rasterloom.shapes import Rectangle, Size, Stride
from rasterloom.sources import images as src


def mono(spark, *rows, pixel="Mono8", first=0):
    """Images from lists of rows of values."""
    return src.from_rows(spark, [(first + k, len(r[0]) if r else 0, len(r), [v for line in r for v in line]) for k, r in enumerate(rows)], pixel)


def grid(frame, image=0):
    row = next(r for r in frame.df.collect() if r.image_id == image)
    c = frame.pixel.channels[0]
    return [list(row[c][y * row.width : (y + 1) * row.width]) for y in range(row.height)]


def test_constructors_and_sizes(spark):
    frame = mono(spark, [[1, 2], [3, 4], [5, 6]], [])
    assert frame.pixels().count() == 6 and frame.images().count() == 2
    with pytest.raises(errors.LengthMismatch):
        src.from_rows(spark, [(0, 2, 2, [1, 2, 3])], "Mono8")
    bad = spark.createDataFrame([(0, 2, 2, [1, 2, 3])], "image_id bigint, width int, height int, v array<int>")
    with pytest.raises(Exception, match="LengthMismatch"):
        src.from_table(bad, "Mono8").df.collect()
    sizes = spark.createDataFrame([(7, 3, 2), (8, 0, 0)], "image_id bigint, width int, height int")
    made = src.generate(sizes, "Mono8", lambda x, y: x + y * 10)
    assert grid(made, 7) == [[0, 1, 2], [10, 11, 12]] and grid(made, 8) == []
    assert grid(src.zero(sizes, "Mono8"), 7) == [[0] * 3] * 2
    assert grid(src.fill(sizes, "MonoF32", 1.5), 7) == [[1.5] * 3] * 2
    assert grid(type(frame).from_pixels(frame.pixels(), "Mono8", frame.images()), 1) == []
    assert grid(type(frame).from_pixels(frame.pixels(), "Mono8"), 0) == [[1, 2], [3, 4], [5, 6]]


@pytest.mark.parametrize("pixel,values", [("Mono8", [0, 255, 7, 9]), ("Mono16", [0, 65535, 258, 1]), ("Mono32", [0, 2**32 - 1, 5, 6]), ("Mono64", [0, 2**64 - 1, 5, 6]), ("MonoF32", [0.5, -1.0, 2.0, 8.25]), ("Rgb8", [(1, 2, 3), (4, 5, 6), (7, 8, 9), (10, 11, 12)])])
@pytest.mark.parametrize("order", ["little", "big", "native"])
def test_bytes_round_trip(spark, pixel, values, order):
    frame = src.from_rows(spark, [(0, 2, 2, values)], pixel)
    back = src.from_bytes(src.to_bytes(frame, order), pixel, order)
    assert frame.equals(back).first().equal


def test_bytes_layout(spark):
    frame = src.from_rows(spark, [(0, 1, 2, [258, 1])], "Mono16")
    assert bytes(src.to_bytes(frame, "big").first().data) == b"\x01\x02\x00\x01"
    assert bytes(src.to_bytes(frame, "little").first().data) == b"\x02\x01\x01\x00"
    rows = spark.createDataFrame([(0, 2, 2, bytearray(b"123"))], "image_id bigint, width int, height int, data binary")
    with pytest.raises(Exception, match="LengthMismatch"):
        src.from_bytes(rows, "Mono8").df.collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(bytes(range(12)))
    frame = src.read_raw(spark, str(tmp_path / "*.raw"), "Mono8", 4, 3)
    assert frame.df.first().v == list(range(12))
    src.save(frame, str(tmp_path / "saved"))
    assert src.load(spark, str(tmp_path / "saved")).equals(frame).first().equal


def test_views(spark):
    frame = mono(spark, [[1, 2, 3], [4, 5, 6]])
    assert frame.pixel_at(2, 1).first().v == 6 and frame.pixel_at(3, 0).first().v is None and frame.pixel_at(0, -1).first().v is None
    assert frame.row(1).first().v == [4, 5, 6] and frame.row(2).first().v is None
    assert grid(regions.roi(frame, Rectangle.of(1, 0, 2, 2))) == [[2, 3], [5, 6]]
    assert regions.roi(frame, Rectangle.of(2, 0, 2, 2)).df.count() == 0
    assert regions.sliding_windows(frame, Size(4, 1)).count() == 0
    assert regions.sliding_windows(frame, Size(2, 1), Stride(1, 1)).count() == 4
    cut = {r.number: (r.width, r.height, r.v) for r in regions.tiles(frame, Size(2, 2)).collect()}
    assert cut == {0: (2, 2, [1, 2, 4, 5]), 1: (1, 2, [3, 6])}
    changed = regions.map_tiles(frame, Size(2, 2), "number int, total long", lambda p: p.assign(total=p.v.map(sum))[["number", "total"]])
    assert {r.number: r.total for r in changed.collect()} == {0: 12, 1: 9}
    assert regions.interior(Size(10, 8), Size(3, 3), (1, 1)) == Rectangle.of(1, 1, 8, 6) and regions.interior(Size(2, 8), Size(3, 3), (1, 1)) is None


def convert(spark, pixel, values, strategy, dst=None):
    frame = src.from_rows(spark, [(0, len(values), 1, values)], pixel)
    out = convert_image(frame, strategy, dst)
    row = out.df.first()
    columns = [row[c] for c in out.pixel.channels]
    return columns[0] if len(columns) == 1 else list(zip(*columns, strict=True))


def test_full_range(spark):
    f = cv.FullRange()
    assert convert(spark, "Mono8", [0, 1, 255], f, "Mono16") == [0, 257, 65535]
    assert convert(spark, "Mono8", [255], f, "Mono64") == [2**64 - 1]
    assert convert(spark, "Mono64", [0, 2**64 - 1, 72340172838076672], f, "Mono8") == [0, 255, 1]
    assert convert(spark, "Mono32", [2**32 - 1, 2**31], f, "Mono16") == [65535, 32768]
    assert convert(spark, "MonoF32", [-1.0, 0.0, 0.5, 1.0, 7.0, float("nan")], f, "Mono8") == [0, 0, 128, 255, 255, 0]
    assert convert(spark, "MonoF64", [1.0, 0.0], f, "Mono64") == [2**64 - 1, 0]
    assert convert(spark, "Mono8", [255, 0], f, "MonoF32") == [1.0, 0.0]
    assert convert(spark, "Mono10", [0, 1023, 512], f, "Mono8") == [0, 255, 128]
    assert convert(spark, "Mono14", [16383], f, "Mono64") == [2**64 - 1]
    for pair in (("Mono8", "Rgb16"), ("Srgb8", "Srgb16"), ("Rgb10", "Rgb8"), ("Mono8", "Mono10")):
        with pytest.raises(errors.PixelTypeError):
            f.target(*map(pixel_type, pair))


def test_other_conversions(spark):
    assert convert(spark, "Rgb8", [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)], cv.Luminance()) == [77, 149, 29, 255]
    assert convert(spark, "Rgba8", [(255, 0, 0, 9)], cv.Luminance(), "MonoA8") == [(77, 9)]
    assert convert(spark, "Mono16", [7, 300], cv.Narrow(), "Mono8") == [7, 255]
    assert convert(spark, "Mono8", [3], cv.Broadcast(), "Bgra8") == [(3, 3, 3, 255)]
    assert convert(spark, "Rgb8", [(1, 2, 3)], cv.ColorSwap()) == [(3, 2, 1)]
    assert convert(spark, "MonoF32", [0.25], cv.AddAlpha()) == [(0.25, 1.0)]
    assert convert(spark, "Rgba8", [(1, 2, 3, 4)], cv.Invert()) == [(254, 253, 252, 251)]
    assert convert(spark, "Mono10", [0, 23], cv.Invert()) == [1023, 1000]
    assert convert(spark, "Mono10", [5, 6], cv.BinaryThreshold(5)) == [0, 1023]
    assert convert(spark, "Mono8", [5, 6], cv.BinaryThresholdInv(5)) == [255, 0]
    assert convert(spark, "Mono8", [4, 6], cv.TruncateThreshold(5)) == [4, 5]
    assert convert(spark, "Mono8", [5, 6], cv.ToZeroThreshold(5)) == [0, 6]
    assert convert(spark, "Mono8", [5, 6], cv.ToZeroThresholdInv(5)) == [5, 0]
    assert convert(spark, "Rgb8", [(6, 6, 5), (6, 6, 6)], cv.BinaryMask(5)) == [False, True]
    assert convert(spark, "Mono8", [1, 5, 9], cv.Clamp(2, 6)) == [2, 5, 6]
    assert convert(spark, "Mono8", [123, 0, 255], cv.BrightnessContrast(10.0, 0.5)) == [72, 10, 138]
    assert convert(spark, "Srgb8", [(0, 255, 128)], cv.SrgbGamma().then(cv.SrgbGamma(), "RgbF32"), "Srgb8") == [(0, 255, 128)]
    assert math.isclose(convert(spark, "SrgbMono8", [128], cv.SrgbGamma())[0], 0.2158605, rel_tol=1e-5)
    assert convert(spark, "Indexed8", [1, 0, 200], cv.Depalettize.of([(1, 2, 3), (4, 5, 6)], "Rgb8")) == [(4, 5, 6), (1, 2, 3), (0, 0, 0)]
    assert cv.Lut.from_fn(lambda i: 255 - i, "Mono8").lookup(3) == 252 and cv.ChannelLut.from_fn(lambda i: i // 2).lookup(9) == 4
    with pytest.raises(ValueError):
        cv.Clamp(3, 2)
    for strategy, pixel in ((cv.Invert(), "MonoF32"), (cv.BinaryThreshold(1), "MonoF64"), (cv.BrightnessContrast(), "Srgb8"), (cv.ColorSwap(), "Mono8"), (cv.Luminance(), "Srgb8"), (cv.ChannelLut.from_fn(lambda i: i), "Mono16")):
        with pytest.raises(errors.PixelTypeError):
            strategy.target(pixel_type(pixel), None)


def test_combinations(spark):
    a, b = mono(spark, [[200, 10], [0, 255]]), mono(spark, [[100, 20], [0, 1]])
    assert grid(combine.add(a, b)) == [[255, 30], [0, 255]]
    assert grid(combine.subtract(a, b)) == [[100, 0], [0, 254]]
    assert grid(combine.abs_diff(a, b)) == [[100, 10], [0, 254]]
    assert grid(combine.image_min(a, b)) == [[100, 10], [0, 1]] and grid(combine.image_max(a, b)) == [[200, 20], [0, 255]]
    assert grid(combine.combine_images(a, b, combine.PixelMultiply())) == [[255, 200], [0, 255]]
    assert grid(combine.combine_images(a, b, combine.Blend(0.5))) == [[150.0, 15.0], [0.0, 128.0]]
    assert combine.combine_images(a, b, combine.Blend(0.5)).pixel.name == "MonoF32"
    assert grid(combine.combine_images_fn(a, b, lambda x, y: x - x + y)) == grid(b)
    with pytest.raises(Exception, match="SizeMismatch"):
        combine.add(a, mono(spark, [[1]])).df.collect()
    srgb = src.from_rows(spark, [(0, 1, 1, [5])], "SrgbMono8")
    with pytest.raises(errors.PixelTypeError):
        combine.combine_images(srgb, srgb, combine.Blend(0.5))
    with pytest.raises(errors.PixelTypeError):
        combine.add(a, srgb)


def test_planes(spark):
    frame = src.from_rows(spark, [(0, 2, 1, [(1, 2, 3), (4, 5, 6)])], "Rgb8")
    parts = planes.planes(frame)
    assert [grid(p) for p in parts] == [[[1, 4]], [[2, 5]], [[3, 6]]]
    assert planes.from_planes(parts, "Rgb8").equals(frame).first().equal
    swapped = planes.replace_plane(frame, 1, parts[0])
    assert swapped.df.first().g == [1, 4]
    assert planes.from_interleaved(planes.to_interleaved(frame), "Rgb8").equals(frame).first().equal
    with pytest.raises(errors.ChannelCountMismatch):
        planes.from_planes(parts[:2], "Rgb8")
    with pytest.raises(Exception, match="SizeMismatch"):
        planes.from_planes([parts[0], parts[1], mono(spark, [[1]])], "Rgb8").df.collect()


def test_geometry(spark):
    f = mono(spark, [[1, 2, 3], [4, 5, 6]])
    assert grid(geometry.flip_h(f)) == [[3, 2, 1], [6, 5, 4]] and grid(geometry.flip_v(f)) == [[4, 5, 6], [1, 2, 3]]
    assert grid(geometry.rotate_90(f)) == [[3, 6], [2, 5], [1, 4]] and grid(geometry.rotate_270(f)) == [[4, 1], [5, 2], [6, 3]]
    assert grid(geometry.rotate_180(f)) == [[6, 5, 4], [3, 2, 1]] and grid(geometry.transpose(f)) == [[1, 4], [2, 5], [3, 6]]
    assert grid(geometry.rotate_270(geometry.rotate_90(f))) == grid(f) == grid(geometry.transpose(geometry.transpose(f)))
    assert grid(geometry.rotate_90(mono(spark, [[1, 2]]))) == [[2], [1]]


def test_resize(spark):
    f = mono(spark, [[0, 100], [200, 40]])
    assert grid(geometry.resize(f, 3, 3, geometry.Bilinear())) == [[0, 50, 100], [100, 85, 70], [200, 120, 40]]
    assert grid(geometry.resize(f, 3, 3, geometry.NearestNeighbor())) == [[0, 0, 100], [0, 0, 100], [200, 200, 40]]
    assert grid(geometry.resize(mono(spark, [[9]]), 3, 2, geometry.Bilinear())) == [[9] * 3] * 2
    assert grid(geometry.resize(f, 1, 1, geometry.NearestNeighbor())) == [[0]]
    assert geometry.resize(f, 2, 2, geometry.NearestNeighbor(), "Mono16").pixel.name == "Mono16"
    with pytest.raises(errors.PixelTypeError):
        geometry.resize(src.from_rows(spark, [(0, 1, 1, [5])], "SrgbMono8"), 2, 2, geometry.Bilinear())


STEP = [[0] * 4 + [200] * 4] * 8


def test_filters(spark):
    edge = grid(filters.sobel_x(mono(spark, STEP), nb.ClampBorder()))
    assert edge[3] == [0, 0, 0, -800, -800, 0, 0, 0]
    assert grid(filters.sobel_y(mono(spark, STEP), nb.ClampBorder())) == [[0] * 8] * 8
    spot = [[255 if (x, y) == (4, 4) else 0 for x in range(8)] for y in range(8)]
    blurred = grid(filters.box_blur_3x3(mono(spark, spot), nb.ClampBorder()))
    assert all(blurred[y][x] == (28 if 3 <= x <= 5 and 3 <= y <= 5 else 0) for y in range(8) for x in range(8))
    assert grid(filters.gaussian_blur_3x3(mono(spark, [[10] * 3] * 3), nb.ClampBorder()))[1][1] == 160
    assert grid(filters.gaussian_blur_3x3(mono(spark, [[20] * 3] * 3), nb.ClampBorder()))[1][1] == 255
    assert grid(filters.convolve(mono(spark, [[5]]), nb.IDENTITY_3X3, nb.ClampBorder(), "Mono8")) == [[5]]
    shrunk = filters.convolve(mono(spark, [[1, 2], [3, 4]]), nb.BOX_BLUR_3X3, nb.Skip())
    assert grid(shrunk) == []
    odd = nb.Kernel.of([[1, 2, 3]], (0, 0))
    assert grid(filters.correlate(mono(spark, [[1, 10, 100, 0]]), odd, nb.Skip())) == [[321.0, 210.0]]
    assert grid(filters.convolve(mono(spark, [[1, 10, 100, 0]]), odd, nb.Constant(0))) == [[1.0, 12.0, 123.0, 230.0]]
    with pytest.raises(errors.PixelTypeError):
        filters.sobel_x(src.from_rows(spark, [(0, 1, 1, [5])], "SrgbMono8"), nb.ClampBorder())
    with pytest.raises(ValueError):
        nb.Kernel.of([[1, 2]], (2, 0))


def test_separable_kernels_agree_with_whole_ones(spark):
    rng = random.Random(1)
    f = mono(spark, [[rng.randrange(256) for _ in range(7)] for _ in range(6)])
    for whole, pair in ((nb.GAUSSIAN_3X3, nb.GAUSSIAN_3), (nb.GAUSSIAN_5X5, nb.GAUSSIAN_5)):
        assert whole.separated() is not None
        for border in (nb.ClampBorder(), nb.Mirror(), nb.Wrap(), nb.Skip()):
            assert grid(filters.convolve(f, whole, border)) == grid(filters.convolve_separable(f, pair, border))
    assert nb.LAPLACIAN.separated() is None


@pytest.mark.parametrize("border,expected", [(nb.ClampBorder(), [1, 1, 1, 2, 3, 3, 3]), (nb.Mirror(), [3, 2, 1, 2, 3, 2, 1]), (nb.Wrap(), [2, 3, 1, 2, 3, 1, 2]), (nb.Constant(9), [9, 9, 1, 2, 3, 9, 9])])
def test_borders(spark, border, expected):
    got = []
    for dx in range(-2, 3):
        tap = nb.Kernel.of([[int(k == dx + 2) for k in range(5)]])
        got.append(grid(filters.correlate(mono(spark, [[1, 2, 3]]), tap, border, "Mono8"))[0])
    assert [got[0][0], got[1][0], got[2][0], got[2][1], got[2][2], got[3][2], got[4][2]] == expected
    alone = filters.correlate(mono(spark, [[7]]), nb.Kernel.of([[1, 0, 0]]), border, "Mono8")
    assert grid(alone) == [[9 if isinstance(border, nb.Constant) else 7]]


def test_morphology(spark):
    rng = random.Random(4)
    f = mono(spark, [[rng.randrange(256) for _ in range(6)] for _ in range(5)])
    b, m = nb.ClampBorder(), nb.FULL_RECT_3X3
    low, high, own = grid(morphology.erode(f, m, b)), grid(morphology.dilate(f, m, b)), grid(f)
    assert all(p <= q <= r for x, y, z in zip(low, own, high, strict=True) for p, q, r in zip(x, y, z, strict=True))
    opened, closed = morphology.opening(f, m, b), morphology.closing(f, m, b)
    assert grid(morphology.opening(opened, m, b)) == grid(opened) and grid(morphology.closing(closed, m, b)) == grid(closed)
    spike = [[200 if (x, y) == (2, 2) else 50 for x in range(5)] for y in range(5)]
    assert grid(morphology.median_filter(mono(spark, spike), m, b)) == [[50] * 5] * 5
    assert grid(morphology.top_hat(mono(spark, spike), m, b))[2][2] == 150
    away = nb.Kernel.of([[False, False, False], [False, False, True], [False, False, False]])
    assert grid(morphology.erode(mono(spark, [[1, 9, 5]]), away, b)) == [[1, 5, 5]]
    mask = convert_image(mono(spark, spike), cv.BinaryMask(100))
    assert sum(map(sum, grid(morphology.dilate(mask, nb.CROSS_3X3, b)))) == 5
    with pytest.raises(errors.BorderError):
        morphology.top_hat(f, m, nb.Skip())
    with pytest.raises(errors.PixelTypeError):
        morphology.erode(src.from_rows(spark, [(0, 1, 1, [(1, 2, 3)])], "Rgb8"), m, b)
    with pytest.raises(ValueError):
        morphology.median_filter(f, nb.Kernel.of([[False]]), b)


def test_templates(spark):
    ramp = mono(spark, [[x + 10 * y for x in range(10)] for y in range(10)])
    shown = template.Template(Size(3, 3), [x + 10 * y for y in range(3, 6) for x in range(2, 5)])
    sad, ssd, ncc = (grid(template.match_template(ramp, shown, m)) for m in (template.SAD(), template.SSD(), template.NCC()))
    assert len(sad) == 8 and sad[3][2] == 0 == ssd[3][2] and ssd[3][3] == 9 and sad[3][3] == 9
    assert abs(ncc[3][2] - 1) < 1e-6
    assert grid(template.match_template(mono(spark, [[5] * 3] * 3), shown, template.NCC())) == [[0.0]]
    with pytest.raises(errors.TemplateTooLarge):
        template.check_template(Size(2, 2), Size(3, 1))
    with pytest.raises(Exception, match="TemplateTooLarge"):
        template.match_template(mono(spark, [[1]]), shown, template.SAD()).df.collect()
    with pytest.raises(ValueError):
        template.Template(Size(0, 0), [])


def test_histograms(spark):
    f = src.from_rows(spark, [(0, 7, 1, [-0.5, 0.0, 0.25, 0.999, 1.0, 1.5, float("nan")])], "MonoF32")
    bins = histogram.LinearBins(0.0, 1.0, 4)
    assert {r.bin: r["count"] for r in histogram.histogram(f, bins).collect()} == {0: 1, 1: 1, 2: 0, 3: 2}
    o = histogram.outliers(f, bins).first()
    assert (o.nan_count, o.underflow_count, o.overflow_count, o.total_count) == (1, 1, 1, 7)
    custom = histogram.CustomBins.of([0, 0.25, 1])
    assert {r.bin: r["count"] for r in histogram.histogram(f, custom).collect()} == {0: 1, 1: 3} and custom.range(1) == (0.25, 1)
    assert bins.range(3) == (0.75, 1.0)
    hist = histogram.histogram(mono(spark, [[3, 3, 9]]), histogram.NaturalBins())
    assert histogram.count_for(hist, histogram.NaturalBins(), 3).first()["count"] == 2 == histogram.count_at_bin(hist, 3).first()["count"]
    assert {r.bin: r.cumulative for r in histogram.cumulative(hist).collect()}[8] == 2
    for bad in (lambda: histogram.LinearBins(1, 1, 3), lambda: histogram.LinearBins(0, 1, 0), lambda: histogram.LinearBins(0, math.inf, 2), lambda: histogram.CustomBins.of([1]), lambda: histogram.CustomBins.of([1, 1])):
        with pytest.raises(errors.InvalidBinningStrategy):
            bad()
    with pytest.raises(errors.PixelTypeError):
        histogram.histogram(f, histogram.NaturalBins())


def test_otsu_and_equalisation(spark):
    f = mono(spark, [[10] * 5 + [200] * 3], [[7, 7, 7, 7]], [])
    found = {r.image_id: r.threshold for r in histogram.otsu_thresholds(histogram.histogram(f, histogram.NaturalBins())).collect()}
    assert found == {0: 10, 1: None, 2: None}
    assert grid(histogram.otsu_binary_mask(f)) == [[False] * 5 + [True] * 3] and grid(histogram.otsu_binary_mask(f), 1) == [[True] * 4]
    even = histogram.equalize_image(mono(spark, [[0, 64, 128, 192]], [[9, 9]]))
    assert grid(even) == [[0, 85, 170, 255]] and grid(even, 1) == [[9, 9]]


def test_integral_images(spark):
    f = mono(spark, [[10] * 4] * 4, [])
    table = integral.integral_image(f, "Mono32")
    assert grid(table.frame)[0] == [0] * 5 and [r[0] for r in grid(table.frame)] == [0] * 5 and grid(table.frame)[4][4] == 160
    assert grid(table.frame, 1) == [[0]]
    sums = {r.image_id: r.v for r in table.region_sum(Rectangle.of(1, 1, 2, 3)).collect()}
    assert sums == {0: 60, 1: None}
    assert grid(integral.integral_squared_image(f, "Mono64").frame)[4][4] == 1600
    assert {r.image_id: (r.width, r.height) for r in table.source_sizes().collect()} == {0: (4, 4), 1: (0, 0)}
    with pytest.raises(errors.AccumulatorOverflow):
        integral.preflight(Size(5000, 5000), "Mono8", "Mono32")
    integral.preflight(Size(4096, 4096), "Mono8", "Mono64")
    with pytest.raises(errors.PixelTypeError):
        integral.integral_image(f, "Mono16")
    big = spark.createDataFrame([(0, 5000, 5000, [1])], "image_id bigint, width int, height int, v array<int>")
    with pytest.raises(Exception, match="AccumulatorOverflow"):
        integral.integral_image(type(f).of(big, "Mono8"), "Mono32").frame.df.collect()


def flood(mask, eight):
    """Labels by flooding, in raster order of first pixels."""
    h, w, out, n = len(mask), len(mask[0]), {}, 0
    near = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (eight or not (dx and dy))]
    for y in range(h):
        for x in range(w):
            if mask[y][x] and (x, y) not in out:
                n += 1
                todo = [(x, y)]
                while todo:
                    p = todo.pop()
                    if p in out or not (0 <= p[0] < w and 0 <= p[1] < h) or not mask[p[1]][p[0]]:
                        continue
                    out[p] = n
                    todo += [(p[0] + dx, p[1] + dy) for dx, dy in near]
    return out


def test_components(spark):
    rng = random.Random(8)
    shapes = [
        [[1, 0, 1], [1, 0, 1], [1, 1, 1]],
        [[int((x + y) % 2 == 0) for x in range(5)] for y in range(4)],
        [[int(rng.random() < 0.55) for _ in range(12)] for _ in range(11)],
        [[0, 0], [0, 0]],
        [[1 if y % 2 == 0 or x == (0 if y % 4 == 1 else 8) else 0 for x in range(9)] for y in range(13)],
    ]
    frame = mono(spark, *[[[bool(v) for v in r] for r in s] for s in shapes], pixel="Bool")
    for k, apart in itertools.product((components.CONNECTIVITY_4, components.CONNECTIVITY_8), (False, True)):
        labels = components.connected_components(frame, k, distributed=apart)
        got = {}
        for r in labels.pixels().collect():
            got.setdefault(r.image_id, {})[r.x, r.y] = r.label
        expected = {i: flood(s, k == components.CONNECTIVITY_8) for i, s in enumerate(shapes)}
        assert got == {i: e for i, e in expected.items() if e}
        assert {r.image_id: r.label_count for r in labels.counts().collect()} == {i: max(e.values(), default=0) for i, e in expected.items()}
        for r in labels.stats().collect():
            own = [p for p, n in expected[r.image_id].items() if n == r.label]
            assert (r.area, r.sum_x, r.sum_y, r.min_x, r.max_y) == (len(own), sum(x for x, _ in own), sum(y for _, y in own), min(x for x, _ in own), max(y for _, y in own))
    with pytest.raises(errors.LabelOverflow):
        components.connected_components(frame, 0, max_label=1, distributed=True)
    with pytest.raises(Exception, match="LabelOverflow"):
        components.connected_components(frame, 0, max_label=1).pixels().collect()
    with pytest.raises(errors.PixelTypeError):
        components.connected_components(mono(spark, [[1]]))


def test_tiles_with_halo_give_what_whole_images_give(spark):
    rng = random.Random(6)
    f = mono(spark, [[rng.randrange(256) for _ in range(23)] for _ in range(17)], [[rng.randrange(256) for _ in range(5)] for _ in range(4)])
    for border in (nb.ClampBorder(), nb.Mirror(), nb.Constant(3)):
        for op in (lambda g, b: filters.sharpen(g, b), lambda g, b: morphology.median_filter(g, nb.CROSS_5X5, b)):
            whole = sorted(map(tuple, op(f, border).pixels().collect()))
            assert sorted(map(tuple, tiled(f.pixels(), f.images(), "Mono8", Size(6, 5), 2, border, op).collect())) == whole
    with pytest.raises(errors.BorderError):
        tiled(f.pixels(), f.images(), "Mono8", Size(6, 5), 2, nb.Wrap(), lambda g, b: g)


def test_empty_and_single_images(spark):
    f = mono(spark, [], [[5]])
    for op in (geometry.flip_h, geometry.rotate_90, lambda g: filters.sharpen(g, nb.ClampBorder()), lambda g: morphology.closing(g, nb.FULL_RECT_3X3, nb.Mirror()), lambda g: convert_image(g, cv.Invert())):
        out = op(f)
        assert grid(out, 0) == [] and len(grid(out, 1)) == 1


def test_scalars(spark):
    m8, m64 = pixel_type("Mono8"), pixel_type("Mono64")
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(sc.saturating_add(lit(200), lit(100), m8)) == 255 and one(sc.saturating_sub(lit(1), lit(2), m8)) == 0
    assert one(sc.saturating_mul(lit(20), lit(20), m8)) == 255 and one(sc.saturating_div(lit(7), lit(2), m8)) == 3
    big = lit(str(2**64 - 1)).cast("decimal(20,0)")
    assert one(sc.saturating_add(big, big, m64)) == 2**64 - 1
    with pytest.raises(Exception, match="division by zero"):
        one(sc.saturating_div(lit(7), lit(0), m8))
    assert one(sc.times_float(lit(5), 0.5, m8)) == 3 and one(sc.times_float(lit(200), 2.0, m8)) == 255 and one(sc.times_float(lit(5), -1.0, m8)) == 0
    assert one(sc.scale_add(lit(4), 0.5, lit(1.0), m8)) == 3.0
    assert [one(m8.from_linear(lit(v))) for v in (2.5, -2.5, 254.5, 300.0, float("nan"))] == [3, 0, 255, 255, 0]
    rgb = pixel_type("Rgb8")
    p = sc.from_channels([lit(1), lit(2), lit(3)], rgb)
    assert one(sc.to_channels(sc.set_channel(p, 1, lit(9), rgb), rgb)) == [1, 9, 3] and one(sc.channel(p, 2, rgb)) == 3
    assert one(sc.from_label_index(lit(5))) == 5
    with pytest.raises(Exception, match="LabelOverflow"):
        one(sc.from_label_index(lit(2**32)))


def test_registry():
    names = {p.name for p in registered()}
    assert {"Mono8", "MonoA64", "RgbF32", "Bgra16", "Srgb8", "SrgbMonoA16", "Indexed8", "Label32", "Bool", "Rgb12", "Mono14"} <= names
    own = register(PixelType("HueSat8", "HueSat", pixel_type("Mono8").channel, ("h", "s")))
    assert pixel_type("HueSat8") is own and own.max == 255
    with pytest.raises(errors.PixelTypeError):
        register(PixelType("Mono8", "Other", own.channel, ("q",)))
    with pytest.raises(errors.PixelTypeError):
        pixel_type("Mono9")


def test_shapes():
    assert Size(3, 4).area == 12 and Size(2**40, 2**40).checked_area() is None
    r = Rectangle.of(1, 2, 3, 4)
    assert (r.left, r.top, r.right, r.bottom) == (1, 2, 4, 6) and r.inside(Size(4, 6)) and not r.inside(Size(3, 6))
    with pytest.raises(ValueError):
        Stride(0, 1)
    with pytest.raises(ValueError):
        Size(-1, 2)


def test_conversions_stream(spark, tmp_path):
    from rasterloom.streaming.convert import convert_stream, read_pixels

    f = mono(spark, [[1, 2], [3, 250]])
    f.pixels().write.parquet(str(tmp_path / "in"))
    stream = read_pixels(spark, str(tmp_path / "in"), f.pixels().schema)
    query = convert_stream(stream, "Mono8", cv.Invert()).writeStream.format("memory").queryName("inverted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.v for r in spark.sql("select v from inverted").collect()) == [5, 252, 253, 254]
    with pytest.raises(ValueError):
        convert_stream(f.pixels(), "Mono8", cv.Invert())
