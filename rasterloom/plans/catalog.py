"""All registered raster queries with their SQL equivalents.

Every query reads a table, makes a raster of it, and applies one operator. The SQL builds the same raster and states
the operator's meaning in relational terms: joins on coordinates for neighbourhoods, group-bys for counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.frame import ImageFrame
from rasterloom.functions import conversions as cv
from rasterloom.operators import combine, components, filters, geometry, histogram, integral, morphology, planes, regions, template
from rasterloom.operators import neighborhood as nb
from rasterloom.operators.convert import convert_image, convert_pixels
from rasterloom.pixel import pixel_type
from rasterloom.plans import rasters as rs
from rasterloom.plans.registry import ORACLES, QUERIES  # noqa: F401
from rasterloom.plans.registry import add as _add
from rasterloom.plans.rasters import EMB8, EMB8RGB, EMB16, EMBF, EV_HEAT, LI_GRID
from rasterloom.shapes import Rectangle, Size, Stride

def _rounded(frame: ImageFrame, digits: int = 4) -> DataFrame:
    """Pixel rows with float channels as rounded doubles."""
    rows = frame.pixels()
    return rows.select("image_id", "x", "y", *(F.round(F.col(c).cast("double"), digits).alias(c) for c in frame.pixel.channels))


# Projections


def _project(name: str, source, strategy: cv.Strategy, dst: str | None, ctes: str, columns: str, after=None) -> None:
    """A conversion over pixel rows, so that it is one code-generated projection."""

    def query(spark, sf_dir):
        frame = source(spark, sf_dir)
        b = strategy.target(frame.pixel, pixel_type(dst) if dst else None)
        rows = convert_pixels(frame.pixels(), frame.pixel, strategy, b)
        return rows.select("image_id", "x", "y", *(after(F.col(c)).alias(c) if after else F.col(c) for c in b.channels))

    table = {EMB8: "emb8", EMB16: "emb16", EMBF: "embf", EMB8RGB: "emb8rgb"}[ctes]
    _add(name, query, f"WITH {ctes} SELECT image_id, x, y, {columns} FROM {table}")


_r6 = lambda c: F.round(c.cast("double"), 6)
_project("fullrange_u8_u16", rs.emb8, cv.FullRange(), "Mono16", EMB8, "(v * 257)::INT AS v")
_project("fullrange_u8_u32", rs.emb8, cv.FullRange(), "Mono32", EMB8, "v::BIGINT * 16843009 AS v")
_project("fullrange_u8_u64", rs.emb8, cv.FullRange(), "Mono64", EMB8, "(v::HUGEINT * 72340172838076673)::DECIMAL(20,0) AS v")
_project("fullrange_u16_u8", rs.emb16, cv.FullRange(), "Mono8", EMB16, "((v + 128) // 257)::INT AS v")
_project("fullrange_u16_u64_u8", rs.emb16, cv.FullRange().then(cv.FullRange(), "Mono64"), "Mono8", EMB16, "((v + 128) // 257)::INT AS v")
_project("fullrange_u8_f32", rs.emb8, cv.FullRange(), "MonoF32", EMB8, "round((v::FLOAT / 255::FLOAT)::DOUBLE, 6) AS v", _r6)
_project("fullrange_u16_f64", rs.emb16, cv.FullRange(), "MonoF64", EMB16, "round(v / 65535.0::DOUBLE, 6) AS v", _r6)
_project("fullrange_f32_u8", rs.embf, cv.FullRange(), "Mono8", EMBF, "floor(greatest(0::FLOAT, least(1::FLOAT, v)) * 255::FLOAT + 0.5::FLOAT)::INT AS v")
_project("fullrange_f32_u16", rs.embf, cv.FullRange(), "Mono16", EMBF, "floor(greatest(0::FLOAT, least(1::FLOAT, v)) * 65535::FLOAT + 0.5::FLOAT)::INT AS v")
_project("fullrange_f32_f64", rs.embf, cv.FullRange(), "MonoF64", EMBF, "round(v::DOUBLE, 6) AS v", _r6)
_project("narrow_u16_u8", rs.emb16, cv.Narrow(), "Mono8", EMB16, "least(v, 255)::INT AS v")
_project("narrow_u8_u16", rs.emb8, cv.Narrow(), "Mono16", EMB8, "v::INT AS v")
_project("narrow_u16_mono10", rs.emb16, cv.Narrow(), "Mono10", EMB16, "least(v, 1023)::INT AS v")
_project("fullrange_mono10_u8", rs.emb16, cv.Narrow().then(cv.FullRange(), "Mono10"), "Mono8", EMB16, "((least(v, 1023) * 255 + 511) // 1023)::INT AS v")
_project("luminance_rgb8", rs.emb8rgb, cv.Luminance(), None, EMB8RGB, "((77 * r + 150 * g + 29 * b + 128) >> 8)::INT AS v")
_project("luminance_f32", rs.emb8rgb, cv.FullRange().then(cv.Luminance(), "RgbF32"), "MonoF32", EMB8RGB, "round(((0.299::FLOAT * (r::FLOAT / 255::FLOAT)::FLOAT + 0.587::FLOAT * (g::FLOAT / 255::FLOAT)::FLOAT) + 0.114::FLOAT * (b::FLOAT / 255::FLOAT)::FLOAT)::DOUBLE, 4) AS v", lambda c: F.round(c.cast("double"), 4))
_project("broadcast_mono8", rs.emb8, cv.Broadcast(), "Rgba8", EMB8, "v AS r, v AS g, v AS b, 255 AS a")
_project("color_swap", rs.emb8rgb, cv.ColorSwap(), None, EMB8RGB, "b, g, r")
_project("add_alpha", rs.emb8rgb, cv.AddAlpha(), None, EMB8RGB, "r, g, b, 255 AS a")
_SRGB_DECODE = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_project("srgb_decode", lambda s, d: rs.emb8rgb(s, d, "Srgb8"), cv.SrgbGamma(), None, EMB8RGB, ", ".join(f"round(({_SRGB_DECODE.format(c)})::FLOAT::DOUBLE, 6) AS {c}" for c in "rgb"), _r6)
_project("srgb_roundtrip", lambda s, d: rs.emb8rgb(s, d, "Srgb8"), cv.SrgbGamma().then(cv.SrgbGamma(), "RgbF32"), "Srgb8", EMB8RGB, "r, g, b")
_project("threshold_binary", rs.emb8, cv.BinaryThreshold(128), None, EMB8, "CASE WHEN v > 128 THEN 255 ELSE 0 END AS v")
_project("threshold_binary_inv", rs.emb8, cv.BinaryThresholdInv(128), None, EMB8, "CASE WHEN v > 128 THEN 0 ELSE 255 END AS v")
_project("threshold_truncate", rs.emb8, cv.TruncateThreshold(140), None, EMB8, "least(v, 140) AS v")
_project("threshold_to_zero", rs.emb8, cv.ToZeroThreshold(128), None, EMB8, "CASE WHEN v > 128 THEN v ELSE 0 END AS v")
_project("threshold_to_zero_inv", rs.emb8, cv.ToZeroThresholdInv(128), None, EMB8, "CASE WHEN v > 128 THEN 0 ELSE v END AS v")
_project("binary_mask", rs.emb8rgb, cv.BinaryMask((120, 110, 100)), None, EMB8RGB, "(r > 120 AND g > 110 AND b > 100) AS v")
_project("invert", rs.emb8rgb, cv.Invert(), None, EMB8RGB, "255 - r AS r, 255 - g AS g, 255 - b AS b")
_project("clamp", rs.emb8, cv.Clamp(100, 150), None, EMB8, "least(150, greatest(100, v)) AS v")
_project("brightness_contrast", rs.emb8, cv.BrightnessContrast(-40.0, 1.5), None, EMB8, "least(255, greatest(0, round(v * 1.5::DOUBLE - 40)))::INT AS v")
_project("lut", rs.emb8, cv.Lut.from_fn(lambda i: (i, 255 - i, i // 2), "Rgb8"), None, EMB8, "v AS r, 255 - v AS g, (v // 2)::INT AS b")
_project("channel_lut", rs.emb8rgb, cv.ChannelLut.from_fn(lambda i: (i * i) // 255), None, EMB8RGB, "((r * r) // 255)::INT AS r, ((g * g) // 255)::INT AS g, ((b * b) // 255)::INT AS b")
_project("depalettize", lambda s, d: rs.emb8(s, d).retyped("Indexed8"), cv.Depalettize.of([(i, 2 * i, 200 - i) for i in range(128)], "Rgb8"), None, EMB8, "CASE WHEN v < 128 THEN v ELSE 0 END AS r, CASE WHEN v < 128 THEN 2 * v ELSE 0 END AS g, CASE WHEN v < 128 THEN 200 - v ELSE 0 END AS b")
_project("pixel_map", rs.emb8rgb, cv.PixelMap.of(lambda p: {"v": F.greatest(p["r"], p["g"], p["b"])}, "Mono8"), None, EMB8RGB, "greatest(r, g, b) AS v")
_project("then_invert_threshold", rs.emb8, cv.Invert().then(cv.BinaryThreshold(120)), None, EMB8, "CASE WHEN 255 - v > 120 THEN 255 ELSE 0 END AS v")

# Two images

_PAIR = f"WITH {EMB8}, pair AS (SELECT p.image_id, p.x, p.y, p.v AS a, q.v AS b FROM emb8 p JOIN emb8 q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y)"


def _pair(name: str, combiner: combine.Combiner, sql: str, digits: int | None = None) -> None:
    def query(spark, sf_dir):
        frame = rs.emb8(spark, sf_dir)
        out = combine.combine_images(frame, rs.next_image(frame), combiner)
        return _rounded(out, digits) if digits else out

    _add(name, query, f"{_PAIR} SELECT image_id, x, y, {sql} AS v FROM pair")


_pair("combine_add", combine.PixelAdd(), "least(255, a + b)")
_pair("combine_sub", combine.PixelSubtract(), "greatest(0, a - b)")
_pair("combine_mul", combine.PixelMultiply(), "least(255, a * b)")
_pair("combine_absdiff", combine.AbsDiff(), "abs(a - b)")
_pair("combine_min", combine.Min(), "least(a, b)")
_pair("combine_max", combine.Max(), "greatest(a, b)")
_pair("combine_linear", combine.LinearCombine(0.25, -0.5), "round(a * 0.25::DOUBLE - b * 0.5::DOUBLE, 4)", 4)
_pair("combine_blend", combine.Blend(0.25), "round(b * 0.25::DOUBLE + a * 0.75::DOUBLE, 4)", 4)
_pair("combine_closure", combine.ClosureCombine(lambda a, b: F.floor((a + b) / 2), pixel_type("Mono8")), "((a + b) // 2)::INT")


def _magnitude(spark, sf_dir):
    frame = rs.emb8(spark, sf_dir)
    return _rounded(combine.combine_images(filters.sobel_x(frame, nb.ClampBorder()), filters.sobel_y(frame, nb.ClampBorder()), combine.Magnitude()), 3)


def _image_equality(spark, sf_dir):
    frame = rs.emb8(spark, sf_dir)
    return frame.equals(geometry.flip_h(geometry.flip_h(frame)))


_add("image_equality", _image_equality, "SELECT vec_id AS image_id, true AS equal FROM embeddings WHERE len(embedding) = 64")

# Regions and planes

_add("roi", lambda s, d: regions.roi(rs.emb8(s, d), Rectangle.of(2, 1, 4, 5)), f"WITH {EMB8} SELECT image_id, x - 2 AS x, y - 1 AS y, v FROM emb8 WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5")
_add("pixel_at", lambda s, d: rs.emb8(s, d).pixel_at(3, 5), f"WITH {EMB8} SELECT image_id, v FROM emb8 WHERE x = 3 AND y = 5")
_add("row", lambda s, d: rs.emb8(s, d).row(6).select("image_id", F.posexplode("v").alias("x", "v")), f"WITH {EMB8} SELECT image_id, x, v FROM emb8 WHERE y = 6")


def _tile_means(spark, sf_dir):
    cut = regions.tiles(rs.li_grid(spark, sf_dir), Size(24, 20))
    return cut.select("image_id", "col", "row", "width", "height", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


_add("tiles_sum", _tile_means, f"WITH {LI_GRID} SELECT image_id, (x // 24)::INT AS col, (y // 20)::INT AS row, count(DISTINCT x)::INT AS width, count(DISTINCT y)::INT AS height, sum(v)::BIGINT AS total FROM li_grid GROUP BY 1, 2, 3")


def _window_sums(spark, sf_dir):
    cut = regions.sliding_windows(rs.emb8(spark, sf_dir), Size(3, 4), Stride(2, 1))
    return cut.select("image_id", "number", "col", "row", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


_add("sliding_windows_sum", _window_sums, f"WITH {EMB8} SELECT image_id, (row * 3 + col)::INT AS number, col::INT AS col, row::INT AS row, sum(v)::BIGINT AS total FROM emb8, range(3) c(col), range(5) r(row) WHERE x >= col * 2 AND x < col * 2 + 3 AND y >= row AND y < row + 4 GROUP BY 1, 2, 3, 4")
_add("planes_long", lambda s, d: planes.long_form(rs.emb8rgb(s, d)), f"WITH {EMB8RGB} SELECT image_id, x, y, unnest([0, 1, 2]) AS channel, unnest([r, g, b]) AS v FROM emb8rgb")


def _plane_swap(spark, sf_dir):
    parts = planes.planes(rs.emb8rgb(spark, sf_dir))
    return planes.from_planes([parts[2], parts[1], parts[0]], "Rgb8")


_add("planes_rebuilt", _plane_swap, f"WITH {EMB8RGB} SELECT image_id, x, y, b AS r, g, r AS b FROM emb8rgb")

# Geometry

for _name, _op, _x, _y in [
    ("flip_h", geometry.flip_h, "7 - x", "y"),
    ("flip_v", geometry.flip_v, "x", "7 - y"),
    ("rotate_180", geometry.rotate_180, "7 - x", "7 - y"),
]:
    _add(_name, lambda s, d, op=_op: op(rs.emb8(s, d)), f"WITH {EMB8} SELECT image_id, {_x} AS x, {_y} AS y, v FROM emb8")
for _name, _op, _x, _y in [
    ("rotate_90", geometry.rotate_90, "y", "23 - x"),
    ("rotate_270", geometry.rotate_270, "29 - y", "x"),
    ("transpose", geometry.transpose, "y", "x"),
]:
    _add(_name, lambda s, d, op=_op: op(rs.ev_heat(s, d)), f"WITH {EV_HEAT} SELECT image_id, {_x} AS x, {_y} AS y, v FROM ev_heat")


def _resized(name: str, w: int, h: int, method: geometry.ResizeMethod) -> None:
    sx, sy = f"(23::FLOAT / {w - 1}::FLOAT)::FLOAT", f"(29::FLOAT / {h - 1}::FLOAT)::FLOAT"
    grid = f"WITH {EV_HEAT}, g AS (SELECT (k % {w})::INT AS x, (k // {w})::INT AS y, ((k % {w})::FLOAT * {sx})::FLOAT AS fx, ((k // {w})::FLOAT * {sy})::FLOAT AS fy FROM range({w * h}) r(k))"
    if isinstance(method, geometry.NearestNeighbor):
        sql = f"{grid} SELECT image_id, g.x, g.y, v FROM ev_heat p JOIN g ON p.x = floor(fx)::INT AND p.y = floor(fy)::INT"
    else:
        at = lambda t, dx, dy: f"JOIN ev_heat {t} ON {t}.image_id = i.image_id AND {t}.x = least(floor(fx)::INT + {dx}, 23) AND {t}.y = least(floor(fy)::INT + {dy}, 29)"
        mix = lambda a, b, t: f"(({b})::FLOAT * ({t})::FLOAT + ({a})::FLOAT * (1::FLOAT - ({t})::FLOAT))"
        dx, dy = "(fx - floor(fx))", "(fy - floor(fy))"
        value = mix(mix("a.v", "b.v", dx), mix("c.v", "e.v", dx), dy)
        sql = f"{grid} SELECT i.image_id, g.x, g.y, least(65535, greatest(0, round(({value})::DOUBLE)))::INT AS v FROM (SELECT DISTINCT image_id FROM ev_heat) i CROSS JOIN g {at('a', 0, 0)} {at('b', 1, 0)} {at('c', 0, 1)} {at('e', 1, 1)}"
    _add(name, lambda s, d: geometry.resize(rs.ev_heat(s, d), w, h, method), sql)


_resized("resize_nearest", 37, 11, geometry.NearestNeighbor())
_resized("resize_bilinear", 37, 47, geometry.Bilinear())

# Neighbourhoods


def _place(at: str, n: int, border: nb.Border) -> str:
    if isinstance(border, nb.ClampBorder):
        return f"least(greatest({at}, 0), {n - 1})"
    if isinstance(border, nb.Wrap):
        return f"((({at}) % {n}) + {n}) % {n}"
    if isinstance(border, nb.Mirror):
        m = f"((({at}) % {2 * n - 2}) + {2 * n - 2}) % {2 * n - 2}"
        return f"least({m}, {2 * n - 2} - {m})"
    return at


def _taps(kernel: nb.Kernel, border: nb.Border, ctes: str = EMB8, source: str = "emb8", w: int = 8, h: int = 8) -> str:
    """CTE t: image_id, x, y (of the output), c (the centre's sample), k (weight), v (sample), one row a tap."""
    cells = ", ".join(f"({i}, {dx}, {dy}, {float(wt)}::DOUBLE)" for i, (dx, dy, wt) in enumerate(kernel.positions()))
    sample = f"coalesce(q.v, {border.value})" if isinstance(border, nb.Constant) else "q.v"
    join = "JOIN" if not isinstance(border, nb.Constant) else "LEFT JOIN"
    ax, ay = kernel.anchor
    inside = "" if border.full else f" WHERE p.x >= {ax} AND p.x < {w - kernel.width + 1 + ax} AND p.y >= {ay} AND p.y < {h - kernel.height + 1 + ay}"
    shift = ("p.x", "p.y") if border.full else (f"p.x - {ax}", f"p.y - {ay}")
    return f"""WITH {ctes}, k(o, dx, dy, k) AS (VALUES {cells}), t AS (SELECT p.image_id, {shift[0]} AS x, {shift[1]} AS y, p.v AS c, k.k, {sample} AS v FROM {source} p CROSS JOIN k
        {join} {source} q ON q.image_id = p.image_id AND q.x = {_place("p.x + dx", w, border)} AND q.y = {_place("p.y + dy", h, border)}{inside})"""


def _filter(name: str, run: Callable[[ImageFrame], ImageFrame], kernel: nb.Kernel, border: nb.Border, value: str = "round(sum(k * v), 4)", rounded: bool = True) -> None:
    def query(spark, sf_dir):
        out = run(rs.emb8(spark, sf_dir))
        return _rounded(out) if rounded else out

    _add(name, query, f"{_taps(kernel, border)} SELECT image_id, x, y, {value} AS v FROM t GROUP BY image_id, x, y")


_ODD = nb.Kernel.of([[1, 2, 0], [0, -3, 1], [2, 0, 5]], (2, 0))
_SATURATED = "least(255, greatest(0, round(sum(k * v))))::INT"
for _name, _border in [("skip", nb.Skip()), ("clamp", nb.ClampBorder()), ("mirror", nb.Mirror()), ("wrap", nb.Wrap()), ("constant", nb.Constant(7))]:
    _filter(f"convolve_{_name}", lambda f, b=_border: filters.convolve(f, _ODD, b), _ODD.flipped(), _border)
_filter("correlate_emboss", lambda f: filters.correlate(f, nb.EMBOSS, nb.Mirror()), nb.EMBOSS, nb.Mirror())
_filter("correlate_to_mono8", lambda f: filters.correlate(f, nb.SHARPEN, nb.Wrap(), "Mono8"), nb.SHARPEN, nb.Wrap(), _SATURATED, False)
_filter("box_blur_3", lambda f: filters.box_blur_3x3(f, nb.ClampBorder()), nb._full(3, 3, 1), nb.ClampBorder(), "round(sum(v) / 9.0::DOUBLE)::INT", False)
_filter("box_blur_5", lambda f: filters.box_blur_5x5(f, nb.Mirror()), nb._full(5, 5, 1), nb.Mirror(), "round(sum(v) / 25.0::DOUBLE)::INT", False)
_filter("gaussian_3", lambda f: filters.gaussian_blur_3x3(f, nb.ClampBorder(), "MonoF32"), nb.GAUSSIAN_3X3, nb.ClampBorder())
_filter("gaussian_5", lambda f: filters.gaussian_blur_5x5(f, nb.ClampBorder(), "Mono16"), nb.GAUSSIAN_5X5, nb.ClampBorder(), "least(65535, sum(k * v))::INT", False)
_filter("gaussian_3_saturated", lambda f: filters.gaussian_blur_3x3(f, nb.Skip()), nb.GAUSSIAN_3X3, nb.Skip(), _SATURATED, False)
_filter("sobel_x", lambda f: filters.sobel_x(f, nb.ClampBorder()), nb.SOBEL_Y.flipped(), nb.ClampBorder())
_filter("sobel_y", lambda f: filters.sobel_y(f, nb.ClampBorder()), nb.SOBEL_X.flipped(), nb.ClampBorder())
_filter("scharr_x", lambda f: filters.scharr_x(f, nb.Mirror()), nb.SCHARR_Y.flipped(), nb.Mirror())
_filter("scharr_y", lambda f: filters.scharr_y(f, nb.Wrap()), nb.SCHARR_X.flipped(), nb.Wrap())
_filter("prewitt_x", lambda f: filters.prewitt_x(f, nb.Skip()), nb.PREWITT_Y.flipped(), nb.Skip())
_filter("prewitt_y", lambda f: filters.prewitt_y(f, nb.Constant(0)), nb.PREWITT_X.flipped(), nb.Constant(0))
_filter("laplacian", lambda f: filters.laplacian(f, nb.ClampBorder()), nb.LAPLACIAN, nb.ClampBorder())
_filter("laplacian_8", lambda f: filters.laplacian_8(f, nb.ClampBorder()), nb.LAPLACIAN_8, nb.ClampBorder())
_filter("sharpen", lambda f: filters.sharpen(f, nb.ClampBorder()), nb.SHARPEN, nb.ClampBorder(), _SATURATED, False)
_filter("emboss", lambda f: filters.emboss(f, nb.ClampBorder()), nb.EMBOSS.flipped(), nb.ClampBorder())


def _spread(frame):
    return nb.fold_neighborhood(frame, nb.FULL_RECT_3X3, nb.ClampBorder(), lambda taps: F.greatest(*(s for *_, s in taps)) - F.least(*(s for *_, s in taps)), "Mono8")


_filter("fold_closure", _spread, nb.FULL_RECT_3X3, nb.ClampBorder(), "max(v) - min(v)", False)
_filter("map_closure", lambda f: nb.map_neighborhood(f, nb.CROSS_3X3, nb.Wrap(), lambda c, taps: sum(((s > c).cast("int") for *_, s in taps), F.lit(0))), nb.CROSS_3X3, nb.Wrap(), "(sum(CASE WHEN k > 0 AND v > c THEN 1 ELSE 0 END))::INT", False)
_SX, _SY = f"{_taps(nb.SOBEL_Y.flipped(), nb.ClampBorder())}", nb.SOBEL_X.flipped()
_add("combine_magnitude", _magnitude, _SX + f", k2(dx, dy, k) AS (VALUES {', '.join(f'({dx}, {dy}, {float(w)}::DOUBLE)' for dx, dy, w in _SY.positions())}), gx AS (SELECT image_id, x, y, sum(k * v) AS g FROM t GROUP BY 1, 2, 3), gy AS (SELECT p.image_id, p.x, p.y, sum(k2.k * q.v) AS g FROM emb8 p CROSS JOIN k2 JOIN emb8 q ON q.image_id = p.image_id AND q.x = least(greatest(p.x + dx, 0), 7) AND q.y = least(greatest(p.y + dy, 0), 7) GROUP BY 1, 2, 3) SELECT image_id, x, y, round(sqrt(gx.g * gx.g + gy.g * gy.g)::FLOAT::DOUBLE, 3) AS v FROM gx JOIN gy USING (image_id, x, y)")

# Morphology

_ACTIVE = "FILTER (k > 0)"
for _mask_name, _mask in [("rect", nb.FULL_RECT_3X3), ("cross", nb.CROSS_5X5)]:
    _filter(f"erode_{_mask_name}", lambda f, m=_mask: morphology.erode(f, m, nb.ClampBorder()), _mask, nb.ClampBorder(), f"least(min(v) {_ACTIVE}, any_value(c))", False)
    _filter(f"dilate_{_mask_name}", lambda f, m=_mask: morphology.dilate(f, m, nb.Mirror()), _mask, nb.Mirror(), f"greatest(max(v) {_ACTIVE}, any_value(c))", False)
_filter("median", lambda f: morphology.median_filter(f, nb.FULL_RECT_3X3, nb.ClampBorder()), nb.FULL_RECT_3X3, nb.ClampBorder(), "list_sort(list(v))[5]", False)
_filter("median_even", lambda f: morphology.median_filter(f, nb.Kernel.of([[1, 1], [1, 1]]), nb.Wrap()), nb.Kernel.of([[1, 1], [1, 1]]), nb.Wrap(), "list_sort(list(v))[3]", False)


def _two_steps(first: str, second: str, tail: str) -> str:
    """Two 3 x 3 passes with a clamped border, as range joins."""
    step = lambda name, source, agg: f"{name} AS (SELECT p.image_id, p.x, p.y, {agg}(q.v) AS v FROM {source} p JOIN {source} q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3)"
    return f"WITH {EMB8}, {step('s1', 'emb8', first)}, {step('s2', 's1', second)} {tail}"


def _shape(name: str, op, sql: str) -> None:
    _add(name, lambda s, d: op(rs.emb8(s, d), nb.FULL_RECT_3X3, nb.ClampBorder()), sql)


_shape("opening", morphology.opening, _two_steps("min", "max", "SELECT image_id, x, y, v FROM s2"))
_shape("closing", morphology.closing, _two_steps("max", "min", "SELECT image_id, x, y, v FROM s2"))
_shape("top_hat", morphology.top_hat, _two_steps("min", "max", "SELECT image_id, x, y, greatest(0, emb8.v - s2.v) AS v FROM s2 JOIN emb8 USING (image_id, x, y)"))
_shape("black_hat", morphology.black_hat, _two_steps("max", "min", "SELECT image_id, x, y, greatest(0, s2.v - emb8.v) AS v FROM s2 JOIN emb8 USING (image_id, x, y)"))
_filter("morph_gradient", lambda f: morphology.morphological_gradient(f, nb.FULL_RECT_3X3, nb.Skip()), nb.FULL_RECT_3X3, nb.Skip(), "max(v) - min(v)", False)

# Histograms


def _bins(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", "channel", "bin", F.col("count").cast("bigint").alias("n"))


_LONG = f"WITH {EMB8RGB}, s AS (SELECT image_id, unnest([0, 1, 2]) AS channel, unnest([r, g, b]) AS v FROM emb8rgb)"
_add("hist_natural", lambda s, d: _bins(histogram.histogram(rs.emb8rgb(s, d), histogram.NaturalBins())), f"{_LONG}, c AS (SELECT image_id, channel, v AS bin, count(*) AS n FROM s GROUP BY 1, 2, 3) SELECT i.image_id, ch::INT AS channel, b::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT image_id FROM s) i CROSS JOIN range(3) a(ch) CROSS JOIN range(256) e(b) LEFT JOIN c ON c.image_id = i.image_id AND c.channel = ch AND c.bin = b")
_LINEAR = histogram.LinearBins(-0.25, 0.25, 10)
_LINEAR_SQL = "CASE WHEN v::DOUBLE < -0.25 THEN -2 WHEN v::DOUBLE > 0.25 THEN -3 ELSE least(floor((v::DOUBLE + 0.25) / 0.5 * 10), 9)::INT END"
_add("hist_linear", lambda s, d: _bins(histogram.histogram(rs.embf(s, d), _LINEAR)), f"WITH {EMBF}, c AS (SELECT image_id, {_LINEAR_SQL} AS bin, count(*) AS n FROM embf GROUP BY 1, 2) SELECT i.image_id, 0 AS channel, b::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT image_id FROM embf) i CROSS JOIN range(10) e(b) LEFT JOIN c ON c.image_id = i.image_id AND c.bin = b")
_add("hist_outliers", lambda s, d: histogram.outliers(rs.embf(s, d), _LINEAR), f"WITH {EMBF} SELECT image_id, 0 AS channel, 0::BIGINT AS nan_count, (count(*) FILTER (v::DOUBLE < -0.25))::BIGINT AS underflow_count, (count(*) FILTER (v::DOUBLE > 0.25))::BIGINT AS overflow_count, count(*) AS total_count FROM embf GROUP BY 1")
_EDGES = (0, 90, 120, 128, 150, 255)
_add("hist_custom", lambda s, d: _bins(histogram.histogram(rs.emb8(s, d), histogram.CustomBins.of(_EDGES))), f"WITH {EMB8}, c AS (SELECT image_id, CASE {' '.join(f'WHEN v < {e} THEN {k}' for k, e in enumerate(_EDGES[1:-1]))} ELSE 4 END AS bin, count(*) AS n FROM emb8 GROUP BY 1, 2) SELECT i.image_id, 0 AS channel, b::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT image_id FROM emb8) i CROSS JOIN range(5) e(b) LEFT JOIN c ON c.image_id = i.image_id AND c.bin = b")
_add("hist_cumulative", lambda s, d: histogram.cumulative(histogram.histogram(rs.emb8(s, d), histogram.NaturalBins())).select("image_id", "bin", F.col("cumulative").cast("bigint").alias("cumulative")), f"WITH {EMB8} SELECT i.image_id, b::INT AS bin, (SELECT count(*) FROM emb8 p WHERE p.image_id = i.image_id AND p.v <= b)::BIGINT AS cumulative FROM (SELECT DISTINCT image_id FROM emb8) i CROSS JOIN range(256) e(b)")
_OTSU = """, h AS (SELECT image_id, v AS bin, count(*)::DOUBLE AS n FROM {src} GROUP BY 1, 2),
tot AS (SELECT image_id, sum(n) AS n, sum(n * bin) AS s FROM h GROUP BY 1),
cand AS (SELECT tot.image_id, b, (SELECT sum(h.n) FROM h WHERE h.image_id = tot.image_id AND bin <= b) AS w0, (SELECT sum(h.n * bin) FROM h WHERE h.image_id = tot.image_id AND bin <= b) AS s0, tot.n, tot.s FROM tot CROSS JOIN range(256) e(b)),
scored AS (SELECT image_id, b, w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) * (s0 / w0 - (s - s0) / (n - w0)) AS var FROM cand WHERE w0 > 0 AND n > w0),
otsu AS (SELECT image_id, b::INT AS threshold FROM scored QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY var DESC, b) = 1)"""
_EMB_OTSU = f"WITH {EMB8}{_OTSU.format(src='emb8')}"
_add("otsu", lambda s, d: histogram.otsu_thresholds(histogram.histogram(rs.emb8(s, d), histogram.NaturalBins())).select("image_id", "threshold"), f"{_EMB_OTSU} SELECT i.image_id, threshold FROM (SELECT DISTINCT image_id FROM emb8) i LEFT JOIN otsu USING (image_id)")
_add("otsu_mask", lambda s, d: histogram.otsu_binary_mask(rs.emb8(s, d)), f"{_EMB_OTSU} SELECT image_id, x, y, v > coalesce(threshold, 0) AS v FROM emb8 LEFT JOIN otsu USING (image_id)")
_CDF = """, h AS (SELECT image_id, v, count(*) AS n FROM {src} GROUP BY 1, 2), cdf AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS c, sum(n) OVER (PARTITION BY image_id) AS n FROM h), low AS (SELECT image_id, min(c) AS m FROM cdf GROUP BY 1)"""
_add("equalize", lambda s, d: histogram.equalize_image(rs.emb8(s, d)), f"WITH {EMB8}{_CDF.format(src='emb8')} SELECT image_id, x, y, (CASE WHEN n <= m THEN v ELSE least(255, round((c - m)::DOUBLE * 255.0 / (n - m)::DOUBLE)) END)::INT AS v FROM emb8 JOIN cdf USING (image_id, v) JOIN low USING (image_id)")

# Integral images


def _integral(spark, sf_dir, squared):
    build = integral.integral_squared_image if squared else integral.integral_image
    return build(rs.ev_heat(spark, sf_dir), "MonoF64" if squared else "Mono64")


_TABLE = "SELECT i.image_id, gx::INT AS x, gy::INT AS y, (SELECT coalesce(sum({v}), 0) FROM ev_heat p WHERE p.image_id = i.image_id AND p.x < gx AND p.y < gy)::{kind} AS v FROM (SELECT DISTINCT image_id FROM ev_heat) i CROSS JOIN range(25) a(gx) CROSS JOIN range(31) b(gy)"
_add("integral", lambda s, d: _integral(s, d, False).frame, f"WITH {EV_HEAT} {_TABLE.format(v='v', kind='DECIMAL(20,0)')}")
_add("integral_sq", lambda s, d: _integral(s, d, True).frame, f"WITH {EV_HEAT} {_TABLE.format(v='v::BIGINT * v', kind='DOUBLE')}")
_add("region_sum", lambda s, d: _integral(s, d, False).region_sum(Rectangle.of(3, 4, 11, 20)), f"WITH {EV_HEAT} SELECT image_id, sum(v)::DECIMAL(20,0) AS v FROM ev_heat WHERE x >= 3 AND x < 14 AND y >= 4 AND y < 24 GROUP BY 1")

# Template matching

_TEMPLATE = [[120, 130, 140], [100, 128, 90], [150, 160, 128]]


def _matched(name: str, method: template.MatchMethod, value: str, digits: int) -> None:
    shown = template.Template(Size(3, 3), [v for r in _TEMPLATE for v in r])
    cells = ", ".join(f"({x}, {y}, {v}::DOUBLE)" for y, r in enumerate(_TEMPLATE) for x, v in enumerate(r))
    sql = f"""WITH {EMB8}, tpl(tx, ty, t) AS (VALUES {cells}), m AS (SELECT p.image_id, p.x, p.y, q.v::DOUBLE AS i, t FROM emb8 p CROSS JOIN tpl JOIN emb8 q ON q.image_id = p.image_id AND q.x = p.x + tx AND q.y = p.y + ty WHERE p.x <= 5 AND p.y <= 5)
        SELECT image_id, x, y, round(({value})::FLOAT::DOUBLE, {digits}) AS v FROM m GROUP BY image_id, x, y"""
    _add(name, lambda s, d: _rounded(template.match_template(rs.emb8(s, d), shown, method), digits), sql)


_matched("match_sad", template.SAD(), "sum(abs(i - t))", 2)
_matched("match_ssd", template.SSD(), "sum((i - t) * (i - t))", 1)
_VAR = "(sum(i * i) / 9 - (sum(i) / 9) * (sum(i) / 9)) * (sum(t * t) / 9 - (sum(t) / 9) * (sum(t) / 9))"
_matched("match_ncc", template.NCC(), f"CASE WHEN {_VAR} < 1e-24 THEN 0 ELSE (sum(i * t) / 9 - (sum(i) / 9) * (sum(t) / 9)) / sqrt({_VAR}) END", 4)

# Components


def _bright(spark, sf_dir) -> ImageFrame:
    return convert_image(rs.emb8(spark, sf_dir), cv.BinaryMask(128))


def _labels_sql(tail: str, near: str) -> str:
    return f"""WITH RECURSIVE {EMB8}, fg AS MATERIALIZED (SELECT image_id, x, y, (y * 8 + x)::BIGINT AS id FROM emb8 WHERE v > 128),
    adj AS MATERIALIZED (SELECT p.image_id, p.id AS a, q.id AS b FROM fg p JOIN fg q ON q.image_id = p.image_id AND {near}),
    reach AS (SELECT image_id, id, id AS low FROM fg UNION SELECT reach.image_id, adj.b, reach.low FROM reach JOIN adj ON adj.image_id = reach.image_id AND adj.a = reach.id WHERE reach.low < adj.b),
    root AS (SELECT image_id, id, min(low) AS low FROM reach GROUP BY 1, 2),
    lab AS (SELECT image_id, id, dense_rank() OVER (PARTITION BY image_id ORDER BY low) AS label FROM root) {tail}"""


_NEAR4 = "abs(q.x - p.x) + abs(q.y - p.y) = 1"
_NEAR8 = "abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND q.id <> p.id"
for _name, _k, _near in [("ccl4", components.CONNECTIVITY_4, _NEAR4), ("ccl8", components.CONNECTIVITY_8, _NEAR8)]:
    _add(_name, lambda s, d, k=_k: components.connected_components(_bright(s, d), k).pixels(), _labels_sql("SELECT image_id, (id % 8)::INT AS x, (id // 8)::INT AS y, label FROM lab", _near))
_add("ccl4_distributed", lambda s, d: components.connected_components(_bright(s, d), distributed=True).pixels(), ORACLES["ccl4"])
_add("ccl_counts", lambda s, d: components.connected_components(_bright(s, d)).counts(), _labels_sql("SELECT i.image_id, coalesce(max(label), 0) AS label_count FROM (SELECT DISTINCT image_id FROM emb8) i LEFT JOIN lab USING (image_id) GROUP BY 1", _NEAR4))


def _stats(spark, sf_dir):
    rows = components.connected_components(_bright(spark, sf_dir)).stats()
    return rows.select("image_id", "label", "area", "min_x", "min_y", "max_x", "max_y", "sum_x", "sum_y", *(F.round(c, 4).alias(c) for c in ("centroid_x", "centroid_y", "aspect_ratio")))


_add("ccl_stats", _stats, _labels_sql("SELECT image_id, label, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y, round(sum(x) / count(*)::DOUBLE, 4) AS centroid_x, round(sum(y) / count(*)::DOUBLE, 4) AS centroid_y, round((max(x) - min(x) + 1) / (max(y) - min(y) + 1)::DOUBLE, 4) AS aspect_ratio FROM lab JOIN fg USING (image_id, id) GROUP BY 1, 2", _NEAR4))

# The flagship: edges, then Otsu


def _sobel_otsu(spark, sf_dir):
    """Foreground pixels of each image after |Sobel x|, rounded into 8 bits, and an Otsu mask."""
    edges = filters.sobel_x(rs.emb8(spark, sf_dir), nb.ClampBorder())
    sizes = edges.map_channels(lambda v: pixel_type("Mono8").from_linear(F.abs(v)), "Mono8")
    mask = histogram.otsu_binary_mask(sizes)
    return mask.df.select("image_id", F.size(F.filter("v", lambda v: v)).cast("bigint").alias("foreground"))


_add("sobel_otsu_foreground", _sobel_otsu, f"{_SX}, edge AS (SELECT image_id, x, y, least(255, round(abs(sum(k * v))))::INT AS v FROM t GROUP BY 1, 2, 3){_OTSU.format(src='edge')} SELECT image_id, count(*) FILTER (v > coalesce(threshold, 0)) AS foreground FROM edge LEFT JOIN otsu USING (image_id) GROUP BY 1")

from rasterloom.plans import basics, large  # noqa: E402, F401  # their queries register themselves
