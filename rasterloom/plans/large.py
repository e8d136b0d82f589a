"""Queries of large kernels and masks, of images of pixel rows, of tables of rectangles, and of raw files read by bands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.errors import AccumulatorOverflow, LabelOverflow
from rasterloom.frame import ImageFrame
from rasterloom.functions import conversions as cv
from rasterloom.operators import components, filters, folds, geometry, histogram, integral, morphology, regions, template, tiling
from rasterloom.operators import neighborhood as nb
from rasterloom.operators.convert import convert_image
from rasterloom.plans import rasters as rs
from rasterloom.plans.rasters import EMB8, EMB8RGB, EV_HEAT, LI_GRID, LI_MID, LI_WIDE
from rasterloom.plans.registry import ORACLES, add
from rasterloom.shapes import Rectangle, Size
from rasterloom.sources import images as src
from rasterloom.sources import raw
from rasterloom.storage import shared_dir

# Accumulators


def _cells(kernel: nb.Kernel) -> str:
    return ", ".join(f"({dx}, {dy}, {float(w)}::DOUBLE)" for dx, dy, w in kernel.positions())


def _taps(kernel: nb.Kernel, cte: str, name: str, w: int, h: int) -> str:
    """CTE t (image_id, x, y, c, k, v) for a clamped border, inactive cells left out."""
    return f"""WITH {cte}, k(dx, dy, k) AS (SELECT * FROM (VALUES {_cells(kernel)}) z(a, b, c) WHERE c <> 0),
        o AS MATERIALIZED (SELECT image_id, x, y, v AS c, k, least(greatest(x + dx, 0), {w - 1}) AS u, least(greatest(y + dy, 0), {h - 1}) AS w FROM {name} CROSS JOIN k),
        t AS (SELECT o.image_id, o.x, o.y, c, k, q.v FROM o JOIN {name} q ON q.image_id = o.image_id AND q.x = u AND q.y = w)"""


_CLAMP = nb.ClampBorder()
_WEIGHTS = nb.Kernel.of([[1, 2, 3], [2, 1, 2], [3, 2, 1]])
add("fold_accumulate", lambda s, d: nb.fold_neighborhood(rs.emb8(s, d), _WEIGHTS, _CLAMP, folds.Spread(), "Mono16"), f"{_taps(_WEIGHTS, EMB8, 'emb8', 8, 8)} SELECT image_id, x, y, (max(k * v) - min(k * v))::INT AS v FROM t GROUP BY 1, 2, 3")
add("map_accumulate", lambda s, d: nb.map_neighborhood(rs.emb8(s, d), nb.DIAMOND_5X5, _CLAMP, folds.Brighter()), f"{_taps(nb.DIAMOND_5X5, EMB8, 'emb8', 8, 8)} SELECT image_id, x, y, count(*) FILTER (v > c)::INT AS v FROM t GROUP BY 1, 2, 3")

# Large kernels and masks

_WIDE_KERNEL = nb.Kernel.of([[(x * y) % 5 - 2 for x in range(15)] for y in range(15)])
_DISC = nb.Kernel.of([[(x - 7) ** 2 + (y - 7) ** 2 <= 49 for x in range(15)] for y in range(15)])
_SQUARE, _SQUARE_41 = nb._full(15, 15, True), nb._full(41, 41, True)


def _mid(name, run, kernel, value):
    add(name, lambda s, d: run(rs.li_mid(s, d)), f"{_taps(kernel, LI_MID, 'li_mid', 96, 80)} SELECT image_id, x, y, {value} AS v FROM t GROUP BY 1, 2, 3")


_mid("correlate_15", lambda f: filters.correlate(f, _WIDE_KERNEL, _CLAMP, "Mono16"), _WIDE_KERNEL, "least(65535, greatest(0, sum(k * v)))::INT")
_mid("dilate_disc_15", lambda f: morphology.dilate(f, _DISC, _CLAMP), _DISC, "max(v)")
_mid("erode_disc_15", lambda f: morphology.erode(f, _DISC, _CLAMP), _DISC, "min(v)")
_mid("median_15", lambda f: morphology.median_filter(f, _SQUARE, _CLAMP), _SQUARE, "list_sort(list(v))[113]")
_SLID = "{0}(v) OVER (PARTITION BY image_id, {1} ORDER BY {2} ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS v"
_step = lambda name, source, what: f"{name}_x AS (SELECT image_id, x, y, {_SLID.format(what, 'y', 'x')} FROM {source}), {name} AS (SELECT image_id, x, y, {_SLID.format(what, 'x', 'y')} FROM {name}_x)"
add("dilate_41", lambda s, d: morphology.dilate(rs.li_wide(s, d), _SQUARE_41, _CLAMP), f"WITH {LI_WIDE}, {_step('a', 'li_wide', 'max')} SELECT * FROM a")
add("closing_41", lambda s, d: morphology.closing(rs.li_wide(s, d), _SQUARE_41, _CLAMP), f"WITH {LI_WIDE}, {_step('a', 'li_wide', 'max')}, {_step('b', 'a', 'min')} SELECT * FROM b")
_SX = nb.SOBEL_Y.flipped()
add("sobel_wide", lambda s, d: filters.sobel_x(rs.li_wide(s, d), _CLAMP).map_channels(lambda v: v.cast("double"), "MonoF64"), f"{_taps(_SX, LI_WIDE, 'li_wide', 768, 768)} SELECT image_id, x, y, sum(k * v) AS v FROM t GROUP BY 1, 2, 3")

# Templates by tables and transforms

_SHOWN = template.Template(Size(16, 16), [(3 * x + 5 * y) % 97 for y in range(16) for x in range(16)])
_MATCHED = f"""WITH {LI_MID}, tpl AS (SELECT x AS tx, y AS ty, ((3 * x + 5 * y) % 97)::DOUBLE AS t FROM range(16) a(x), range(16) b(y)),
o AS MATERIALIZED (SELECT image_id, x, y, x + tx AS u, y + ty AS w, t FROM li_mid CROSS JOIN tpl WHERE x <= 80 AND y <= 64),
m AS (SELECT o.image_id, o.x, o.y, sum(q.v::DOUBLE) / 256 AS im, sum(q.v::DOUBLE * q.v) / 256 AS ii, sum(t) / 256 AS tm, sum(t * t) / 256 AS tt, sum(q.v * t) / 256 AS it, sum((q.v - t) * (q.v - t)) AS ssd
      FROM o JOIN li_mid q ON q.image_id = o.image_id AND q.x = u AND q.y = w GROUP BY 1, 2, 3)"""
_score = lambda method, digits: lambda s, d: template.match_template(rs.li_mid(s, d), _SHOWN, method).pixels().withColumn("v", F.round(F.col("v").cast("double"), digits))
add("match_ssd_16", _score(template.SSD(), 0), f"{_MATCHED} SELECT image_id, x, y, round(ssd::FLOAT::DOUBLE, 0) AS v FROM m")
add("match_ncc_16", _score(template.NCC(), 4), f"{_MATCHED} SELECT image_id, x, y, round(CASE WHEN (ii - im * im) * (tt - tm * tm) < 1e-24 THEN 0 ELSE (it - im * tm) / sqrt((ii - im * im) * (tt - tm * tm)) END::FLOAT::DOUBLE, 4) AS v FROM m")

# Images of pixel rows: components by tiles, moves and resizing by blocks, halos that wrap and results that shrink


def _labelled(connectivity):
    def query(spark, sf_dir):
        mask = convert_image(rs.emb8(spark, sf_dir), cv.BinaryMask(128))
        return components.components_of_pixels(mask.pixels(), mask.images(), connectivity, tile=3).pixels()

    return query


add("ccl4_tiles", _labelled(components.CONNECTIVITY_4), ORACLES["ccl4"])
add("ccl8_tiles", _labelled(components.CONNECTIVITY_8), ORACLES["ccl8"])


def _tile_stats(spark, sf_dir):
    mask = convert_image(rs.emb8(spark, sf_dir), cv.BinaryMask(128))
    rows = components.components_of_pixels(mask.pixels(), mask.images(), tile=3).stats()
    return rows.select("image_id", "label", "area", "min_x", "min_y", "max_x", "max_y", "sum_x", "sum_y", *(F.round(c, 4).alias(c) for c in ("centroid_x", "centroid_y", "aspect_ratio")))


add("ccl_stats_tiles", _tile_stats, ORACLES["ccl_stats"])


def _heat(operator):
    def query(spark, sf_dir):
        frame = rs.ev_heat(spark, sf_dir)
        return operator(frame.pixels(), frame.images())

    return query


for _name in ("rotate_90", "rotate_270", "transpose"):
    add(f"{_name}_pixels", _heat(lambda p, i, n=_name: geometry.move_pixels(p, i, n)), ORACLES[_name])
add("flip_h_pixels", _heat(lambda p, i: geometry.move_pixels(p, i, "flip_h")), f"WITH {EV_HEAT} SELECT image_id, 23 - x AS x, y, v FROM ev_heat")
add("resize_nearest_pixels", _heat(lambda p, i: geometry.resize_pixels(p, i, "Mono16", 37, 11, geometry.NearestNeighbor(), block=8)), ORACLES["resize_nearest"])
add("resize_bilinear_pixels", _heat(lambda p, i: geometry.resize_pixels(p, i, "Mono16", 37, 47, geometry.Bilinear(), block=16)), ORACLES["resize_bilinear"])


def _parts(operator):
    def query(spark, sf_dir):
        frame = rs.li_grid(spark, sf_dir)
        return operator(frame.pixels(), frame.images())

    return query


_GAUSS = lambda border: lambda g: filters.correlate(g, nb.GAUSSIAN_5X5, border, "Mono16")
_near = lambda at: f"(({at} % 64) + 64) % 64"
_GAUSS_CELLS = f"k(dx, dy, k) AS (VALUES {_cells(nb.GAUSSIAN_5X5)})"
add("tiled_wrap", _parts(lambda p, i: tiling.tiled_round(p, i, "Mono8", Size(24, 20), 2, lambda g, b: _GAUSS(b)(g))), f"WITH {LI_GRID}, {_GAUSS_CELLS}, o AS MATERIALIZED (SELECT image_id, x, y, k, {_near('(x + dx)')} AS u, {_near('(y + dy)')} AS w FROM li_grid CROSS JOIN k) SELECT o.image_id, o.x, o.y, least(65535, sum(k * q.v))::INT AS v FROM o JOIN li_grid q ON q.image_id = o.image_id AND q.x = u AND q.y = w GROUP BY 1, 2, 3")
add("tiled_skip", _parts(lambda p, i: tiling.tiled_inside(p, i, "Mono8", Size(24, 20), (4, 4), _GAUSS(nb.Skip()))), f"WITH {LI_GRID}, {_GAUSS_CELLS} SELECT p.image_id, p.x - 2 AS x, p.y - 2 AS y, least(65535, sum(k * q.v))::INT AS v FROM li_grid p CROSS JOIN k JOIN li_grid q ON q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy WHERE p.x BETWEEN 2 AND 61 AND p.y BETWEEN 2 AND 61 GROUP BY 1, 2, 3")
_SMALL = template.Template(Size(4, 3), [x * y for y in range(3) for x in range(4)])
add("tiled_template", _parts(lambda p, i: tiling.tiled_inside(p, i, "Mono8", Size(24, 20), (3, 2), lambda g: template.match_template(g, _SMALL, template.SAD()))), f"WITH {LI_GRID} SELECT p.image_id, p.x, p.y, sum(abs(q.v - a.x * b.y))::FLOAT AS v FROM li_grid p CROSS JOIN range(4) a(x) CROSS JOIN range(3) b(y) JOIN li_grid q ON q.image_id = p.image_id AND q.x = p.x + a.x AND q.y = p.y + b.y WHERE p.x <= 60 AND p.y <= 61 GROUP BY 1, 2, 3")

# Tables of rectangles


def _boxes(spark, sf_dir, name: str, key: str) -> DataFrame:
    """A rectangle for each row of a table, some beyond their image, over the images of ev_heat."""
    kinds = rs.table(spark, sf_dir, "events").select(F.col("event_type").alias("image_id")).distinct()
    rows = rs.table(spark, sf_dir, name).select(F.col(key).alias("k"), F.lit(1).alias("one"))
    at = lambda m, n: F.pmod(F.floor(F.col("k") / m), F.lit(n)).cast("int")
    boxes = rows.select(F.col("k").alias("rect_id"), at(1, 23).alias("left"), at(3, 29).alias("top"), at(7, 9).alias("width"), at(11, 7).alias("height"), F.pmod("k", F.lit(2)).alias("odd"))
    # half of them lie on the first image by name, half on the last
    ends = kinds.agg(F.min("image_id").alias("a"), F.max("image_id").alias("b")).select(F.explode(F.array(F.struct(F.lit(0).alias("odd"), F.col("a").alias("image_id")), F.struct(F.lit(1).alias("odd"), F.col("b").alias("image_id")))).alias("e")).select("e.*")
    return boxes.join(F.broadcast(ends), "odd").drop("odd")


_BOXES = "boxes AS (SELECT k AS rect_id, (k % 23)::INT AS \"left\", ((k // 3) % 29)::INT AS top, ((k // 7) % 9)::INT AS width, ((k // 11) % 7)::INT AS height, CASE WHEN k % 2 = 0 THEN (SELECT min(event_type) FROM events) ELSE (SELECT max(event_type) FROM events) END AS image_id FROM (SELECT {key} AS k FROM {table}))"


def _region_sums(spark, sf_dir):
    frame = rs.ev_heat(spark, sf_dir)
    table = integral.integral_of_pixels(frame.pixels(), frame.images(), "Mono16", "Mono64")
    return integral.region_sums(table, frame.images(), "Mono64", _boxes(spark, sf_dir, "orders", "o_orderkey"))


add("region_sums", _region_sums, f"WITH {EV_HEAT}, {_BOXES.format(key='o_orderkey', table='orders')} SELECT rect_id, b.image_id, \"left\", top, width, height, CASE WHEN \"left\" + width <= 24 AND top + height <= 30 THEN coalesce(sum(v), 0) END::DECIMAL(20,0) AS v FROM boxes b LEFT JOIN ev_heat p ON p.image_id = b.image_id AND p.x >= \"left\" AND p.x < \"left\" + width AND p.y >= top AND p.y < top + height GROUP BY 1, 2, 3, 4, 5, 6")
add("region_sums_of_images", lambda s, d: integral.integral_image(rs.ev_heat(s, d), "Mono64").region_sums(_boxes(s, d, "customer", "c_custkey")), ORACLES["region_sums"].replace("o_orderkey", "c_custkey").replace("FROM orders", "FROM customer"))
add("regions_of_pixels", lambda s, d: regions.regions_of_pixels(rs.ev_heat(s, d).pixels(), _boxes(s, d, "customer", "c_custkey")), f"WITH {EV_HEAT}, {_BOXES.format(key='c_custkey', table='customer')} SELECT rect_id, b.image_id, (p.x - \"left\")::INT AS x, (p.y - top)::INT AS y, v FROM boxes b JOIN ev_heat p ON p.image_id = b.image_id AND p.x >= \"left\" AND p.x < \"left\" + width AND p.y >= top AND p.y < top + height")

# Raw files


def _raw_folder(spark) -> str:
    return f"{shared_dir(spark)}/rasterloom-raw-{uuid.uuid4().hex}"


def _raw_bands(spark, sf_dir):
    """Two of three channels of files, a few to a task."""
    path = _raw_folder(spark)
    raw.write(rs.emb8rgb(spark, sf_dir), path)
    lines = raw.read_lines(spark, path, "Rgb8", ["r", "b"], band=1000)
    return raw.pixels_of_lines(lines, ["r", "b"]).withColumn("image_id", F.col("image_id").cast("bigint"))


add("raw_bands", _raw_bands, f"WITH {EMB8RGB} SELECT image_id, x, y, r, b FROM emb8rgb")


def _raw_sums(spark, sf_dir):
    """An image written as a file, its lines read by bands, tables of its pixel rows, and sums over a table of rectangles."""
    path = _raw_folder(spark)
    raw.write(rs.ev_heat(spark, sf_dir), path)
    lines = raw.read_lines(spark, path, "Mono16", band=200)
    sizes = lines.select("image_id", "width", "height").distinct()
    table = integral.integral_of_pixels(raw.pixels_of_lines(lines, ["v"]), sizes, "Mono16", "Mono64")
    return integral.region_sums(table, sizes, "Mono64", _boxes(spark, sf_dir, "customer", "c_custkey"))


add("raw_region_sums", _raw_sums, ORACLES["region_sums_of_images"])

# Equality, accessors and plain values, with what a table says


def _equality(spark, sf_dir):
    """Every third image flipped, every fifth cut, every seventh missing."""
    frame = rs.emb8(spark, sf_dir)
    k = F.col("image_id")
    other = frame.df.filter(k % 7 != 0).withColumn("v", F.when(k % 3 == 0, F.reverse("v")).when(k % 5 == 0, F.slice("v", 1, 56)).otherwise(F.col("v"))).withColumn("height", F.when((k % 3 != 0) & (k % 5 == 0), 7).otherwise(8))
    return frame.equals(ImageFrame(other, frame.pixel))


add("image_equality_mixed", _equality, f"WITH {EMB8}, turned AS (SELECT p.image_id, min((p.v = q.v)::INT) = 1 AS same FROM emb8 p JOIN emb8 q ON q.image_id = p.image_id AND q.x = 7 - p.x AND q.y = 7 - p.y GROUP BY 1) SELECT image_id, CASE WHEN image_id % 7 = 0 THEN false WHEN image_id % 3 = 0 THEN same WHEN image_id % 5 = 0 THEN false ELSE true END AS equal FROM turned")
_NATURAL = histogram.NaturalBins()
_hist = lambda what: lambda s, d: what(histogram.histogram(rs.emb8(s, d), _NATURAL)).select("image_id", "bin", F.col("count").cast("bigint").alias("n"))
_count_sql = lambda b: f"WITH {EMB8} SELECT image_id, {b}::INT AS bin, count(*) FILTER (v = {b}) AS n FROM emb8 GROUP BY 1"
add("hist_count_at_bin", _hist(lambda h: histogram.count_at_bin(h, 128)), _count_sql(128))
add("hist_count_for", _hist(lambda h: histogram.count_for(h, _NATURAL, 131)), _count_sql(131))
_CUSTOM = histogram.CustomBins.of((0, 90, 120, 128, 150, 255))


def _ranges(spark, sf_dir):
    limits = spark.createDataFrame([(k, *map(float, _CUSTOM.range(k))) for k in range(_CUSTOM.count)], "bin int, low double, high double")
    return histogram.histogram(rs.emb8(spark, sf_dir), _CUSTOM).join(F.broadcast(limits), "bin").select("image_id", "bin", "low", "high", F.col("count").cast("bigint").alias("n"))


add("hist_ranges", _ranges, f"WITH {EMB8}, r(bin, low, high) AS (VALUES (0, 0.0::DOUBLE, 90.0::DOUBLE), (1, 90, 120), (2, 120, 128), (3, 128, 150), (4, 150, 255)) SELECT image_id, bin, low, high, count(*) FILTER (v >= low AND (v < high OR (bin = 4 AND v = high))) AS n FROM emb8 CROSS JOIN r GROUP BY 1, 2, 3, 4")
add("lossless_into", lambda s, d: geometry.resize(rs.emb8(s, d), 8, 8, geometry.NearestNeighbor(), "Mono32").map_channels(lambda v: v + 2**32 - 256, "Mono32"), f"WITH {EMB8} SELECT image_id, x, y, v::BIGINT + 4294967040 AS v FROM emb8")


def _rows(spark, sf_dir, name: str, *columns: str) -> list[tuple]:
    """A table of a few fixed rows (region, nation), in order."""
    return sorted(map(tuple, rs.table(spark, sf_dir, name).select(*columns).collect()))


def _literal(spark, sf_dir):
    """Images whose pixels are plain values: the numbers of a few rows."""
    return src.from_rows(spark, [(k, 2, 1, [(k, 2 * k, 3 * k), (9, 8, 7)]) for (k,) in _rows(spark, sf_dir, "region", "r_regionkey")], "Rgb8")


add("literal_images_of_region", _literal, "SELECT r_regionkey::BIGINT AS image_id, x, 0 AS y, CASE WHEN x = 0 THEN r_regionkey ELSE 9 END::INT AS r, CASE WHEN x = 0 THEN 2 * r_regionkey ELSE 8 END::INT AS g, CASE WHEN x = 0 THEN 3 * r_regionkey ELSE 7 END::INT AS b FROM region, (VALUES (0), (1)) t(x)")


def _nation_rectangles(spark, sf_dir):
    """Sizes and rectangles made of two numbers of each row."""
    out = []
    for n, r in _rows(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"):
        box = Rectangle.of(r, n, n + 1, r + 2)
        out.append((n, box.size.area, box.right, box.bottom, Size(n, r).checked_area()))
    return spark.createDataFrame(out, "image_id bigint, area bigint, right bigint, bottom bigint, own bigint")


add("rectangles_of_nation", _nation_rectangles, "SELECT n_nationkey::BIGINT AS image_id, ((n_nationkey + 1) * (n_regionkey + 2))::BIGINT AS area, (n_regionkey + n_nationkey + 1)::BIGINT AS \"right\", (n_nationkey + n_regionkey + 2)::BIGINT AS bottom, (n_nationkey * n_regionkey)::BIGINT AS own FROM nation")


def _nation_kernel(spark, sf_dir):
    """A 5 x 5 kernel of 25 numbers, applied."""
    weights = [r for _, r in _rows(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")][:25]
    kernel = nb.Kernel.of([weights[k : k + 5] for k in range(0, 25, 5)])
    return filters.correlate(rs.emb8(spark, sf_dir), kernel, nb.Wrap(), "Mono16")


add("kernel_of_nation", _nation_kernel, f"WITH {EMB8}, k AS (SELECT (n_nationkey % 5 - 2)::INT AS dx, (n_nationkey // 5 - 2)::INT AS dy, n_regionkey AS k FROM nation WHERE n_nationkey < 25) SELECT p.image_id, p.x, p.y, sum(k * q.v)::INT AS v FROM emb8 p CROSS JOIN k JOIN emb8 q ON q.image_id = p.image_id AND q.x = (p.x + dx + 8) % 8 AND q.y = (p.y + dy + 8) % 8 GROUP BY 1, 2, 3")


def _border_sizes(spark, sf_dir):
    """What each border policy makes of the sizes of a table's images under a 3 x 5 kernel."""
    every = None
    for border in (nb.Skip(), nb.ClampBorder(), nb.Mirror(), nb.Wrap(), nb.Constant(1)):
        sizes = filters.correlate(rs.emb8(spark, sf_dir), nb._full(3, 5, 1), border).images().withColumn("full", F.lit(border.full))
        every = sizes if every is None else every.union(sizes)
    return every.groupBy("full", "width", "height").agg(F.count("*").alias("n"))


add("border_sizes", _border_sizes, "SELECT b AS \"full\", CASE WHEN b THEN 8 ELSE 6 END AS width, CASE WHEN b THEN 8 ELSE 4 END AS height, (count(*) * CASE WHEN b THEN 4 ELSE 1 END)::BIGINT AS n FROM embeddings, (VALUES (true), (false)) t(b) WHERE len(embedding) = 64 GROUP BY 1, 2, 3")


def _preflight(spark, sf_dir):
    """Whether squares of 16-bit images of 2^k rows could exceed an exact double, k from a table."""
    out = []
    for (n,) in _rows(spark, sf_dir, "nation", "n_nationkey"):
        try:
            integral.preflight(Size(1 << 10, 1 << n), "Mono16", "MonoF64", True)
            out.append((n, False))
        except AccumulatorOverflow:
            out.append((n, True))
    return spark.createDataFrame(out, "image_id bigint, overflow boolean")


add("integral_preflight_of_nation", _preflight, "SELECT n_nationkey::BIGINT AS image_id, 4294836225 * power(2, n_nationkey + 10) > 9007199254740992 AS overflow FROM nation")


def _label_limits(spark, sf_dir):
    """Labelling under limits of so many labels."""
    mask = convert_image(rs.emb8(spark, sf_dir), cv.BinaryMask(128))
    out = []
    for limit in (1, 5, 64):
        try:
            components.components_of_pixels(mask.pixels(), mask.images(), max_label=limit)
            out.append((limit, False))
        except LabelOverflow:
            out.append((limit, True))
    return spark.createDataFrame(out, "most bigint, overflow boolean")


add("label_limits", _label_limits, f"SELECT most::BIGINT AS most, (SELECT max(label_count) FROM ({ORACLES['ccl_counts']})) > most AS overflow FROM (VALUES (1), (5), (64)) t(most)")
