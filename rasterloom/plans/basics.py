"""Queries of sources, sinks, plain values, scalars, bins of one's own, and images too large for a row."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.errors import AccumulatorOverflow, BorderError, LabelOverflow
from rasterloom.frame import ImageFrame
from rasterloom.functions import conversions as cv
from rasterloom.functions import scalars as sc
from rasterloom.operators import combine, components, filters, histogram, integral, regions, template, tiling
from rasterloom.operators import neighborhood as nb
from rasterloom.operators.convert import convert_image
from rasterloom.pixel import pixel_type
from rasterloom.plans import rasters as rs
from rasterloom.plans.rasters import EMB8, EMB8RGB, EMB16, EV_HEAT, LI_GRID
from rasterloom.plans.registry import add
from rasterloom.shapes import Rectangle, Size, Stride
from rasterloom.sources import images as src
from rasterloom.storage import shared_dir
from rasterloom.streaming.convert import convert_stream

# Sources and sinks

_LITERALS = [(1, 2, 1, [(1, 2, 3), (4, 5, 6)]), (2, 1, 2, [(7, 8, 9), (255, 0, 1)])]
add("literal_images", lambda s, d: src.from_rows(s, _LITERALS, "Rgb8"), "SELECT * FROM (VALUES (1::BIGINT, 0, 0, 1, 2, 3), (1, 1, 0, 4, 5, 6), (2, 0, 0, 7, 8, 9), (2, 0, 1, 255, 0, 1)) t(image_id, x, y, r, g, b)")
add("table_images", lambda s, d: src.from_table(rs.emb8(s, d).df, "Mono8"), f"WITH {EMB8} SELECT image_id, x, y, v FROM emb8")
add("images_of_pixels", lambda s, d: ImageFrame.from_pixels(rs.emb8(s, d).pixels(), "Mono8"), f"WITH {EMB8} SELECT image_id, x, y, v FROM emb8")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey").cast("int")
    return rs.table(spark, sf_dir, "region").select(key.cast("bigint").alias("image_id"), (key + 3).alias("width"), (key * 2).alias("height"))


_CELLS = "WITH s AS (SELECT r_regionkey::BIGINT AS image_id, (r_regionkey + 3)::INT AS w, (r_regionkey * 2)::INT AS h FROM region) SELECT image_id, x::INT AS x, y::INT AS y, {} FROM s, range(20) a(x), range(20) b(y) WHERE x < w AND y < h"
add("generate", lambda s, d: src.generate(_sizes(s, d), "Mono16", lambda x, y: x * 10 + y), _CELLS.format("(x * 10 + y)::INT AS v"))
add("zero", lambda s, d: src.zero(_sizes(s, d), "Mono8"), _CELLS.format("0 AS v"))
add("fill", lambda s, d: src.fill(_sizes(s, d), "Rgb8", 9, 8, 7), _CELLS.format("9 AS r, 8 AS g, 7 AS b"))
add("bytes_big", lambda s, d: src.to_bytes(rs.emb16(s, d), "big").select("image_id", F.hex("data").alias("data")), f"WITH {EMB16} SELECT image_id, string_agg(printf('%04X', v), '' ORDER BY y, x) AS data FROM emb16 GROUP BY 1")
add("bytes_little", lambda s, d: src.to_bytes(rs.emb16(s, d), "little").select("image_id", F.hex("data").alias("data")), f"WITH {EMB16} SELECT image_id, string_agg(printf('%02X%02X', v % 256, v // 256), '' ORDER BY y, x) AS data FROM emb16 GROUP BY 1")
add("bytes_round_trip", lambda s, d: src.from_bytes(src.to_bytes(rs.emb8rgb(s, d), "big"), "Rgb8", "big"), f"WITH {EMB8RGB} SELECT image_id, x, y, r, g, b FROM emb8rgb")


def _wide_bytes(spark, sf_dir):
    frame = convert_image(rs.emb8(spark, sf_dir), cv.FullRange(), "Mono64")
    return src.from_bytes(src.to_bytes(frame, "little"), "Mono64", "little")


add("bytes_u64", _wide_bytes, f"WITH {EMB8} SELECT image_id, x, y, (v::HUGEINT * 72340172838076673)::DECIMAL(20,0) AS v FROM emb8")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rasterloom-{name}-{uuid.uuid4().hex}"


def _saved(spark, sf_dir):
    path = _folder(spark, "images")
    src.save(rs.emb8rgb(spark, sf_dir), path)
    return src.load(spark, path)


add("save_load", _saved, f"WITH {EMB8RGB} SELECT image_id, x, y, r, g, b FROM emb8rgb")


def _streamed(spark, sf_dir):
    """The embeddings as a stream of pixels, thresholded, written and read back."""
    batch, path = rs.table(spark, sf_dir, "embeddings"), _folder(spark, "stream")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/embeddings.parquet*")
    pixels = rs.embedding_pixels(stream)
    out = convert_stream(pixels, "Mono8", cv.BinaryThreshold(128))
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


add("stream_threshold", _streamed, f"WITH {EMB8} SELECT image_id, x, y, CASE WHEN v > 128 THEN 255 ELSE 0 END AS v FROM emb8")

# Views and values


def _own_tiles(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"image_id": pdf["image_id"], "number": pdf["number"], "largest": [int(max(v)) for v in pdf["v"]]})


add("map_tiles", lambda s, d: regions.map_tiles(rs.li_grid(s, d), Size(24, 20), "image_id int, number int, largest long", _own_tiles), f"WITH {LI_GRID} SELECT image_id, ((y // 20) * 3 + x // 24)::INT AS number, max(v)::BIGINT AS largest FROM li_grid GROUP BY 1, 2")
add("interior", lambda s, d: regions.roi(rs.emb8(s, d), regions.interior(Size(8, 8), Size(4, 3), (2, 1))), f"WITH {EMB8} SELECT image_id, x - 2 AS x, y - 1 AS y, v FROM emb8 WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 6")


def _rectangles(spark, sf_dir):
    """Sliding windows of 4 x 3 with stride 3, 2 as values of the driver, and which of them lie in 10 x 7."""
    stride, out = Stride(3, 2), []
    for k in range(20):
        r = Rectangle.of(k % 5 * stride.x, k // 5 * stride.y, 4, 3)
        out.append((k, r.left, r.top, r.right, r.bottom, r.size.area, r.inside(Size(10, 7))))
    return spark.createDataFrame(out, "k int, x0 int, y0 int, x1 int, y1 int, area int, inside boolean")


add("rectangles", _rectangles, "SELECT k::INT AS k, (k % 5 * 3)::INT AS x0, (k // 5 * 2)::INT AS y0, (k % 5 * 3 + 4)::INT AS x1, (k // 5 * 2 + 3)::INT AS y1, 12 AS area, k % 5 * 3 + 4 <= 10 AND k // 5 * 2 + 3 <= 7 AS inside FROM range(20) r(k)")
_KERNEL = nb.Kernel.of([[1, 2, 3], [4, 5, 6]], (2, 0))
add("kernel_cells", lambda s, d: s.createDataFrame([(dx, dy, float(w)) for dx, dy, w in _KERNEL.flipped().positions()], "dx int, dy int, w double"), "SELECT (x % 3)::INT AS dx, (x // 3 - 1)::INT AS dy, (6 - x)::DOUBLE AS w FROM range(6) r(x)")


def _full(spark, sf_dir):
    out = []
    for name, border in [("skip", nb.Skip()), ("clamp", nb.ClampBorder()), ("mirror", nb.Mirror()), ("wrap", nb.Wrap()), ("constant", nb.Constant(0))]:
        try:
            nb.require_full(border, "a test")
            out.append((name, True))
        except BorderError:
            out.append((name, False))
    return spark.createDataFrame(out, "border string, whole boolean")


add("full_borders", _full, "SELECT * FROM (VALUES ('skip', false), ('clamp', true), ('mirror', true), ('wrap', true), ('constant', true)) t(border, whole)")


class Parity(histogram.BinningStrategy):
    """Even values in bin 0, odd ones in bin 1."""

    count = 2

    def bin(self, v):
        return (v % 2).cast("int")

    def range(self, k):
        return k, k + 1


add("hist_own_bins", lambda s, d: histogram.histogram(rs.emb8(s, d), Parity()).select("image_id", "channel", "bin", F.col("count").cast("bigint").alias("n")), f"WITH {EMB8} SELECT i.image_id, 0 AS channel, b::INT AS bin, count(p.v)::BIGINT AS n FROM (SELECT DISTINCT image_id FROM emb8) i CROSS JOIN range(2) e(b) LEFT JOIN emb8 p ON p.image_id = i.image_id AND p.v % 2 = b GROUP BY 1, 2, 3")


def _preflight(spark, sf_dir):
    out = []
    for k in range(20):
        try:
            integral.preflight(Size(1 << k, 1 << k), "Mono8", "Mono32")
            out.append((1 << k, True))
        except AccumulatorOverflow:
            out.append((1 << k, False))
    return spark.createDataFrame(out, "side int, fits boolean")


add("integral_preflight", _preflight, "SELECT pow(2, k)::INT AS side, pow(2, k)::HUGEINT * pow(2, k)::HUGEINT * 255 <= 4294967295 AS fits FROM range(20) r(k)")


def _table_sizes(spark, sf_dir):
    made = integral.integral_image(rs.ev_heat(spark, sf_dir), "Mono64")
    return made.source_sizes().join(made.table_sizes().select("image_id", F.col("width").alias("table_width"), F.col("height").alias("table_height")), "image_id")


add("integral_sizes", _table_sizes, "SELECT DISTINCT event_type AS image_id, 24 AS width, 30 AS height, 25 AS table_width, 31 AS table_height FROM events")


def _overflow(spark, sf_dir):
    out = []
    for limit in (1, 9, 10, 2**32 - 1):
        try:
            components.check_labels(10, limit)
            out.append((limit, False))
        except LabelOverflow:
            out.append((limit, True))
    return spark.createDataFrame(out, "most bigint, overflow boolean")


add("label_overflow", _overflow, "SELECT most::BIGINT AS most, 10 > most AS overflow FROM (VALUES (1::BIGINT), (9), (10), (4294967295)) t(most)")

# Scalars

_P8 = pixel_type("Mono8")
_OTHER = "(image_id % 200 + 1)"


def _scalars(**columns):
    def query(spark, sf_dir):
        pixels = rs.emb8(spark, sf_dir).pixels()
        return pixels.select("image_id", "x", "y", *(make(F.col("v"), (F.col("image_id") % 200 + 1).cast("int")).alias(name) for name, make in columns.items()))

    return query


_scalar_sql = lambda what: f"WITH {EMB8} SELECT image_id, x, y, {what} FROM emb8"
add("scalar_saturating", _scalars(plus=lambda v, o: sc.saturating_add(v, o, _P8), minus=lambda v, o: sc.saturating_sub(v, o, _P8), times=lambda v, o: sc.saturating_mul(v, o, _P8), over=lambda v, o: sc.saturating_div(v, o, _P8)), _scalar_sql(f"least(255, v + {_OTHER})::INT AS plus, greatest(0, v - {_OTHER})::INT AS minus, least(255, v * {_OTHER})::INT AS times, (v // {_OTHER})::INT AS over"))
add("scalar_times_float", _scalars(v=lambda v, o: sc.times_float(v, 1.5, _P8), less=lambda v, o: sc.times_float(v, -0.5, _P8)), _scalar_sql("least(255, round(v * 1.5::DOUBLE))::INT AS v, 0 AS less"))
_shown = lambda c: F.round(c.cast("double"), 3)
add("scalar_scale", _scalars(scaled=lambda v, o: _shown(sc.scale(v, 0.25, _P8)), added=lambda v, o: _shown(sc.scale_add(v, 0.25, o, _P8)), size=lambda v, o: sc.magnitude(v - o)), _scalar_sql(f"round(v * 0.25::DOUBLE, 3) AS scaled, round(v * 0.25::DOUBLE + {_OTHER}, 3) AS added, abs(v - {_OTHER})::INT AS size"))


def _channels(spark, sf_dir):
    """Channel 1 read, set to channel 0 of a uniform pixel plus the first, and all channels put together again."""
    p = pixel_type("Rgb8")
    rows = rs.emb8rgb(spark, sf_dir).pixels().select("image_id", "x", "y", sc.from_channels([F.col("b"), F.col("g"), F.col("r")], p).alias("px"))
    uniform = sc.uniform(2.0, p)["r"]
    changed = rows.withColumn("out", sc.set_channel(F.col("px"), 1, sc.channel(F.col("px"), 0, p) + uniform, p))
    return changed.select("image_id", "x", "y", F.array_join(sc.to_channels(F.col("out"), p), ",").alias("channels"))


add("scalar_channels", _channels, f"WITH {EMB8RGB} SELECT image_id, x, y, b || ',' || (b + 2) || ',' || r AS channels FROM emb8rgb")
add("scalar_labels", _scalars(label=lambda v, o: sc.to_label_index(sc.from_label_index(v))), _scalar_sql("v::BIGINT AS label"))

# Images too large for a row


def _of_pixels(operator):
    def query(spark, sf_dir):
        frame = rs.ev_heat(spark, sf_dir)
        return operator(frame.pixels(), frame.images())

    return query


_TABLE = "SELECT i.image_id, gx::INT AS x, gy::INT AS y, (SELECT coalesce(sum({v}), 0) FROM ev_heat p WHERE p.image_id = i.image_id AND p.x < gx AND p.y < gy)::{kind} AS v FROM (SELECT DISTINCT image_id FROM ev_heat) i CROSS JOIN range(25) a(gx) CROSS JOIN range(31) b(gy)"
add("integral_of_pixels", _of_pixels(lambda p, i: integral.integral_of_pixels(p, i, "Mono16", "Mono64")), f"WITH {EV_HEAT} {_TABLE.format(v='v', kind='DECIMAL(20,0)')}")
add("integral_sq_of_pixels", _of_pixels(lambda p, i: integral.integral_of_pixels(p, i, "Mono16", "MonoF64", True)), f"WITH {EV_HEAT} {_TABLE.format(v='v::BIGINT * v', kind='DOUBLE')}")
add("tiled_box_blur", lambda s, d: _tiled(s, d), f"WITH {LI_GRID} SELECT p.image_id, p.x, p.y, round(sum(q.v) / 9.0::DOUBLE)::INT AS v FROM li_grid p CROSS JOIN range(-1, 2) a(dx) CROSS JOIN range(-1, 2) b(dy) JOIN li_grid q ON q.image_id = p.image_id AND q.x = least(greatest(p.x + dx, 0), 63) AND q.y = least(greatest(p.y + dy, 0), 63) GROUP BY 1, 2, 3")


def _tiled(spark, sf_dir):
    frame = rs.li_grid(spark, sf_dir)
    return tiling.tiled(frame.pixels(), frame.images(), "Mono8", Size(24, 20), 1, nb.ClampBorder(), filters.box_blur_3x3)


def _large_components(spark, sf_dir):
    mask = convert_image(rs.emb8(spark, sf_dir), cv.BinaryMask(128))
    return components.components_of_pixels(mask.pixels(), mask.images()).counts()


_NEAR = "abs(q.x - p.x) + abs(q.y - p.y) = 1"
add("ccl_counts_of_pixels", _large_components, f"""WITH RECURSIVE {EMB8}, fg AS MATERIALIZED (SELECT image_id, x, y, (y * 8 + x)::BIGINT AS id FROM emb8 WHERE v > 128),
adj AS MATERIALIZED (SELECT p.image_id, p.id AS a, q.id AS b FROM fg p JOIN fg q ON q.image_id = p.image_id AND {_NEAR}),
reach AS (SELECT image_id, id, id AS low FROM fg UNION SELECT reach.image_id, adj.b, reach.low FROM reach JOIN adj ON adj.image_id = reach.image_id AND adj.a = reach.id WHERE reach.low < adj.b),
root AS (SELECT image_id, id, min(low) AS low FROM reach GROUP BY 1, 2)
SELECT i.image_id, count(DISTINCT low)::BIGINT AS label_count FROM (SELECT DISTINCT image_id FROM emb8) i LEFT JOIN root USING (image_id) GROUP BY 1""")
_LARGE = template.Template(Size(40, 40), *([(x * y * (k + 1)) % 7 for y in range(40) for x in range(40)] for k in range(1)))


def _large_template(spark, sf_dir):
    scores = template.match_template(rs.li_grid(spark, sf_dir), _LARGE, template.SSD())
    return scores.pixels().select("image_id", "x", "y", F.round(F.col("v").cast("double"), 0).alias("v"))


add("match_large", _large_template, f"WITH {LI_GRID}, tpl AS (SELECT x AS tx, y AS ty, ((x * y) % 7)::DOUBLE AS t FROM range(40) a(x), range(40) b(y)) SELECT p.image_id, p.x, p.y, round((sum((q.v - t) * (q.v - t)))::FLOAT::DOUBLE, 0) AS v FROM li_grid p CROSS JOIN tpl JOIN li_grid q ON q.image_id = p.image_id AND q.x = p.x + tx AND q.y = p.y + ty WHERE p.x <= 24 AND p.y <= 24 GROUP BY 1, 2, 3")
add("combine_mixed", lambda s, d: combine.combine_images_fn(rs.emb8(s, d), rs.emb16(s, d), lambda a, b: b - a * 256, "Mono16", mixes=True), f"WITH {EMB8}, {EMB16} SELECT p.image_id, p.x, p.y, q.v - p.v * 256 AS v FROM emb8 p JOIN emb16 q USING (image_id, x, y)")

# Which tables hold sums of which pixel types

_MADE = {
    "Mono8": (rs.emb8, EMB8, "emb8", {"v": "v"}),
    "Mono16": (rs.emb16, EMB16, "emb16", {"v": "v"}),
    "Mono32": (lambda s, d: convert_image(rs.emb8(s, d), cv.FullRange(), "Mono32"), EMB8, "emb8", {"v": "v::HUGEINT * 16843009"}),
    "MonoF32": (rs.embf, rs.EMBF, "embf", {"v": "v::DOUBLE"}),
    "MonoF64": (lambda s, d: convert_image(rs.embf(s, d), cv.FullRange(), "MonoF64"), rs.EMBF, "embf", {"v": "v::DOUBLE"}),
    "Rgb8": (rs.emb8rgb, EMB8RGB, "emb8rgb", {c: c for c in "rgb"}),
    "Rgb16": (lambda s, d: convert_image(rs.emb8rgb(s, d), cv.FullRange(), "Rgb16"), EMB8RGB, "emb8rgb", {c: f"{c} * 257" for c in "rgb"}),
    "RgbF32": (lambda s, d: convert_image(rs.emb8rgb(s, d), cv.FullRange(), "RgbF32"), EMB8RGB, "emb8rgb", {c: f"({c}::FLOAT / 255::FLOAT)::DOUBLE" for c in "rgb"}),
}


def _corners(name: str, table: str, squared: bool) -> None:
    """The table's last row and column, where every sum of the matrix shows, with floats rounded."""
    source, ctes, cte, channels = _MADE[name]
    whole = table[-3:] not in ("F32", "F64")

    def query(spark, sf_dir):
        made = (integral.integral_squared_image if squared else integral.integral_image)(source(spark, sf_dir), table)
        rows = made.frame.pixels().filter("x = 8 or y = 8")
        return rows.select("image_id", "x", "y", *(F.col(c).cast("decimal(20,0)").alias(c) if whole else F.round(c, 2).alias(c) for c in channels))

    power = lambda v: f"({v}) * ({v})" if squared else f"({v})"
    total = lambda c, v: f"coalesce(sum(({power(v)})::HUGEINT), 0)::DECIMAL(20,0) AS {c}" if whole else f"round(coalesce(sum({power(f'({v})::DOUBLE')}), 0)::DOUBLE, 2) AS {c}"
    add(
        f"integral_{'sq_' if squared else ''}{name.lower()}_{table.lower()}",
        query,
        f"WITH {ctes} SELECT i.image_id, gx::INT AS x, gy::INT AS y, {', '.join(total(c, v) for c, v in channels.items())} FROM (SELECT DISTINCT image_id FROM {cte}) i CROSS JOIN range(9) a(gx) CROSS JOIN range(9) b(gy) LEFT JOIN {cte} p ON p.image_id = i.image_id AND p.x < gx AND p.y < gy WHERE gx = 8 OR gy = 8 GROUP BY 1, 2, 3",
    )


for _squared, _matrix in ((False, integral.SUMS), (True, integral.SQUARES)):
    for _name, _tables in _matrix.items():
        for _table_name in _tables if not (_squared and _name == "Mono32") else ():  # no image has squares that small
            _corners(_name, _table_name, _squared)
