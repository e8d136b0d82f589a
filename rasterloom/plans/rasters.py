"""Rasters made from the relational tables, by the same arithmetic as their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.frame import ImageFrame
from rasterloom.pixel import pixel_type
from rasterloom.sources.images import rasterize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quantised(e: Column, top: int, zero: int) -> Column:
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor(e.cast("double") * top + zero))).cast("int")


def _embeddings(spark, sf_dir, channels: dict[str, Column], pixel: str) -> ImageFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64)
    return ImageFrame(rows.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), *(c.alias(n) for n, c in channels.items())), pixel_type(pixel))


def embedding_pixels(rows: DataFrame) -> DataFrame:
    """The pixels of emb8, of a table or a stream of embeddings."""
    cells = rows.filter(F.size("embedding") == 64).select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return cells.select("image_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), _quantised(F.col("e"), 255, 128).alias("v"))


def emb8(spark, sf_dir) -> ImageFrame:
    """Embeddings as 8 x 8 Mono8."""
    return _embeddings(spark, sf_dir, {"v": F.transform("embedding", lambda e: _quantised(e, 255, 128))}, "Mono8")


def emb16(spark, sf_dir) -> ImageFrame:
    return _embeddings(spark, sf_dir, {"v": F.transform("embedding", lambda e: _quantised(e, 65535, 32768))}, "Mono16")


def embf(spark, sf_dir) -> ImageFrame:
    return _embeddings(spark, sf_dir, {"v": F.col("embedding")}, "MonoF32")


def emb8rgb(spark, sf_dir, pixel: str = "Rgb8") -> ImageFrame:
    """Three turns of the same embedding as channels."""
    turned = lambda k: F.transform("embedding", lambda e, i: _quantised(F.get("embedding", (i + k) % 64), 255, 128))
    return _embeddings(spark, sf_dir, {"r": turned(0), "g": turned(21), "b": turned(42)}, pixel)


def next_image(frame: ImageFrame) -> ImageFrame:
    """The frame with each image under its predecessor's number."""
    return ImageFrame(frame.df.withColumn("image_id", F.col("image_id") - 1), frame.pixel)


def ev_heat(spark, sf_dir) -> ImageFrame:
    """Events by hour and day of month, an image for each type: 24 x 30 Mono16."""
    events = table(spark, sf_dir, "events")
    points = events.select(F.col("event_type").alias("image_id"), F.hour("ts").alias("x"), (F.dayofmonth("ts") - 1).alias("y"), F.lit(1).alias("v"))
    images = events.select(F.col("event_type").alias("image_id")).distinct().select("image_id", F.lit(24).alias("width"), F.lit(30).alias("height"))
    return rasterize(points, images, "Mono16")


def li_grid(spark, sf_dir) -> ImageFrame:
    """Line items by order and part, an image for each line number: 64 x 64 Mono8."""
    items = table(spark, sf_dir, "lineitem")
    points = items.select(F.col("l_linenumber").alias("image_id"), (F.col("l_orderkey") % 64).cast("int").alias("x"), (F.col("l_partkey") % 64).cast("int").alias("y"), F.lit(1).alias("v"))
    images = items.select(F.col("l_linenumber").alias("image_id")).distinct().select("image_id", F.lit(64).alias("width"), F.lit(64).alias("height"))
    return rasterize(points, images, "Mono8")


def li_mid(spark, sf_dir) -> ImageFrame:
    """Line items by order and part, an image for each return flag: 96 x 80 Mono8."""
    items = table(spark, sf_dir, "lineitem")
    points = items.select(F.col("l_returnflag").alias("image_id"), (F.col("l_orderkey") % 96).cast("int").alias("x"), (F.col("l_partkey") % 80).cast("int").alias("y"), F.lit(23).alias("v"))
    images = items.select(F.col("l_returnflag").alias("image_id")).distinct().select("image_id", F.lit(96).alias("width"), F.lit(80).alias("height"))
    return rasterize(points, images, "Mono8")


def li_wide(spark, sf_dir) -> ImageFrame:
    """Line items by order and part in one image of 768 x 768 Mono8."""
    items = table(spark, sf_dir, "lineitem")
    points = items.select(F.lit(0).cast("bigint").alias("image_id"), (F.col("l_orderkey") % 768).cast("int").alias("x"), ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 768).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("v"))
    images = items.limit(1).select(F.lit(0).cast("bigint").alias("image_id"), F.lit(768).alias("width"), F.lit(768).alias("height"))
    return rasterize(points, images, "Mono8")


def _sql_embedding(value: str, name: str) -> str:
    return f"{name} AS (SELECT vec_id AS image_id, ((i - 1) % 8)::INT AS x, ((i - 1) // 8)::INT AS y, {value} AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = 64))"


EMB8 = _sql_embedding("least(255, greatest(0, floor(e::DOUBLE * 255 + 128)))::INT", "emb8")
EMB16 = _sql_embedding("least(65535, greatest(0, floor(e::DOUBLE * 65535 + 32768)))::INT", "emb16")
EMBF = _sql_embedding("e::FLOAT", "embf")
EMB8RGB = f"{EMB8}, emb8rgb AS (SELECT p.image_id, p.x, p.y, p.v AS r, q.v AS g, s.v AS b FROM emb8 p JOIN emb8 q ON p.image_id = q.image_id AND q.y * 8 + q.x = (p.y * 8 + p.x + 21) % 64 JOIN emb8 s ON p.image_id = s.image_id AND s.y * 8 + s.x = (p.y * 8 + p.x + 42) % 64)"


def _sql_grid(name: str, source: str, key: str, x: str, y: str, w: int, h: int, top: int) -> str:
    return f"""{name} AS (SELECT i.image_id, g.x, g.y, least({top}, coalesce(c.n, 0))::INT AS v FROM (SELECT DISTINCT {key} AS image_id FROM {source}) i
        CROSS JOIN (SELECT (k % {w})::INT AS x, (k // {w})::INT AS y FROM range({w * h}) r(k)) g
        LEFT JOIN (SELECT {key} AS image_id, {x} AS x, {y} AS y, count(*) AS n FROM {source} GROUP BY 1, 2, 3) c ON c.image_id = i.image_id AND c.x = g.x AND c.y = g.y)"""


EV_HEAT = _sql_grid("ev_heat", "events", "event_type", "hour(ts)", "day(ts) - 1", 24, 30, 65535)
LI_GRID = _sql_grid("li_grid", "lineitem", "l_linenumber", "l_orderkey % 64", "l_partkey % 64", 64, 64, 255)
LI_MID = _sql_grid("li_mid", "lineitem", "l_returnflag", "l_orderkey % 96", "l_partkey % 80", 96, 80, 255).replace("c.n, 0", "c.n * 23, 0").replace("li_mid AS (", "li_mid AS MATERIALIZED (")
LI_WIDE = """li_wide AS MATERIALIZED (SELECT 0::BIGINT AS image_id, g.x, g.y, least(255, coalesce(c.n, 0))::INT AS v FROM (SELECT (k % 768)::INT AS x, (k // 768)::INT AS y FROM range(589824) r(k)) g
        LEFT JOIN (SELECT l_orderkey % 768 AS x, (l_partkey * 31 + l_suppkey) % 768 AS y, sum(l_quantity::INT) AS n FROM lineitem GROUP BY 1, 2) c ON c.x = g.x AND c.y = g.y)"""
