"""Types that must not mix, floats that must not be lost, partners that are missing, and images and templates that are large."""

import math
import os
import random
import shutil
import subprocess
import sys
import time
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import errors
from rasterloom.operators import combine, filters, integral, template
from rasterloom.operators import neighborhood as nb
from rasterloom.pixel import pixel_type
from rasterloom.shapes import Size
from rasterloom.sources import images as src


def one(spark, values, pixel="Mono8", width=None, image=0):
    return src.from_rows(spark, [(image, width or len(values), len(values) // (width or len(values)), values)], pixel)


@pytest.mark.parametrize("other", ["Mono16", "Mono10", "MonoF32", "SrgbMono8", "Indexed8"])
def test_images_of_two_types_do_not_combine(spark, other):
    with pytest.raises(errors.PixelTypeError):
        combine.add(one(spark, [1, 2]), one(spark, [1, 2], other))
    with pytest.raises(errors.PixelTypeError):
        combine.combine_images_fn(one(spark, [1, 2]), one(spark, [1, 2], other), lambda a, b: a)


def test_depths_mix_only_where_the_combiner_says_so(spark):
    with pytest.raises(errors.PixelTypeError):
        combine.abs_diff(one(spark, [1], "Mono10"), one(spark, [1], "Mono16"))
    out = combine.combine_images_fn(one(spark, [1, 2]), one(spark, [300, 400], "Mono16"), lambda a, b: a + b, "Mono16", mixes=True)
    assert out.pixel == pixel_type("Mono16") and out.df.first().v == [301, 402]
    with pytest.raises(errors.PixelTypeError):
        combine.combine_images_fn(one(spark, [1]), one(spark, [(1, 2, 3)], "Rgb8", 1), lambda a, b: a, mixes=True)


def test_images_without_a_partner(spark):
    a = src.from_rows(spark, [(1, 1, 1, [1]), (2, 1, 1, [2])], "Mono8")
    b = src.from_rows(spark, [(2, 1, 1, [5]), (3, 1, 1, [6])], "Mono8")
    assert [(r.image_id, r.v) for r in combine.add(a, b).df.collect()] == [(2, [7])]
    with pytest.raises(Exception, match="MissingPartner"):
        combine.combine_images(a, b, combine.PixelAdd(), paired=True).df.collect()
    assert [r.v for r in combine.combine_images(a, a, combine.PixelAdd(), paired=True).df.orderBy("image_id").collect()] == [[2], [4]]


@pytest.mark.parametrize("border", [nb.Skip(), nb.ClampBorder(), nb.Mirror(), nb.Wrap()])
def test_zero_weights_meet_nan_and_infinity(spark, border):
    rng, w, h = random.Random(4), 6, 5
    values = [rng.choice([1.5, -2.0, 0.0, float("nan"), float("inf"), float("-inf")]) if rng.random() < 0.3 else rng.random() for _ in range(w * h)]
    kernel = nb.Kernel.of([[0, 1, 0], [2, 0, -1], [0, 0, 3]])
    got = filters.correlate(one(spark, values, "MonoF64", w), kernel, border).df.first()
    places = {"Skip": lambda i, n: i, "ClampBorder": lambda i, n: min(max(i, 0), n - 1), "Mirror": lambda i, n: abs(i) if i < n else 2 * n - 2 - i, "Wrap": lambda i, n: i % n}[type(border).__name__]
    inside = [(x, y) for y in range(h) for x in range(w) if border.full or (0 < x < w - 1 and 0 < y < h - 1)]
    expected = [sum(float(k) * values[places(y + dy, h) * w + places(x + dx, w)] for dx, dy, k in kernel.positions()) for x, y in inside]
    assert len(got.v) == len(expected)
    assert all((math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got.v, expected, strict=True))
    assert any(map(math.isnan, expected))


def test_wide_bytes(spark):
    values = [0, 1, 2**63, 2**64 - 1] * 2000
    frame = one(spark, values, "Mono64", 100)
    data = src.to_bytes(frame, "big")
    assert bytes(data.first().data) == np.array(values, dtype=">u8").tobytes()
    assert src.from_bytes(data, "Mono64", "big").df.first().v == [Decimal(v) for v in values]
    assert src.to_bytes(src.zero(spark.createDataFrame([(1, 0, 4)], "image_id long, width int, height int"), "Rgb8")).first().data == b""


def test_sparse_rasters(spark):
    images = spark.createDataFrame([(1, 3, 2), (2, 2, 2), (3, 0, 5)], "image_id long, width int, height int")
    points = spark.createDataFrame([(1, 0, 0, 300), (1, 2, 1, 4), (1, 2, 1, 5), (1, 9, 0, 1), (7, 0, 0, 1)], "image_id long, x int, y int, v int")
    got = {r.image_id: r.v for r in src.rasterize(points, images, "Mono8").df.collect()}
    assert got == {1: [255, 0, 0, 0, 0, 9], 2: [0] * 4, 3: []}


def test_integral_of_a_wide_image_is_linear(spark):
    took = {}
    for width in (1000, 50_000, 400_000):
        sizes = spark.createDataFrame([(1, width, 2)], "image_id long, width int, height int")
        table = integral.integral_image(src.generate(sizes, "Mono8", lambda x, y: x % 7), "Mono64")
        began = time.perf_counter()
        last = table.frame.df.select(F.element_at("v", -1).alias("v")).first().v
        took[width] = time.perf_counter() - began
        assert last == 2 * sum(x % 7 for x in range(width))
    assert took[400_000] < 15 + 20 * took[50_000]


def test_integral_of_pixels_agrees_with_that_of_rows(spark):
    rng = random.Random(3)
    frame = src.from_rows(spark, [(0, 4, 3, [(rng.randrange(256),) * 3 for _ in range(12)]), (1, 1, 1, [(1, 2, 3)]), (2, 0, 0, [])], "Rgb8")
    for squared in (False, True):
        whole = (integral.integral_squared_image if squared else integral.integral_image)(frame, "Rgb64").frame.pixels()
        apart = integral.integral_of_pixels(frame.pixels(), frame.images(), "Rgb8", "Rgb64", squared)
        assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(Exception, match="AccumulatorOverflow"):
        integral.integral_of_pixels(spark.createDataFrame([(0, 0, 0, 1)], "image_id long, x int, y int, v int"), spark.createDataFrame([(0, 1 << 20, 1 << 20)], "image_id long, width int, height int"), "Mono8", "Mono32").collect()


def test_large_templates(spark):
    rng = random.Random(6)
    pixels = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(70 * 66)]
    frame = one(spark, pixels, "Rgb8", 70)
    part = [[pixels[(y + 2) * 70 + x + 5][k] for y in range(64) for x in range(64)] for k in range(3)]
    began = time.perf_counter()
    for method, best in ((template.SSD(), 0.0), (template.SAD(), 0.0), (template.NCC(), 1.0)):
        got = template.match_template(frame, template.Template(Size(64, 64), *part), method).df.first()
        assert (got.width, got.height) == (7, 3) and math.isclose(got.v[2 * 7 + 5], best, abs_tol=1e-5)
        assert sum(math.isclose(v, best, abs_tol=1e-5) for v in got.v) == 1
    assert time.perf_counter() - began < 60


def test_a_method_of_ones_own(spark):
    class Largest(template.MatchMethod):
        def score(self, pairs):
            return F.greatest(*(F.abs(i - t) for i, t in pairs))

    got = template.match_template(one(spark, [1, 5, 2, 9], width=2), template.Template(Size(2, 1), [1, 1]), Largest()).df.first()
    assert got.v == [4.0, 8.0]


def _first(folder) -> dict[str, str]:
    """This environment, with a folder in front of Python's path."""
    path = os.pathsep.join(x for x in (str(folder), os.environ.get("PYTHONPATH", "")) if x)
    return {**os.environ, "PYTHONPATH": path, "PYTHONDONTWRITEBYTECODE": "1"}


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_everything_else_runs_without_the_corpus_operators(tmp_path, gone):
    """In a copy without them the entry file imports, lists the raster queries and the rest of the tests passes (a few are run)."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(top, copy, ignore=lambda folder, names: [n for n in names if n in (*gone, ".git", "__pycache__", ".pytest_cache")])
    env = _first(copy)
    listed = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()); print(len(q), any(n.startswith('op') and n[2:3].isdigit() for n in q))"], cwd=copy, env=env, capture_output=True, text=True)
    assert listed.returncode == 0, listed.stderr
    count, corpus = listed.stdout.split()[-2:]
    assert int(count) > 140 and corpus == "False"
    ran = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", "shapes or registry or scalars or every_query or stands_without"], cwd=copy, env=env, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stdout[-2000:]


def test_broken_corpus_operators_are_an_error(tmp_path):
    """Where the corpus operators are there, an import that fails in them is not taken for their absence."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(top, copy, ignore=lambda folder, names: [n for n in names if n in ("tests", ".git", "__pycache__", ".pytest_cache")])
    if not (copy / "rasterloom" / "llm").is_dir():
        pytest.skip("the corpus operators are not installed")
    with open(copy / "rasterloom" / "llm" / "queries.py", "a") as f:
        f.write("\nfrom rasterloom.llm.textcore import no_such_name\n")
    listed = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, env=_first(copy), capture_output=True, text=True)
    assert listed.returncode != 0 and "no_such_name" in listed.stderr


def test_written_tables_leave_no_shuffle_files(spark):
    from rasterloom import storage

    where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(where.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    table = storage.written(spark.range(1000).repartition(4, "id"), "test")
    assert files() <= before and table.count() == 1000 and len(storage.live()) > 0
    assert spark.conf.get(storage._CLEANUP, None) is None
    storage.discard(table)
