"""op12 against integers of any size and a plain decomposition."""

import math

import numpy as np
import pytest

from rasterloom.llm import whitening


def plain(rows):
    """{index: x} of the rows that stay, the fit list and its exact scatter."""
    kept = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept[k] = tuple(math.floor(64 * c) + 1_000_000 for c in v)
    lengths = {}
    for x in kept.values():
        lengths[len(x)] = lengths.get(len(x), 0) + 1
    d = max(lengths, key=lambda n: (lengths[n], n), default=0)
    kept = {k: x for k, x in kept.items() if len(x) == d}
    fit = sorted(set(kept.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    scatter = [[n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return kept, fit, n, sums, scatter


def check(spark, rows, components=16):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept, fit, n, sums, scatter = plain(rows)
    got = whitening.whiten(df.repartition(3), components).collect()
    d = len(sums)
    assert len(got) == len(kept) * min(components, d)
    v = np.array([[c / n**2 for c in r] for r in scatter])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    for k, x in kept.items():
        for c in range(min(components, d)):
            for r in by_id[rows[k][0]][c + 1]:
                assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
                assert math.isclose(r.explained, values[c] / v.trace(), rel_tol=1e-9, abs_tol=1e-12)
                assert r.identity_error < 1e-9
                if r.whitened is None:
                    assert values[c] < 1e-9 * v.trace()
                    continue
                own = np.array([a - s / n for a, s in zip(x, sums, strict=True)]) @ vectors[:, c] / math.sqrt(values[c])
                if abs(own) > 1e-3:
                    signs.setdefault(c, math.copysign(1, own * r.whitened))
                assert math.isclose(r.whitened, own * signs.get(c, 1), rel_tol=1e-6, abs_tol=1e-6)


def test_random_vectors_with_copies_and_broken_rows(spark):
    rng = np.random.default_rng(5)
    scale = np.arange(1, 8)
    rows = [(k, [float(c) for c in rng.normal(size=7) * scale]) for k in range(300)]
    rows += [(1000 + k, rows[7][1]) for k in range(150)] + [rows[3], rows[3]]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 5), (2002, [float("nan")] * 7), (2003, [float("inf")] + [0.0] * 6), (2004, [1.0, 2.0]), (2005, []), (None, rows[9][1])]
    check(spark, rows)
    check(spark, rows, components=3)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(rng.integers(-(2**50), 2**50)), float(rng.integers(-(2**30), 2**30)), float(rng.normal())]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, _, n, sums, scatter = plain(rows)
    got = {(r.i, r.j): r for r in whitening.scatter_rows(df).collect()}
    assert len(got) == 6
    for (i, j), r in got.items():
        assert (r.n, int(r.sum_i), int(r.sum_j), int(r.scatter)) == (n, sums[i], sums[j], scatter[i][j])
    assert {r.deviation is None for r in whitening.whiten(df).collect()} <= {True, False}
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge).count() == 4


@pytest.mark.parametrize("rows", [[(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0, 2.0])]])
def test_without_variance(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 2 * len(rows)
    assert all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in got)


def test_a_dimension_that_repeats_another(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(a), float(a), float(b)]) for k, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    got = [r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert all((r.whitened is None) == (r.component == 3) for r in got) and {r.explained for r in got if r.component == 3} == {0.0}


def test_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, component int, n string, size int")
    assert whitening.whiten(empty).collect() == [] and whitening.scatter_rows(empty).collect() == []
    more = spark.createDataFrame([(0, [1.0], 3, "x", 1), (1, [2.0], 3, "x", 1)], "vec_id long, embedding array<float>, component int, n string, size int")
    assert sorted((r.vec_id, r.component, r.n, round(abs(r.whitened), 6)) for r in whitening.whiten(more).collect()) == [(0, 1, 2, 1.0), (1, 1, 2, 1.0)]
    for kind in ("array<decimal(5,2)>", "array<int>"):
        assert whitening.whiten(more.select("vec_id", more.embedding.cast(kind).alias("embedding"))).count() == 2
