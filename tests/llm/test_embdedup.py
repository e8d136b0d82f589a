"""op11 against all pairs."""

import numpy as np
import pytest

from rasterloom import joins
from rasterloom.llm import embdedup

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, threshold=0.95):
    """Sorted (vec_id, n_links, component_id) of all rows."""
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    for size in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in own])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                links[own[a]].append(own[b])
    low = {k: rows[k][0] for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for k, near in links.items():
            least = min([low[k], *(low[j] for j in near)]) if near else low[k]
            if least != low[k]:
                low[k], changed = least, True
    return sorted(((rows[k][0], len(links[k]), low[k]) for k in range(len(rows))), key=repr)


def found(spark, rows, schema=SCHEMA):
    got = embdedup.near_duplicates(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    out = got.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr)


def family(rng, n, d, noise):
    base = rng.normal(size=d)
    return base / np.linalg.norm(base) + rng.normal(size=(n, d)) * noise / np.sqrt(d)


def test_families_copies_and_broken_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [*rng.normal(size=(150, 24)), *family(rng, 40, 24, 0.15), *family(rng, 25, 24, 0.2)]
    rows = [(1000 - k, [float(c) for c in v]) for k, v in enumerate(vectors)]
    rows += [(2000 + k, rows[160][1]) for k in range(30)] + [(3000, [5 * c for c in rows[3][1]]), (3001, [0.0, *rows[4][1][1:]]), (3002, [-0.0, *rows[4][1][1:]])]
    rows += [(4000, None), (4001, [0.0] * 24), (4002, [None] + [1.0] * 23), (4003, [float("nan")] * 24), (4004, [float("inf")] * 24), (4005, []), (None, rows[3][1])]
    rows += [(5000, [1.0, 0.0]), (5001, [1.0, 0.01]), (5002, [1e-200, 0.0]), (5003, [1e200, 1e190])]
    assert found(spark, rows) == plain(rows)


def test_crowded_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", 16)
    monkeypatch.setattr(joins, "FEW", 3)
    monkeypatch.setattr(joins, "SMALL", 0)
    rng = np.random.default_rng(4)
    vectors = [*family(rng, 120, 16, 0.22), *family(rng, 60, 16, 0.1), *rng.normal(size=(60, 16))]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(vectors)] + [(500 + k, [float(c) for c in vectors[0]]) for k in range(50)]
    assert found(spark, rows) == plain(rows)


def test_recall_right_at_the_threshold():
    """Pairs of random directions at cosine 0.95 to 0.951, and at 0.97, that share a key; the layouts of a thousand to a hundred million vectors."""
    rng = np.random.default_rng(5)
    for count, d in [(1_000, 64), (50_000, 64), (1_000_000, 64), (100_000_000, 64), (1_000_000, 256), (1_000_000, 8)]:
        coder = embdedup.Coder.fit(rng.normal(size=(4000, d)), count)
        for cosine, least in [(0.9505, 0.97), (0.97, 0.99)]:
            x = embdedup._unit(rng.normal(size=(3000, d)))
            y = rng.normal(size=(3000, d))
            y = embdedup._unit(y - (x * y).sum(axis=1, keepdims=True) * x)
            other = cosine * x + np.sqrt(1 - cosine**2) * y
            share = (coder.keys(x) == coder.keys(other)).any(axis=1).mean()
            assert share >= least, (count, d, cosine, share)
        width, least = embdedup.layout(count)
        assert coder.width == width and least <= coder.tables <= 2 * least


def test_recall_where_all_vectors_lie_close_together():
    rng = np.random.default_rng(9)
    for spread in (0.02, 0.3):
        sample = family(rng, 3000, 48, spread)
        coder = embdedup.Coder.fit(sample, 100_000)
        x = embdedup._unit(sample)
        y = embdedup._neighbours(x, 0.952)
        assert (coder.keys(x) == coder.keys(y)).any(axis=1).mean() >= 0.97, spread


def test_recall_over_the_given_vectors(spark):
    """Links found among all pairs of a table with planted families at every distance."""
    rng = np.random.default_rng(6)
    vectors = [v for noise in (0.05, 0.1, 0.15, 0.2, 0.22, 0.25) for _ in range(12) for v in family(rng, 12, 64, noise)]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate([*vectors, *rng.normal(size=(3000, 64))])]
    mine, all_pairs = found(spark, rows, SCHEMA), plain(rows)
    got, true = sum(n for _, n, _ in mine), sum(n for _, n, _ in all_pairs)
    assert all(a[1] <= b[1] for a, b in zip(mine, all_pairs, strict=True)) and true > 3000
    assert got >= 0.98 * true


def test_bits_are_balanced():
    rng = np.random.default_rng(7)
    sample = rng.normal(size=(5000, 32)) * np.linspace(0.2, 2, 32) + 0.3
    coder = embdedup.Coder.fit(sample, 50_000)
    bits = ((embdedup._unit(sample) - coder.origin) @ coder.projection >= 0).mean(axis=0)
    assert (np.abs(bits - 0.5) < 0.1).all()


@pytest.mark.parametrize("kind", ["array<float>", "array<decimal(9,3)>", "array<double>"])
def test_no_rows_and_other_columns(spark, kind):
    empty = spark.createDataFrame([], f"vec_id int, embedding {kind}, rep int, table string, n_links int")
    assert embdedup.near_duplicates(empty).collect() == []
    more = spark.sql(f"select * from values (1, cast(array(1, 2) as {kind}), 7, 'x', 9), (2, cast(array(1, 2) as {kind}), 7, 'x', 9), (3, cast(array(-1, 2) as {kind}), 7, 'x', 9) t(vec_id, embedding, rep, table, n_links)")
    assert sorted(map(tuple, embdedup.near_duplicates(more).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
