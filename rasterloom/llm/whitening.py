"""Whitening of embeddings from exact integer statistics.

Entries become integers, x = floor(64 c) + 1000000. The fit list is each distinct x-vector once. Over it, tasks add up
sums and cross-products of the shifted integers exactly: a batch's products are matrix products of digits small
enough for doubles to hold every partial sum, and what they add to are digit lanes of any length. The driver forms
n XᵀX - S Sᵀ in integers of any size, turns it into floats once, and decomposes it by eigh. All that comes to the driver
is one number for each pair of dimensions.

Defined cases: a null vector, and one with null or non-finite entries, is left out. Vectors of another length than the
commonest (the longest of those, if several are) are left out as well: they have no covariance with the rest. x is held
within 2^63 - 2^21 on either side. Repeated rows each get their result, and count once in the fit list; a null vec_id is
kept as it is. A component without variance (to double precision) has null `whitened` and is left out of
identity_error; without any variance, `explained` is null. No rows, or vectors without entries, give no rows. Other columns
of the table, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.textcore import lean, take
from rasterloom.storage import only, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: x - SHIFT is held within this, so x fits 64 bits.
_MOST = float(2**63 - 2**21)
#: Bits of a digit; with rows of at most _ROWS, sums of products of two digits stay below 2^53.
_DIGIT, _ROWS = 20, 1 << 13
#: Doubles handed on together.
_VALUES = 1 << 18


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all vectors end to end, where each begins, and which are whole: not null, all entries finite."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    whole = np.asarray(column.is_valid()) & (broken[begins[1:]] == broken[begins[:-1]])
    return flat, begins, whole


def _integers(entries: np.ndarray) -> np.ndarray:
    """x - SHIFT of each entry."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * SCALE), -_MOST, _MOST).astype(np.int64)


def _keys(y: np.ndarray) -> list[bytes]:
    """The rows of a matrix as bytes that are equal if and only if the rows are: the width of an entry, then the entries."""
    most = np.maximum(y.max(axis=1, initial=0), -(y.min(axis=1, initial=0) + 1))
    out: list[bytes] = [b""] * len(y)
    below = -1
    for width in (1, 2, 4, 8):
        top = 2 ** (8 * width - 1) - 1
        at = np.flatnonzero((most > below) & (most <= top))
        rows = np.ascontiguousarray(y[at].astype(f"<i{width}")).view(np.uint8).reshape(len(at), width * y.shape[1])
        for k, row in zip(at.tolist(), rows, strict=True):
            out[k] = bytes([width]) + row.tobytes()
        below = top
    return out


def _matrix(keys: list[bytes]) -> np.ndarray:
    """The rows that _keys told, all of one length."""
    return np.stack([np.frombuffer(k, f"<i{k[0]}", offset=1).astype(np.int64) for k in keys])


def _keyed(batches):
    for batch in batches:
        flat, begins, whole = _vectors(take(batch, "embedding"))
        sizes = np.diff(begins)
        keys, lengths = [], []
        for size in np.unique(sizes[whole]).tolist():
            rows = np.flatnonzero(whole & (sizes == size)) if size else np.zeros(0, np.int64)
            step = max(1, _VALUES // max(size, 1))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                keys += _keys(_integers(flat[begins[part][:, None] + np.arange(size)]))
                lengths += [size] * len(part)
        yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(keys, pa.binary())], names=["size", "key"])


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """Balanced digits of integers, least first, as many as the largest needs."""
    half, out = 1 << (_DIGIT - 1), []
    while True:
        low = ((y + half) & ((1 << _DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> _DIGIT
        if not y.any():
            return out


class _Lanes:
    """Exact sums of integers of any size, kept as digits of _DIGIT bits; the last is as large as it must be."""

    def __init__(self, shape: tuple[int, ...]):
        self.lanes = [np.zeros(shape, np.int64)]

    def add(self, k: int, value: np.ndarray) -> None:
        """Adds value * 2^(k * _DIGIT), |value| < 2^53."""
        while len(self.lanes) <= k:
            self.lanes.append(np.zeros_like(self.lanes[0]))
        self.lanes[k] += value.astype(np.int64)
        if np.abs(self.lanes[k]).max(initial=0) >= 1 << 60:
            self._carry(k)

    def _carry(self, k: int) -> None:
        low = self.lanes[k] & ((1 << _DIGIT) - 1)
        carry = (self.lanes[k] - low) >> _DIGIT
        self.lanes[k] = low
        if k + 1 == len(self.lanes):
            self.lanes.append(np.zeros_like(carry))
        self.lanes[k + 1] += carry

    def settled(self) -> list[np.ndarray]:
        """The lanes with every digit carried, so that sums over any number of tasks fit 64 bits."""
        k = 0
        while k < len(self.lanes):
            if np.abs(self.lanes[k]).max(initial=0) >= 1 << _DIGIT:
                self._carry(k)
            k += 1
        return self.lanes


def _accumulated(d: int):
    """(place, lane, value): digit lanes of a task's count, sums and cross-products."""

    def run(batches):
        cross, sums, n = _Lanes((d, d)), _Lanes((d,)), 0
        for batch in batches:
            keys = take(batch, "key").to_pylist()
            step = max(1, min(_ROWS, _VALUES // d))
            for lo in range(0, len(keys), step):
                digits = _digits(_matrix(keys[lo : lo + step]))
                n += len(digits[0])
                for a, left in enumerate(digits):
                    sums.add(a, left.sum(axis=0))
                    for b, right in enumerate(digits):
                        cross.add(a + b, left.T @ right)
        if not n:
            return
        upper = np.triu_indices(d)
        parts = [(0, 0, np.array([n]))]
        parts += [(1, k, lane) for k, lane in enumerate(sums.settled())]
        parts += [(1 + d, k, lane[upper]) for k, lane in enumerate(cross.settled())]
        for first, lane, values in parts:
            at = np.flatnonzero(values)
            for lo in range(0, len(at), _VALUES):
                own = at[lo : lo + _VALUES]
                yield pa.RecordBatch.from_arrays([pa.array((own + first).astype(np.int32)), pa.array(np.full(len(own), lane, np.int32)), pa.array(values[own])], names=["place", "lane", "value"])

    return run


@dataclass(frozen=True)
class Statistics:
    """Of the fit list: its size, the sums S of x, and the matrix n XᵀX - S Sᵀ, in integers of any size."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def fit_list(rows: DataFrame) -> DataFrame:
    """(size, key, copies): each distinct x-vector of `rows` once, equal rows counted before they are shuffled."""
    kind = rows.schema["embedding"].dataType
    vectors = rows.select("embedding" if kind in (T.ArrayType(T.FloatType()), T.ArrayType(T.DoubleType())) else F.col("embedding").cast("array<double>").alias("embedding"))
    return vectors.mapInArrow(lean(_keyed), "size int, key binary").groupBy("size", "key").agg(F.count("*").alias("copies"))


def dimension(fit: DataFrame) -> int:
    """The commonest length of a vector, of several the longest; 0 where there is none."""
    found = fit.groupBy("size").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).first()
    return found["size"] if found else 0


def statistics(fit: DataFrame, d: int) -> Statistics:
    """Exact sums and scatter of the fit list's vectors of length d."""
    lanes = fit.filter(F.col("size") == d).select("key").mapInArrow(lean(_accumulated(d)), "place int, lane int, value long")
    found = lanes.groupBy("place", "lane").agg(F.sum("value").alias("value")).toArrow()
    totals = [0] * (1 + d + d * (d + 1) // 2)
    for place, lane, value in zip(*(found.column(k).to_pylist() for k in ("place", "lane", "value")), strict=True):
        totals[place] += value << (lane * _DIGIT)
    n, sums = totals[0], totals[1 : 1 + d]
    scatter = np.zeros((d, d), dtype=object)
    for i, j, p in zip(*np.triu_indices(d), totals[1 + d :], strict=True):
        scatter[i, j] = scatter[j, i] = n * p - sums[i] * sums[j]
    return Statistics(n, [s + n * SHIFT for s in sums], scatter)


@dataclass(frozen=True)
class Whitening:
    """The decomposition: eigenvalues by falling size (0 without variance), unit eigenvectors as columns, and each one's share."""

    fitted: Statistics
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, fitted: Statistics, components: int = COMPONENTS) -> Whitening:
        n, d = fitted.n, fitted.dimensions
        covariance = np.array([[c / (n * n) for c in row] for row in fitted.scatter.tolist()], dtype=np.float64)
        trace = sum(fitted.scatter[i, i] for i in range(d))
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        vectors = vectors[:, order]
        shares = [_rayleigh(fitted.scatter, vectors[:, k], trace) for k in range(len(order))]
        least = 4 * d * np.finfo(np.float64).eps
        shares = np.array([s if s > least else 0.0 for s in shares])
        return cls(fitted, shares * (trace / (n * n)), vectors, shares if trace else np.full(len(order), np.nan))

    def centred(self, y: np.ndarray) -> np.ndarray:
        """x - S/n of shifted integers: the mean's whole part goes as an integer, so nothing is lost to its size."""
        base = [s - self.fitted.n * SHIFT for s in self.fitted.sums]
        whole = np.array([b // self.fitted.n for b in base], dtype=object)
        rest = np.array([(b % self.fitted.n) / self.fitted.n for b in base])
        near = int(np.abs(y).max(initial=0)) + max(map(abs, whole.tolist()), default=0) < 2**63
        return (y - whole.astype(np.int64)).astype(np.float64) - rest if near else (y.astype(object) - whole).astype(np.float64) - rest

    def deviations(self, y: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2, exact."""
        n, base = self.fitted.n, [s - self.fitted.n * SHIFT for s in self.fitted.sums]
        most = n * int(np.abs(y).max(initial=0)) + max(map(abs, base), default=0)
        if most * most * max(len(base), 1) < 2**63:
            apart = y * n - np.array(base, dtype=np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = y.astype(object) * n - np.array(base, dtype=object)
        return (apart * apart).sum(axis=1).tolist()

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Projections over the root of each eigenvalue; NaN for components without variance."""
        with np.errstate(all="ignore"):
            return np.where(self.values > 0, (self.centred(y) @ self.vectors) / np.sqrt(self.values), np.nan)


def _rayleigh(scatter: np.ndarray, vector: np.ndarray, trace: int) -> float:
    """qᵀ M q / (qᵀ q trace M) with the integers of M and the digits of q as they are, so that nothing cancels."""
    if not trace:
        return 0.0
    q = np.array([int(v * 2.0**60) for v in vector.tolist()], dtype=object)
    norm = int(q @ q)
    return max(0.0, int(q @ (scatter @ q)) / (norm * trace))


_MOMENTS = "n long, mean array<double>, spread array<double>"


def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and centred products of parts as those of all."""
    n, mean, spread = parts[0]
    for m, other, more in parts[1:]:
        gap, total = other - mean, n + m
        spread, mean, n = spread + more + np.outer(gap, gap) * (n * m / total), mean + gap * (m / total), total
    return n, mean, spread


def _told(parts: list[tuple[int, np.ndarray, np.ndarray]]):
    if parts:
        n, mean, spread = _merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([spread.ravel().tolist()])], names=["n", "mean", "spread"])


def _moments(w: Whitening):
    def run(batches):
        parts = []
        for batch in batches:
            keys = take(batch, "key").to_pylist()
            step = max(1, _VALUES // w.fitted.dimensions)
            for lo in range(0, len(keys), step):
                own = w.whitened(_matrix(keys[lo : lo + step]))[:, w.values > 0]
                mean = own.mean(axis=0)
                parts = [_merged([*parts, (len(own), mean, (own - mean).T @ (own - mean))])]
        yield from _told(parts)

    return run


def _gather(side: int):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            yield from _told([(n, np.array(m), np.array(s).reshape(side, side)) for n, m, s in rows])

    return run


def identity_error(fit: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of (covariance of the whitened fit list - identity), over components with variance."""
    side = int((w.values > 0).sum())
    if not side:
        return None
    parts = fit.filter(F.col("size") == w.fitted.dimensions).select("key").mapInArrow(lean(_moments(w)), _MOMENTS)
    few = parts.repartition(16).mapInArrow(_gather(side), _MOMENTS).collect()
    n, _, spread = _merged([(r["n"], np.array(r["mean"]), np.array(r["spread"]).reshape(side, side)) for r in few])
    return float(np.abs(spread / n - np.eye(side)).max())


def _applied(w: Whitening, error: float | None):
    count = len(w.values)

    def run(batches):
        for batch in batches:
            flat, begins, whole = _vectors(take(batch, "embedding"))
            rows = np.flatnonzero(whole & (np.diff(begins) == w.fitted.dimensions))
            step = max(1, _VALUES // (w.fitted.dimensions + count))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                y = _integers(flat[begins[part][:, None] + np.arange(w.fitted.dimensions)])
                deviations = [v if v < 10**38 else None for v in w.deviations(y)]
                each = np.repeat(np.arange(len(part)), count)
                n = len(each)
                yield pa.RecordBatch.from_arrays(
                    [
                        take(batch, "vec_id").take(pa.array(part)).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(n, w.fitted.n, np.int64)),
                        pa.array(deviations, pa.decimal128(38, 0)).take(pa.array(each)),
                        pa.array(w.whitened(y).ravel(), from_pandas=True),
                        pa.array(np.tile(w.explained, len(part)), from_pandas=True),
                        pa.array([error], pa.float64()).take(pa.array(np.zeros(n, np.int64))),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector of `embeddings` (vec_id, embedding) and component, numbered from 1 by falling eigenvalue.

    Columns: vec_id, component, n, deviation (decimal; null where it has over 38 digits), whitened, explained, identity_error.
    """
    spark, rows = embeddings.sparkSession, embeddings.select("vec_id", "embedding")
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    with only(spark):
        fit = written(fit_list(rows), "fit")
        d = dimension(fit)
        if not d:
            return spark.createDataFrame([], schema)
        w = Whitening.of(statistics(fit, d), components)
        error = identity_error(fit, w)
    kind = rows.schema["embedding"].dataType
    if kind not in (T.ArrayType(T.FloatType()), T.ArrayType(T.DoubleType())):
        rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(lean(_applied(w, error)), schema)


def scatter_rows(embeddings: DataFrame) -> DataFrame:
    """The exact statistics as rows (i, j, n, sum_i, sum_j, scatter), i <= j, integers as decimal text."""
    spark = embeddings.sparkSession
    schema = "i int, j int, n long, sum_i string, sum_j string, scatter string"
    with only(spark):
        fit = written(fit_list(embeddings.select("embedding")), "fit")
        d = dimension(fit)
        found = statistics(fit, d) if d else Statistics(0, [], np.zeros((0, 0), dtype=object))
    rows = [(i, j, found.n, str(found.sums[i]), str(found.sums[j]), str(found.scatter[i, j])) for i in range(d) for j in range(i, d)]
    return spark.createDataFrame(rows, schema)
