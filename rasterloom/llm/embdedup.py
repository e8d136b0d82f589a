"""Near duplicates among embeddings: learned binary codes, multi-index Hamming tables, and the vectors themselves.

On a bounded sample, principal axes and an iteratively learned rotation (ITQ) make bits that split the vectors evenly
and lose little; several rotations, each begun elsewhere, make as many bits as wanted. A code is cut into substrings, each the key of a
table. Two vectors whose codes differ in fewer bits than there are tables share a substring, so one table at least brings
them together, and most pairs with more differences meet as well: at the threshold two bits of a pair differ with
probability arccos(threshold) / pi where they lie evenly, from which the least number of tables follows (`MISSED` at the threshold, less above); tables
are added until the sample meets neighbours at the threshold as often. Substrings grow with the logarithm of the number of
vectors, so buckets stay small. Vectors that meet are compared as they are, in double precision, by
blocks; a pair that meets again in a later table counts in the first. What leaves a block is a count for each vector
and a forest of links, never a pair for each link. A crowded bucket is cut into blocks, each pair of which is a
group of its own.

Equal vectors are one vector with a number of copies from the start, so copies make no pairs.

Defined cases: a vector that is null, zero, without entries, or holds null or non-finite entries links with nothing (n_links 0, its own
component), and so does a row whose vec_id is null (component null, kept). Vectors of different lengths are never linked; each
length has codes of its own. Rows are vectors: rows that repeat a vec_id count as links of one another if their vectors do,
and get the same component. No rows give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.joins import lookup, small
from rasterloom.llm.components import components
from rasterloom.llm.textcore import lean, take
from rasterloom.storage import discard, only, written

THRESHOLD = 0.95
#: Share of pairs right at the threshold that no table may bring together.
MISSED = 0.01
#: Vectors of a bucket, on average, from which the length of substrings follows.
BUCKET = 256
#: Vectors of a block, and bytes of its entries at most.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: The sample that rotations are learned on: vectors, and entries, at most; and the steps of learning.
SAMPLE, SAMPLE_ENTRIES, STEPS = 16_384, 1 << 22, 30
#: Bits of a rotation at most.
BITS = 64
#: Tables that are shuffled together.
TOGETHER = 2


def _doubles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all vectors end to end (null ones as NaN), and where each vector begins."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False), np.concatenate([[0], np.cumsum(sizes)])


def _digested(batches):
    """The rows with the SHA-256 of each vector, negative zeros made positive; null where a row can't link."""
    for batch in batches:
        column = take(batch, "embedding")
        flat, begins = _doubles(column)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        some = np.concatenate([[0], np.cumsum(flat != 0)])
        good = np.asarray(column.is_valid()) & np.asarray(take(batch, "vec_id").is_valid()) & (bad[begins[1:]] == bad[begins[:-1]]) & (some[begins[1:]] > some[begins[:-1]])
        flat = flat + 0.0
        digests = [hashlib.sha256(flat[begins[k] : begins[k + 1]].tobytes()).digest() if ok else None for k, ok in enumerate(good.tolist())]
        yield pa.RecordBatch.from_arrays([take(batch, "vec_id"), pa.array(digests, pa.binary()), column], names=["vec_id", "digest", "embedding"])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows by their length; the largest entry goes first, so that no square is lost."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def learned_rotation(sample: np.ndarray, bits: int, number: int) -> np.ndarray:
    """Iterative quantisation: principal axes of the sample, then the rotation that brings it closest to its own signs.

    Each begins with a random rotation of its own; the higher its number the fewer the steps, so that they do not all end alike.
    """
    values, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, np.argsort(-values)[:bits]]
    projected = sample @ axes
    rotation = np.linalg.qr(np.random.default_rng(number).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(STEPS // (number + 1)):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ signs)
        rotation = left @ right
    return axes @ rotation


def _neighbours(units: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector one at exactly the threshold from it, in a random direction."""
    aside = np.random.default_rng(0).normal(size=units.shape)
    aside -= (units * aside).sum(axis=1, keepdims=True) * units
    length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    return threshold * units + math.sqrt(1 - threshold**2) * aside / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class Coder:
    """The origin and the projection whose signs are the code, and the cut into `tables` substrings of `width` bits."""

    origin: np.ndarray
    projection: np.ndarray
    width: int
    tables: int

    @classmethod
    def fit(cls, sample: np.ndarray, count: int, threshold: float = THRESHOLD) -> Coder:
        """Tables are added until all but MISSED (by half, for the sample's error) of the sample's vectors meet a neighbour at the threshold.

        Vectors are centred by their mean, which balances the bits. Where they lie so close to it that neighbours would need over twice
        the tables, the planes go through the origin instead.
        """
        width, least = layout(count, threshold)
        units = _unit(sample)
        some = units[:4096]
        near = _neighbours(some, threshold)
        for origin, most in ((units.mean(axis=0), 2 * least), (np.zeros(units.shape[1]), None)):
            parts, tables = [], least
            while most is None or tables <= most:
                while sum(p.shape[1] for p in parts) < width * tables:
                    parts.append(learned_rotation(units - origin, min(BITS, units.shape[1]), len(parts)))
                coder = cls(origin, np.concatenate(parts, axis=1)[:, : width * tables], width, tables)
                if (coder.keys(some) == coder.keys(near)).any(axis=1).mean() >= 1 - 1.5 * MISSED:
                    return coder
                tables += max(1, least // 4)
        raise AssertionError("random planes through the origin end the loop")

    def keys(self, units: np.ndarray) -> np.ndarray:
        """Each row's substrings as integers."""
        bits = ((units - self.origin) @ self.projection >= 0).reshape(len(units), self.tables, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64))


def layout(count: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Width of substrings and least number of tables for so many vectors: at least BITS bits in all."""
    width = min(32, max(4, math.ceil(math.log2(max(count, 1) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** width
    return width, max(math.ceil(math.log(MISSED) / math.log1p(-meet)), BITS // width)


def _coded(coder: Coder):
    def run(batches):
        for batch in batches:
            flat, _ = _doubles(take(batch, "embedding"))
            keys = coder.keys(_unit(flat.reshape(batch.num_rows, -1))) if batch.num_rows else np.zeros((0, coder.tables), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * coder.tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([take(batch, "rep"), take(batch, "copies"), take(batch, "embedding"), lists], names=["rep", "copies", "embedding", "keys"])

    return run


@dataclass
class _Side:
    """Vectors of a block."""

    rep: np.ndarray
    copies: np.ndarray
    units: np.ndarray
    keys: np.ndarray


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n nodes that each reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]


def _linked(one: _Side, two: _Side | None, table: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rep, links, root) of the vectors of a block, or of two, that link: pairs that no table before this one brings together."""
    other = one if two is None else two
    a, b = np.nonzero(one.units @ other.units.T >= threshold)
    if two is None:
        a, b = a[a < b], b[a < b]
    early = np.zeros(len(a), bool)
    for t in range(table):
        early |= one.keys[a, t] == other.keys[b, t]
    a, b = a[~early], b[~early]
    if not len(a):
        return
    shift = 0 if two is None else len(one.rep)
    rep = one.rep if two is None else np.concatenate([one.rep, two.rep])
    links = np.bincount(a, other.copies[b], len(rep)) + np.bincount(b + shift, one.copies[a], len(rep))
    root = _roots(len(rep), a, b + shift)
    at = np.flatnonzero(links)
    yield rep[at], links[at].astype(np.int64), rep[root[at]]


def _compared(coder: Coder, threshold: float):
    """Groups of rows that come sorted by (table, bucket, i, j, side)."""
    names = ["table", "bucket", "i", "j", "side"]

    def side(rows: list[pa.RecordBatch]) -> _Side:
        whole = pa.Table.from_batches(rows).combine_chunks()
        flat = whole["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        keys = whole["keys"].combine_chunks().flatten().to_numpy().reshape(len(whole), coder.tables)
        return _Side(whole["rep"].to_numpy(), whole["copies"].to_numpy(), _unit(flat.reshape(len(whole), -1)), keys)

    def done(held: list[tuple[int, list[pa.RecordBatch]]], table: int, cross: bool):
        sides = [side(rows) for _, rows in held]
        if cross and len(sides) == 2:
            yield from _linked(*sides, table, threshold)
        elif not cross and len(sides[0].rep) > 1:
            yield from _linked(sides[0], None, table, threshold)

    def told(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) if found else pa.array([], pa.int64()) for k in range(3)], names=["rep", "links", "root"])

    def run(batches):
        group, held, found, size = None, [], [], 0
        for batch in batches:
            columns = [np.asarray(take(batch, c)) for c in names]
            if not batch.num_rows:
                continue
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                own, at = tuple(int(c[lo]) for c in columns[:4]), int(columns[4][lo])
                if own != group:
                    if held:
                        found += done(held, group[0], group[2] != group[3])
                    group, held = own, []
                if not held or held[-1][0] != at:
                    held.append((at, []))
                held[-1][1].append(batch.slice(lo, hi - lo))
            size = sum(len(f[0]) for f in found)
            if size > 10_000:
                yield told(found)
                found = []
        if held:
            found += done(held, group[0], group[2] != group[3])
        yield told(found)

    return run


def _sample(vectors: DataFrame, count: int, size: int) -> np.ndarray:
    """At most SAMPLE vectors and SAMPLE_ENTRIES entries, chosen by their digests."""
    wanted = max(2, min(SAMPLE, SAMPLE_ENTRIES // size))
    share = min(1.0, 2 * wanted / count)
    some = vectors.filter(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("embedding").limit(wanted)
    rows = some.toArrow()["embedding"].combine_chunks()
    flat, _ = _doubles(rows if isinstance(rows, pa.Array) else rows.combine_chunks())
    return flat.reshape(-1, size)


def _tables(coded: DataFrame, coder: Coder, size: int, threshold: float) -> Iterator[DataFrame]:
    """(rep, links, root) from TOGETHER tables at a time, each written before the next is shuffled."""
    block = max(16, min(BLOCK, BLOCK_BYTES // (8 * size)))
    for lo in range(0, coder.tables, TOGETHER):
        own = [F.struct(F.lit(t).alias("table"), F.col("keys")[t].alias("bucket")) for t in range(lo, min(lo + TOGETHER, coder.tables))]
        keyed = coded.select("*", F.inline(F.array(*own)))
        counts = coded.select(F.inline(F.array(*own))).groupBy("table", "bucket").count()
        crowded = written(counts.filter(F.col("count") > block).select("table", "bucket", F.ceil(F.col("count") / block).cast("int").alias("n")), "crowded")
        cut = keyed.join(small(crowded), ["table", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
        mine = F.pmod(F.xxhash64("rep"), F.col("n")).cast("int").alias("mine")
        pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
        dealt = cut.select("*", mine).select("table", "bucket", "rep", "copies", "embedding", "keys", "mine", F.inline(pair))
        sided = dealt.withColumn("side", (F.col("mine") != F.col("i")).cast("int")).drop("mine")
        group = ["table", "bucket", "i", "j"]
        rows = sided.repartition(*group).sortWithinPartitions(*group, "side")
        yield written(rows.mapInArrow(lean(_compared(coder, threshold)), "rep long, links long, root long"), "links")
        discard(crowded)


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, list[DataFrame]]:
    """From distinct vectors (digest, rep, copies, embedding): tables of (rep, links, root), for every length of vector in turn."""
    found: list[DataFrame] = []
    sizes = vectors.groupBy(F.size("embedding").alias("size")).count().filter("count > 1").orderBy("size").toLocalIterator()
    for size, count in sizes:
        own = vectors.filter(F.size("embedding") == size)
        coder = Coder.fit(_sample(own, count, size), count, threshold)
        kind = vectors.schema["embedding"].dataType.simpleString()
        coded = written(own.select("rep", "copies", "embedding").mapInArrow(lean(_coded(coder)), f"rep long, copies long, embedding {kind}, keys array<long>"), "coded")
        found += _tables(coded, coder, size, threshold)
        discard(coded)
    return found


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each vector of `embeddings` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if rows.schema["embedding"].dataType not in (T.ArrayType(T.FloatType()), T.ArrayType(T.DoubleType())):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = rows.schema["embedding"].dataType.simpleString()
    with only(spark) as results:
        told = rows.mapInArrow(lean(_digested), f"vec_id long, digest binary, embedding {kind}")
        classes = written(told.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vectors")
        found = linked(classes, threshold)
        every = spark.createDataFrame([], "rep long, links long, root long")
        for more in found:
            every = every.union(more)
        links = every.groupBy("rep").agg(F.sum("links").alias("links"))
        joined = components(every.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
        # several vectors may share a vec_id, so what is said of it holds for all of them
        judged = classes.select("digest", "rep", "copies").join(links, "rep", "left").join(joined, "rep", "left")
        verdicts = written(judged.select("digest", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "verdicts")
        ids = written(told.select("vec_id", "digest"), "ids")
        known = lookup(ids.filter("digest is not null"), verdicts, ["digest"], "copies", ids.count()).select("vec_id", "n_links", "component_id")
        alone = ids.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = written(known.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "near")
        results.append(out)
    return out
