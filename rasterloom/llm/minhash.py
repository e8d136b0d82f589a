"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, star-shaped candidate edges.

1. A text's set is its distinct 5-word shingles. Texts with equal sets form a class; the class's smallest
   doc_id stands for it from here on, so groups of exact copies cost one row each.
2. One permutation: a shingle hash's top 7 bits name a bin and a bin keeps its least hash. Empty bins copy
   the bin that a fixed random probe sequence of their own number reaches first (optimal densification).
3. 32 bands of 4 bins name buckets. A bucket's members are joined to its smallest doc_id alone, its centre (a
   star), n - 1 edges for n members; each distinct edge is confirmed on the full sets.
4. A star misses a link between two members that both differ from the centre. So the members of each centre,
   whatever buckets they share with it, form a group, and groups that still hold several components are worked
   through: their members outside the centre's component meet all members in blocks of bounded size, and are
   compared there on their full sets, a pair in one group alone. A block tells a link only where it joins
   two components that it has not joined before, so it gives fewer rows than it has members, however many
   pairs it holds. With that, every pair that shares a bucket is linked, in one component, or refuted.

A pair is refuted by one bit for each of a set's shingles where these prove enough of them absent from the other
set, and by the sets themselves otherwise: both are exact.

At similarity 0.85 two texts share no bucket with probability (1 - 0.85^4)^32 < 1e-10 (at 0.8: 5e-8), if bins
were independent.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing;
fewer words than a shingle make one shingle of the whole sequence; very long texts have all their shingles; rows
without doc_id are linked with nothing and have a null component; rows of one doc_id are one node; bytes that are not
UTF-8 are compared as they are; an empty table gives no rows; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.components import components
from rasterloom.llm.textcore import SPACED_FOLDED, U64, Words, as_signed, chunks, lean, mix64, stream, take
from rasterloom.storage import discard, only, written

SHINGLE = 5
BINS, ROWS = 128, 4
#: Members of a group that meet in one block, on either side, and about how many shingles they hold together.
BLOCK, BLOCK_SHINGLES = 16_384, 2_000_000


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's distinct shingles, sorted by row, then hash."""
    at, keys = words.windows(size)
    rows, hashes = [words.row[at]], [keys]
    for n in range(1, size):  # shorter texts: the whole sequence
        short = np.flatnonzero(words.count == n)
        if len(short):
            weights = stream(500 + n, n) | U64(1)
            with np.errstate(over="ignore"):
                total = sum(words.hashes[words.first[short] + k] * weights[k] for k in range(n))
            rows.append(short)
            hashes.append(mix64(total))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def signatures(row: np.ndarray, h: np.ndarray, n_rows: int, bins: int = BINS) -> np.ndarray:
    """One-permutation signatures (n_rows x bins, 32 bits each) of sorted sets; rows without a set stay 0."""
    shift = 64 - int(bins).bit_length() + 1
    out = np.zeros((n_rows, bins), dtype=np.uint32)
    full = np.zeros((n_rows, bins), dtype=bool)
    if not len(h):
        return out
    slot = (h >> U64(shift)).astype(np.int64)
    first = np.ones(len(h), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])
    out[row[first], slot[first]] = (h[first] >> U64(shift - 32)).astype(np.uint32)
    full[row[first], slot[first]] = True
    has = full.any(axis=1)
    r, j = np.nonzero(~full & has[:, None])
    turn = 0
    while len(r):
        with np.errstate(over="ignore"):
            probe = (mix64(j.astype(U64) * U64(0x10001) + U64(turn) * U64(0x9E3779B1)) >> U64(shift)).astype(np.int64)
        hit = full[r, probe]
        out[r[hit], j[hit]] = out[r[hit], probe[hit]]
        r, j, turn = r[~hit], j[~hit], turn + 1
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Each signature's bucket in each band."""
    bands = sig.reshape(len(sig), BINS // ROWS, ROWS).astype(U64)
    with np.errstate(over="ignore"):
        key = np.arange(BINS // ROWS, dtype=U64)[None, :] * U64(0xD6E8FEB86659FD93)
        for k in range(ROWS):
            key = mix64(key ^ bands[:, :, k])
    return key


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], type=pa.binary())


def _sketch(batches):
    for batch in batches:
        ids = take(batch, "doc_id").cast(pa.int64())
        for chunk in chunks(take(batch, "text")):
            words = Words(chunk, SPACED_FOLDED)
            n = len(words.count)
            row, h = shingle_sets(words)
            edges = np.searchsorted(row, np.arange(n + 1))
            lanes = []
            for seed in (1, 2):  # sums of mixed members: independent of order
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(h ^ U64(seed * 0x5851F42D4C957F2D)))])
                    lanes.append(total[edges[1:]] - total[edges[:-1]])
            keys = _packed(band_keys(signatures(row, h, n)))
            yield pa.RecordBatch.from_arrays([ids.slice(chunk.lo, n), pa.array(np.diff(edges)), as_signed(lanes[0]), as_signed(lanes[1]), keys], names=["doc_id", "n", "k1", "k2", "keys"])


def _buckets(batches):
    bands = np.arange(BINS // ROWS, dtype=np.int32)
    for batch in batches:
        docs, keys = np.asarray(take(batch, "doc")), take(batch, "keys")
        if len(docs):
            flat = np.frombuffer(b"".join(keys.to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.tile(bands, len(docs))), pa.array(np.repeat(docs, len(bands)))], names=["bucket", "band", "doc"])


def _sets(batches):
    for batch in batches:
        ids = take(batch, "doc_id").cast(pa.int64())
        for chunk in chunks(take(batch, "text")):
            words = Words(chunk, SPACED_FOLDED)
            row, h = shingle_sets(words)
            edges = np.searchsorted(row, np.arange(len(words.count) + 1))
            blobs = [h[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(chunk.lo, len(blobs)), pa.array(blobs, type=pa.binary())], names=["doc", "members"])


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(take(batch, "x"), take(batch, "y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                if den * min(len(p), len(q)) < num * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([p, q]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([take(batch, "a"), take(batch, "b")], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def candidate_sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, members): the sets of the documents whose doc_id is in `ids`, as sorted 64-bit hashes."""
    sets = documents.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(lean(_sets), "doc long, members binary")
    return written(sets, "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets reach the similarity num / den."""
    left = pairs.join(sets.select(F.col("doc").alias("b"), F.col("members").alias("y")).hint("shuffle_hash"), "b")
    both = left.join(sets.select(F.col("doc").alias("a"), F.col("members").alias("x")).hint("shuffle_hash"), "a")
    return written(both.select("a", "b", "x", "y").mapInArrow(lean(_confirm(num, den)), "a long, b long").distinct(), "links")


def _short(batches):
    """Sets with their sizes and a key for each band: with `seats` the centre of the bucket they are in there (alone there, the set itself), else the bucket."""
    for batch in batches:
        docs, blobs = np.asarray(take(batch, "doc")), take(batch, "members")
        sizes = np.asarray(pa.compute.binary_length(blobs)).astype(np.int64) // 8
        if "seats" in batch.schema.names:
            seats = take(batch, "seats")
            keys = np.repeat(docs[:, None], BINS // ROWS, axis=1)
            n, flat = np.asarray(pa.compute.list_value_length(seats)), seats.flatten()
            keys[np.repeat(np.arange(len(docs)), n), np.asarray(flat.field("band"))] = np.asarray(flat.field("centre"))
        else:
            members = np.frombuffer(b"".join(blobs.to_pylist()), dtype=U64)
            keys = band_keys(signatures(np.repeat(np.arange(len(docs)), sizes), members, len(docs)))
        yield pa.RecordBatch.from_arrays([take(batch, "doc"), pa.array(sizes), blobs, _packed(keys)], names=["doc", "n", "members", "keys"])


def _signs(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One bit for each shingle of a set, some falling together: rows of 64-bit words, wide enough for most sets here."""
    width = 1 << int(np.clip(np.ceil(np.log2(max(8 * float(np.median(n)), 1))), 9, 13))
    rows, out = max(1, (1 << 22) // width), []
    before = np.concatenate([[0], np.cumsum(n)])
    for a in range(0, len(n), rows):
        z = min(a + rows, len(n))
        marks = np.zeros((z - a, width), dtype=bool)
        marks[np.repeat(np.arange(z - a), n[a:z]), (values[before[a] : before[z]] & U64(width - 1)).astype(np.int64)] = True
        out.append(np.packbits(marks, axis=1).view(U64))
    return np.concatenate(out)


def _places(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of runs of `sizes` from `starts`, end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def join_block(values: np.ndarray, n: np.ndarray, comp: np.ndarray, mine: np.ndarray, theirs: np.ndarray, meet, num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j) of `mine` to `theirs` at the threshold, a spanning forest of the components that they join.

    Row k of `values` has the n[k] members of set k, one row after the other; meet(i, rows) picks the rows to compare i with.
    """
    first, signs = np.cumsum(n) - n, _signs(values, n)
    root = np.unique(comp, return_inverse=True)[1]
    number, held, out = None, None, []
    for i in mine:
        near = theirs[(root[theirs] != root[i]) & (den * np.minimum(n[theirs], n[i]) >= num * np.maximum(n[theirs], n[i]))]
        if not len(near):
            continue
        # a bit of one set that the other lacks stands for a shingle or more that it lacks
        most = np.minimum(n[i] - np.bitwise_count(signs[i] & ~signs[near]).sum(axis=1, dtype=np.int64), n[near] - np.bitwise_count(signs[near] & ~signs[i]).sum(axis=1, dtype=np.int64))
        near = near[den * most >= num * (n[near] + n[i] - most)]
        near = meet(i, near) if len(near) else near
        if not len(near):
            continue
        if number is None:
            number = np.unique(values, return_inverse=True)[1]
            held = np.zeros(int(number.max(initial=0)) + 1, dtype=bool)
        own = number[first[i] : first[i] + n[i]]
        held[own] = True
        size = n[near]
        shared = np.add.reduceat(held[number[_places(size, first[near])]], np.cumsum(size) - size, dtype=np.int64)
        held[own] = False
        good = near[den * shared >= num * (size + n[i] - shared)]
        for r, j in zip(*np.unique(root[good], return_index=True), strict=True):
            out.append((int(i), int(good[j])))
            root[root == r] = root[i]
    return out


def _block_pairs(num: int, den: int):
    """(a, b): components that a link joins, within each (bucket, block, block) group; rows arrive sorted by it.

    A pair is compared once, in the group that the first of the keys which it shares names.
    """

    def judge(rows: pa.Table):
        left = np.asarray(rows.column("outside").combine_chunks())
        comp, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("comp", "n"))
        values = np.frombuffer(b"".join(rows.column("members").to_pylist()), dtype=U64)
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), dtype=np.int64).reshape(len(n), BINS // ROWS)
        bucket = rows.column("bucket")[0].as_py()

        def meet(i, near):
            return near[keys[i][(keys[near] == keys[i]).argmax(axis=1)] == bucket]

        links = np.array(join_block(values, n, comp, np.flatnonzero(left), np.flatnonzero(~left), meet, num, den), dtype=np.int64).reshape(-1, 2)
        ends = np.sort(comp[links], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            keys = [np.asarray(take(batch, c)) for c in ("bucket", "p", "q")]
            cuts = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1
            for a, z in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]) if batch.num_rows else ():
                group = tuple(k[a] for k in keys)
                if held and group != now:
                    yield judge(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, z - a))
                now = group
        if held:
            yield judge(pa.Table.from_batches(held))

    return run


def _leftover_links(sets: DataFrame, seats: DataFrame, star: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): components that links between members of one group join, besides those that a star has refuted."""
    known = star.union(star.select("a", F.col("a").alias("b")).distinct()).join(comp, F.col("b") == F.col("node"), "left")
    known = known.select(F.col("a").alias("bucket"), F.col("b").alias("doc"), F.coalesce("component", "b").alias("comp"))
    centre = F.max(F.when(F.col("bucket") == F.col("doc"), F.col("comp"))).alias("centre_comp")
    # a group of two members was settled by its star
    mixed = known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), centre).filter("lo < hi and m > 2")
    members = written(known.join(mixed.select("bucket", "centre_comp").hint("shuffle_hash"), "bucket").select("bucket", "doc", "comp", (F.col("comp") != F.col("centre_comp")).alias("away")), "mixed")
    if members.isEmpty():
        discard(members)
        return members.select(F.col("doc").alias("a"), F.col("comp").alias("b")).limit(0)
    lengths = sets.select("doc", (F.octet_length("members") / 8).cast("long").alias("n"))
    sized = members.join(lengths.hint("shuffle_hash"), "doc")
    away = lambda x: F.sum(F.when(F.col("away"), x).otherwise(0))
    sizes = sized.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("m_n"), away(1).alias("s"), away(F.col("n")).alias("s_n"))
    blocks = lambda n: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(n + "_n") / BLOCK_SHINGLES)).cast("int")
    counted = written(sized.join(sizes.hint("shuffle_hash"), "bucket").select("bucket", "doc", "comp", "away", blocks("s").alias("ps"), blocks("m").alias("qs")), "blocks")
    needed = members.select("doc").distinct()
    whole = sets.join(seats.join(needed, "doc", "left_semi").hint("shuffle_hash"), "doc").mapInArrow(lean(_short), "doc long, n long, members binary, keys binary")
    full = counted.join(whole, "doc").select("bucket", "doc", "comp", "away", "n", "members", "keys", "ps", "qs")
    p, q = F.pmod(F.xxhash64("doc", F.lit(1)), "ps").cast("int"), F.pmod(F.xxhash64("doc", F.lit(2)), "qs").cast("int")
    inside = full.select("bucket", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), q.alias("q"), F.lit(False).alias("outside"), "doc", "comp", "n", "members", "keys")
    outside = full.filter("away").select("bucket", p.alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.lit(True).alias("outside"), "doc", "comp", "n", "members", "keys")
    grouped = inside.union(outside).repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    links = written(grouped.mapInArrow(lean(_block_pairs(num, den)), "a long, b long").distinct(), "joined")
    discard(members, counted)
    return links


def near_duplicates(documents: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `documents`."""
    spark = documents.sparkSession
    sketch = written(documents.select("doc_id", "text").mapInArrow(lean(_sketch), "doc_id long, n long, k1 long, k2 long, keys binary"), "sketches")
    with only(spark) as results:
        some = sketch.filter("n > 0 and doc_id is not null")
        reps = written(some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "keys")).alias("m")).select("k1", "k2", F.col("m.doc_id").alias("doc"), F.col("m.keys").alias("keys")), "classes")
        entries = reps.select("doc", "keys").mapInArrow(lean(_buckets), "bucket long, band int, doc long")
        centres = entries.groupBy("bucket").agg(F.min("doc").alias("centre"), F.max("doc").alias("last")).filter("centre < last").select("bucket", "centre")
        seated = entries.join(centres.hint("shuffle_hash"), "bucket").groupBy("doc").agg(F.collect_list(F.struct("band", "centre")).alias("seats"))
        seats = written(seated, "seats")  # at most one for each band
        star = seats.select(F.explode(F.array_distinct(F.col("seats.centre"))).alias("a"), F.col("doc").alias("b")).filter("a <> b")
        # whoever shares a bucket has a seat, so these sets serve both confirmations
        sets = candidate_sets(documents, seats.select(F.col("doc").alias("doc_id")))
        comp = written(components(confirmed(star, sets, num, den)), "components")
        more = components(_leftover_links(sets, seats, star, comp, num, den)).select(F.col("node").alias("inner"), F.col("component").alias("outer"))
        one = reps.select("k1", "k2", "doc").join(comp, F.col("doc") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "doc").alias("inner"))
        classes = written(one.join(more, "inner", "left").select("k1", "k2", F.coalesce("outer", "inner").alias("c")), "classes")
        results.append(classes)
    # rows without a set are in no class; their keys are spread, so that no task gets them all
    second = F.when(F.col("n") == 0, F.xxhash64("doc_id")).otherwise(F.col("k2")).alias("k2")
    rows = sketch.select("doc_id", F.col("n").alias("n_shingles"), "k1", second).join(classes, ["k1", "k2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("c"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """`documents` with one document of each group of near duplicates, the one with the smallest doc_id."""
    gone = near_duplicates(documents, num, den).filter(~F.col("kept")).select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
