"""Substring dedup with difference-cover anchors, extended and confirmed word by word.

A word is removed where a window of 13 words covers it whose word sequence also starts in a
document with a smaller doc_id. Hashing every window of the corpus and shuffling it would cost
several times the input, so matches are found by anchors and extended:

1. Anchors. D = {0, 1, 3} is a difference cover modulo 7: for any two positions i and j there is a
   shift t < 7 with i + t and j + t both in D modulo 7. Two equal 13-word windows therefore share an
   equal 7-word anchor at such an aligned position (t + 7 <= 13). Hashes at positions in D alone (3 of 7)
   give each anchor's first holder: the smallest doc_id that has it at such a position. A window none of whose
   aligned anchors has a smaller holder stands in no smaller document.
2. Extension. The other windows are chained into runs that share a first holder. A run asks that document, once for
   all that ask alike, for the words around the run's first anchor, and compares them with its own, word by word.
   Windows that agree in all words are removed.
3. The rest. An anchor's first holder need not hold the window: it may stand in a later document, or elsewhere in this one. Windows that
   stay open (few: where a copy was edited, or a passage ends) are looked for in all documents that share an anchor with
   them; windows of their hashes, where a smaller document has one, are grouped by their words themselves.

Hashes choose where to look and never decide: one that clashes costs time and no more.

Anchors travel in blocks: rows of arrays that hold many anchors of one part, which the first bits of their hashes name.
A part's holders are counted first, an anchor once for many texts, so a passage that a third of all documents share adds little; its places
then stream past the part's shared anchors. Words asked for by very many documents are spread over as many tasks as their number needs.
The other joins back are equi-joins whose small side has one row a key, which adaptive execution splits where a key is hot.

Edge cases: a null or empty text has no words, nothing is removed and the kept text is empty; rows of
one doc_id never remove each other (the smaller doc_id must be strictly smaller), so repeated rows
come out alike; where a doc_id stands in several rows, different texts have different marks; a null doc_id
is never smaller and never larger than another, so such rows neither remove nor lose words; very long texts are read
whole; bytes that are not UTF-8 are compared as they are (and become U+FFFD in kept_text alone); an empty table gives no
rows; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.joins import lookup
from rasterloom.llm.textcore import SPACED, Chunk, Words, as_signed, chunks, covered, lean, mix64, take
from rasterloom.storage import discard, only, written

WINDOW = 13
PERIOD, COVER, ANCHOR = 7, (0, 1, 3), 7
#: Words that a request brings at most, as a multiple of the window, and rows that get one answer from one task.
_REACH, _ASKERS = 16, 4096
#: Anchors keep this many of their 64 bits; as many of these name the part in which an anchor's holders meet.
ANCHOR_BITS, _PART_BITS = 48, 12
#: Anchors that are put in order at a time, and anchors of a row at most.
_MANY, _BLOCK = 1 << 19, 1024
_NONE = np.iinfo(np.int64).min
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Masks of the lowest 0 to 8 bytes of eight.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _words(chunk: Chunk) -> Words:
    """A chunk's words, hashed eight bytes at a time; those of over 64 bytes by a digest."""
    words = Words(chunk, SPACED, hashed=False)
    data = np.append(chunk.data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(chunk.data) + 1,), np.dtype("<u8"), data, strides=(1,))  # from each byte on
    left = words.ends - words.starts
    hashes, at = left.astype(np.uint64), words.starts
    which = np.arange(len(left))
    for _ in range(8):
        hashes[which] = mix64(hashes[which] ^ (eight[at] & _LOWEST[np.minimum(left, 8)]))
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    for i in which.tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[words.starts[i] : words.ends[i]], digest_size=8).digest(), "little")
    words.hashes = words.lanes[0] = hashes
    return words


def _aligned(place: np.ndarray) -> np.ndarray:
    return _IN_COVER[place % PERIOD]


def _anchors(chunk: Chunk, words: Words, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the anchors at cover positions, in texts long enough for one window."""
    at, keys = words.windows(ANCHOR)
    row = words.row[at]
    good = _aligned(at - words.first[row]) & (words.count[row] >= window)
    return at[good], keys[good] >> np.uint64(64 - bits)


def _lists(column: pa.Array, chunk: Chunk) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column for a chunk's rows, and each value's row in the chunk."""
    part = column.slice(chunk.lo, chunk.hi - chunk.lo)
    n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(part), 0))
    return part.flatten(), np.repeat(np.arange(len(n)), n)


def _ints(values: pa.Array, name: str | None = None) -> np.ndarray:
    return np.asarray(values if name is None else pa.compute.struct_field(values, name)).astype(np.int64)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])


def _gathered(batches, window: int, bits: int):
    """Anchors of many texts at a time: their hashes, doc_ids, marks and places, in order of the hashes."""
    held, n = [], 0
    for batch in batches:
        ids, marks = np.asarray(take(batch, "doc_id").cast(pa.int64())), np.asarray(take(batch, "mark"))
        for chunk in chunks(take(batch, "text")):
            words = _words(chunk)
            at, keys = _anchors(chunk, words, window, bits)
            row = words.row[at]
            held.append((keys, ids[chunk.lo : chunk.hi][row], marks[chunk.lo : chunk.hi][row], (at - words.first[row]).astype(np.int32)))
            n += len(at)
            if n >= _MANY:
                yield _in_order(held)
                held, n = [], 0
    if n:
        yield _in_order(held)


def _in_order(held: list[tuple]) -> list[np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def _blocks(schema: str, turn: int, bits: int, keys: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of up to _BLOCK anchors of one part, from anchors in order of their hashes."""
    parts = (keys >> np.uint64(max(0, bits - _PART_BITS))).astype(np.int32)
    starts = np.union1d(np.arange(0, len(keys), _BLOCK), np.flatnonzero(np.diff(parts)) + 1)
    ends = pa.array(np.append(starts, len(keys)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, c if isinstance(c, pa.Array) else pa.array(c)) for c in (as_signed(keys), *columns)]
    return _batch(schema, parts[starts], np.full(len(starts), turn, np.int32), *lists)


HOLDERS = "part int, turn int, h array<bigint>, lo array<bigint>, hi array<bigint>"


def _held(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash once, with its smallest and largest holder, from hashes in order."""
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], np.minimum.reduceat(lo, head), np.maximum.reduceat(hi, head)


def _holders(window: int, bits: int):
    """Each anchor of many texts once, with the smallest and largest doc_id that holds it there."""

    def run(batches):
        for keys, ids, _, _ in _gathered(batches, window, bits):
            yield _blocks(HOLDERS, 0, bits, *_held(keys, ids, ids))

    return run


def _whole_parts(batches):
    """Batches in order of parts, joined and cut so that no part is torn."""
    held, last, n = [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = np.asarray(take(batch, "part"))
        cut = int(np.searchsorted(parts, parts[-1]))  # where the last part begins, which may go on
        if held and n >= _MANY and (cut or parts[0] != last):
            yield [*held, batch.slice(0, cut)]
            held, n = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        last, n = parts[-1], n + len(take(batch, "h").flatten())
    if held:
        yield held


def _flat(batches, name: str) -> np.ndarray:
    return np.concatenate([np.asarray(take(b, name).flatten()) for b in batches])


SHARED = "part int, turn int, h array<bigint>, lo array<bigint>"


def _first(bits: int):
    """The first holder of each anchor that several doc_ids hold, from blocks in order of parts."""

    def run(batches):
        for whole in _whole_parts(batches):
            keys = _flat(whole, "h").view(np.uint64)
            order = np.argsort(keys)
            keys, lo, hi = _held(keys[order], _flat(whole, "lo")[order], _flat(whole, "hi")[order])
            many = lo < hi
            yield _blocks(SHARED, 0, bits, keys[many], lo[many])

    return run


PLACES = "part int, turn int, h array<bigint>, doc_id array<bigint>, mark array<bigint>, at array<int>"


def _place_anchors(window: int, bits: int):
    def run(batches):
        for columns in _gathered(batches, window, bits):
            yield _blocks(PLACES, 1, bits, *columns)

    return run


MET = "h long, lo long, doc_id long, mark long, at int"


def _meet(batches):
    """Places of shared anchors with their first holders, from blocks in order of parts, a part's shared anchors (turn 0) before its places."""
    known, first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, places = np.asarray(take(batch, "part")), np.asarray(take(batch, "turn")) == 1
        shared, batch = batch.filter(pa.array(~places)), batch.filter(pa.array(places))
        known = np.append(known, _flat([shared], "h").view(np.uint64))
        first = np.append(first, _flat([shared], "doc_id"))
        keys = _flat([batch], "h").view(np.uint64)
        if len(known) and len(keys):
            where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            good = np.flatnonzero(known[where] == keys)
            columns = [_flat([batch], name)[good] for name in ("doc_id", "mark", "at")]
            yield _batch(MET, as_signed(keys[good]), first[where[good]], *columns)
        # only the last part may go on; its shared anchors came last
        of_last = len(_flat([shared.filter(pa.compute.equal(take(shared, "part"), int(parts[-1])))], "h"))
        if parts[0] != parts[-1]:
            known, first = known[len(known) - of_last :], first[len(first) - of_last :]


ASKED = "doc_id long, mark long, p int, n int, s int, lo long, h long, size int"


def _ask(window: int, bits: int):
    """Requests: windows p to p + n - 1 may stand in document lo, which has the anchor h that is here at s; `size` words are asked for."""

    def run(batches):
        for batch in batches:
            ids, marks, held = np.asarray(take(batch, "doc_id").cast(pa.int64())), np.asarray(take(batch, "mark")), take(batch, "held")
            for chunk in chunks(take(batch, "text")):
                words = _words(chunk)
                values, rows = _lists(held, chunk)
                first_holder = np.full(len(words.starts), _NONE)
                first_holder[_ints(values, "at") + words.first[rows]] = _ints(values, "lo")
                has = np.zeros(len(words.starts), bool)
                has[_ints(values, "at") + words.first[rows]] = True
                hashes = np.zeros(len(words.starts), np.uint64)
                where, keys = _anchors(chunk, words, window, bits)
                hashes[where] = keys
                # only windows around anchors with a first holder, and only those inside their text
                starts = np.flatnonzero(has)
                low = np.maximum(starts - (window - ANCHOR), words.first[words.row[starts]])
                p = np.flatnonzero(covered(low, starts + 1 - low, len(words.starts)))
                p = p[p + window <= words.first[1:][words.row[p]]]
                place = p - words.first[words.row[p]]
                good, lo, s = np.zeros(len(p), bool), np.full(len(p), _NONE), p.copy()
                for t in range(window - ANCHOR + 1):
                    aligned = _aligned(place + t) & has[p + t]
                    good |= aligned
                    better = aligned & ((first_holder[p + t] > lo) | (lo == _NONE))
                    lo[better], s[better] = first_holder[p[better] + t], p[better] + t
                p, lo, s = p[good], lo[good], s[good]
                if not len(p):
                    continue
                row = words.row[p]
                new = np.append(True, (np.diff(p) != 1) | (np.diff(row) != 0) | (np.diff(lo) != 0))
                since = np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
                new |= since % ((_REACH - 2) * window) == 0
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(p)))
                row, base = row[head], words.first[row[head]]
                need = p[head] + n - 1 + window - (s[head] - (window - ANCHOR))
                size = 2 ** np.ceil(np.log2(need)).astype(np.int64)  # few sizes, so that many ask alike
                yield _batch(ASKED, ids[chunk.lo : chunk.hi][row], marks[chunk.lo : chunk.hi][row], (p[head] - base).astype(np.int32), n.astype(np.int32), (s[head] - base).astype(np.int32), lo[head], as_signed(hashes[s[head]]), size.astype(np.int32))

    return run


ANSWERS = "lo long, h long, size int, before int, words binary"


def _sought(row: np.ndarray, keys: np.ndarray, at: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted hash first stands in its row, -1 where it does not, from places in order."""
    every_row, every_key = np.append(row, rows), np.append(keys, wanted)
    order = np.lexsort((every_key, every_row))  # stable: of equal ones, places come first and in order
    r, k = every_row[order], every_key[order]
    head = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    found = np.empty(len(order), np.int64)
    found[order] = np.where(leader < len(at), np.append(at, -1)[np.minimum(leader, len(at))], -1)
    return found[len(at) :]


def _answer(window: int, bits: int):
    """The words asked for: `before` of them (window - ANCHOR, or what the text has) stand before the anchor."""

    def run(batches):
        for batch in batches:
            ids, wanted = np.asarray(take(batch, "doc_id").cast(pa.int64())), take(batch, "wanted")
            for chunk in chunks(take(batch, "text")):
                words = _words(chunk)
                where, keys = _anchors(chunk, words, window, bits)
                values, rows = _lists(wanted, chunk)
                h, size = _ints(values, "h"), _ints(values, "size")
                at = _sought(words.row[where], keys, where, rows, h.view(np.uint64))
                here = np.flatnonzero(at >= 0)  # what is not here is in another text of this doc_id
                out, held = [], 0
                for r, h, size, at in zip(*(c[here].tolist() for c in (rows, h, size, at)), strict=True):
                    a = max(int(words.first[r]), at - (window - ANCHOR))
                    b = min(int(words.first[r + 1]), at - (window - ANCHOR) + size)
                    got = b" ".join(chunk.data[words.starts[a] : words.ends[b - 1]].tobytes().split())
                    out.append((int(ids[chunk.lo + r]), h, size, at - a, got))
                    held += len(got)
                    if held > 8 << 20:
                        yield _answers(out)
                        out, held = [], 0
                yield _answers(out)

    return run


def _answers(out: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*out, strict=True)) or [()] * 5
    return _batch(ANSWERS, pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.binary()))


COMPARED = "doc_id long, mark long, gone array<struct<at:int,n:int>>, open array<bigint>, anchors array<bigint>"


def _listed(rows: np.ndarray, count: int, values: pa.Array) -> pa.Array:
    """A list column of `count` rows from values in order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(count + 1)).astype(np.int32)), values)


def _window_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - min(64, bits + 16))


def _compare(window: int, bits: int):
    """Which windows of a run the words that came confirm, as spans of windows; the others stay open: their hashes, and their aligned anchors."""

    def run(batches):
        for batch in batches:
            ids, marks, came = take(batch, "doc_id").cast(pa.int64()), take(batch, "mark"), take(batch, "came")
            for chunk in chunks(take(batch, "text")):
                words = _words(chunk)
                size, total = chunk.hi - chunk.lo, len(words.starts)
                values, rows = _lists(came, chunk)
                p, n, s = (_ints(values, name) for name in ("p", "n", "s"))
                before = np.asarray(pa.compute.fill_null(pa.compute.struct_field(values, "before"), 0)).astype(np.int64)
                sure, held = np.zeros(total, bool), -1
                columns = (rows, words.first[rows], p, p + n, s - before)
                for r, base, low, high, start, said in zip(*(c.tolist() for c in columns), pa.compute.struct_field(values, "words").to_pylist(), strict=True):
                    if said is None:
                        continue
                    if r != held:
                        own, held = chunk.text(r).split(), r
                    got, start = said.split(b" ")[max(0, -start) :], max(0, start)
                    mine = own[start : start + len(got)]
                    low, high = max(low, start), min(high, start + len(mine) - window + 1)
                    if low >= high:
                        continue
                    if mine == got:
                        sure[base + low : base + high] = True
                    else:
                        wrong = np.append(0, np.cumsum(np.fromiter(map(ne, mine, got), np.int64, len(mine))))
                        sure[base + low : base + high] |= wrong[low - start + window : high - start + window] == wrong[low - start : high - start]
                first = np.zeros(total + 1, bool)
                first[words.first] = True
                heads = np.flatnonzero(sure & (first[:-1] | ~np.append(False, sure[:-1])[:total]))
                tails = np.flatnonzero(sure & (first[1:] | ~np.append(sure[1:], False)[:total]))
                row = words.row[heads]
                gone = pa.StructArray.from_arrays([pa.array((heads - words.first[row]).astype(np.int32)), pa.array((tails - heads + 1).astype(np.int32))], names=["at", "n"])
                rest = np.flatnonzero(covered(words.first[rows] + p, n, total) & ~sure)
                at, keys = words.windows(window)
                still = _window_bits(keys[np.searchsorted(at, rest)], bits)
                near = np.unique(rest[:, None] + np.arange(window - ANCHOR + 1))
                near = near[_aligned(near - words.first[words.row[near]])]
                anchors = _anchor_table(chunk, words, window, bits)[near]
                yield _batch(COMPARED, ids.slice(chunk.lo, size), marks.slice(chunk.lo, size), _listed(row, size, gone), _listed(words.row[rest], size, as_signed(still)), _listed(words.row[near], size, as_signed(anchors)))

    return run


def _anchor_table(chunk: Chunk, words: Words, window: int, bits: int) -> np.ndarray:
    """Hash by word number, zero where no anchor stands; kept with the words."""
    if not hasattr(words, "anchor_table"):
        words.anchor_table = np.zeros(len(words.starts), np.uint64)
        at, keys = _anchors(chunk, words, window, bits)
        words.anchor_table[at] = keys
    return words.anchor_table


WINDOWS = "h long, doc_id long, mark long, at int"


def _hash_windows(window: int, bits: int):
    """Windows that hold an anchor of an open window, from rows of (doc_id, mark, text, starts of such anchors)."""

    def run(batches):
        for batch in batches:
            ids, marks, held = np.asarray(take(batch, "doc_id").cast(pa.int64())), np.asarray(take(batch, "mark")), take(batch, "held")
            for chunk in chunks(take(batch, "text")):
                words = _words(chunk)
                at, keys = words.windows(window)
                values, rows = _lists(held, chunk)
                starts = _ints(values) + words.first[rows]
                # a window at p holds the anchor at s when p <= s <= p + window - ANCHOR
                low = np.maximum(starts - (window - ANCHOR), words.first[rows])
                good = covered(low, starts + 1 - low, len(words.starts))[at]
                row = words.row[at[good]]
                yield _batch(WINDOWS, as_signed(_window_bits(keys[good], bits)), ids[chunk.lo : chunk.hi][row], marks[chunk.lo : chunk.hi][row], (at[good] - words.first[row]).astype(np.int32))

    return run


SPELT = "words binary, doc_id long, mark long, at int"


def _spell(window: int):
    """The words of windows, from rows of (doc_id, mark, text, starts)."""

    def run(batches):
        for batch in batches:
            ids, marks, held = take(batch, "doc_id").cast(pa.int64()), take(batch, "mark"), take(batch, "held")
            for chunk in chunks(take(batch, "text")):
                for r in range(chunk.hi - chunk.lo):
                    own, starts = chunk.text(r).split(), sorted(set(held[chunk.lo + r].as_py()))
                    for i in range(0, len(starts), 4096):
                        part = starts[i : i + 4096]
                        one = np.full(len(part), chunk.lo + r)
                        yield _batch(SPELT, pa.array([b" ".join(own[p : p + window]) for p in part], pa.binary()), ids.take(pa.array(one)), marks.take(pa.array(one)), pa.array(part, pa.int32()))

    return run


def keyed(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with `mark`, which tells the texts of one doc_id apart (a number of their own, 0 where the doc_id is one row's alone); and each doc_id's texts once."""
    rows = documents.select("doc_id", "text")
    some = "doc_id is not null and text is not null"
    twins = written(rows.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "twins")
    if twins.isEmpty():
        discard(twins)
        rows = rows.withColumn("mark", F.lit(0).cast("long"))
        return rows, rows.filter(some)
    texts = rows.filter("text is not null").join(twins, "doc_id").distinct()
    marks = written(texts.select("doc_id", "text", (F.monotonically_increasing_id() + 1).alias("mark")), "marks")
    discard(twins)
    rows = rows.join(marks, ["doc_id", "text"], "left").select("doc_id", "text", F.coalesce("mark", F.lit(0)).alias("mark"))
    return rows, rows.filter(some).filter("mark = 0").unionByName(marks)


_ROW = ["doc_id", "mark"]


def _lists_of(places: DataFrame, value) -> DataFrame:
    return places.groupBy(*_ROW).agg(F.collect_list(value).alias("held"))


def _in_parts(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("part").sortWithinPartitions("part", "turn")


def _with(rows: DataFrame, lists: DataFrame) -> DataFrame:
    return rows.join(lists.hint("shuffle_hash"), _ROW)


def _answered(some: DataFrame, asked: DataFrame, window: int, bits: int) -> DataFrame:
    """The requests of each row with the words that came for them, as a table."""
    key = ["lo", "h", "size"]
    keys = written(asked.groupBy(*key).agg(F.count("*").alias("weight")), "keys")
    # a text is asked for each of its anchors in a few sizes at most, so its list is bounded by the text
    wanted = keys.groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list(F.struct("h", "size")).alias("wanted"))
    said = some.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "wanted")
    answers = written(said.mapInArrow(lean(_answer(window, bits)), ANSWERS), "answers")
    tables = [keys, answers]
    if answers.count() > keys.count():  # several texts of one doc_id answer: one answer will do
        answers = written(answers.dropDuplicates(key), "answers")
        tables.append(answers)
    # what very many ask for is copied for every _ASKERS of them; they learn the number of copies by their key alone
    copies = keys.withColumn("copies", F.ceil(F.col("weight") / _ASKERS).cast("int"))
    dealt = lookup(asked, copies, key, "weight", asked.count()).withColumn("copy", F.pmod(F.xxhash64(*_ROW), "copies").cast("int"))
    spread = answers.join(copies, key).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(*key, "copy", "before", "words")
    met = dealt.join(spread, [*key, "copy"], "left")
    came = written(met.groupBy(*_ROW).agg(F.collect_list(F.struct("p", "n", "s", "before", "words")).alias("came")), "came")
    discard(*tables)
    return came


def removal_plan(some: DataFrame, window: int = WINDOW, bits: int = ANCHOR_BITS) -> list[DataFrame]:
    """Tables of (doc_id, mark, gone): spans of windows to remove, for the keyed texts that lose words. Fewer `bits` only cost time."""
    if window < PERIOD + ANCHOR - 1:
        raise ValueError(f"a window must have {PERIOD + ANCHOR - 1} words at least, so that it holds an aligned anchor")
    with only(some.sparkSession) as keep:
        seen = some.mapInArrow(lean(_holders(window, bits)), HOLDERS)
        shared = written(_in_parts(seen).mapInArrow(lean(_first(bits)), SHARED), "anchors")
        places = some.mapInArrow(lean(_place_anchors(window, bits)), PLACES)
        no = F.lit(None)
        both = places.unionByName(shared.select("part", "turn", "h", F.col("lo").alias("doc_id"), no.cast("array<bigint>").alias("mark"), no.cast("array<int>").alias("at")))
        met = written(_in_parts(both).mapInArrow(lean(_meet), MET), "met")
        discard(shared)
        held = written(_lists_of(met.filter("doc_id > lo"), F.struct("at", "lo")), "places")
        asked = written(_with(some, held).mapInArrow(lean(_ask(window, bits)), ASKED), "asked")
        discard(held)
        came = _answered(some, asked, window, bits)
        discard(asked)
        found = written(_with(some, came).mapInArrow(lean(_compare(window, bits)), COMPARED), "found")
        discard(came)
        keep.append(found)
        if found.filter("size(open) > 0").isEmpty():
            return keep
        # what is sought, and the last document that seeks it: only places and windows up to there can take a part
        wanted = written(found.select("doc_id", F.explode("anchors").alias("h")).groupBy("h").agg(F.max("doc_id").alias("last")), "wanted")
        sought = written(found.select("doc_id", F.explode("open").alias("h")).groupBy("h").agg(F.max("doc_id").alias("last")), "sought")
        near = written(_lists_of(met.join(wanted.hint("shuffle_hash"), "h").filter("doc_id <= last"), F.col("at")), "near")
        windows = _with(some, near).mapInArrow(lean(_hash_windows(window, bits)), WINDOWS)
        like = written(windows.join(sought.hint("shuffle_hash"), "h").filter("doc_id <= last"), "like")
        earlier = like.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("last").alias("last")).filter("lo < last").select("h")
        open_ = written(_lists_of(like.join(earlier, "h"), F.col("at")), "open")
        discard(like)
        spelt = written(_with(some, open_).mapInArrow(lean(_spell(window)), SPELT), "spelt")
        firsts = spelt.groupBy("words").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("words", "lo")
        one = F.struct("at", F.lit(1).alias("n"))
        keep.append(written(spelt.join(firsts, "words").filter("doc_id > lo").groupBy(*_ROW).agg(F.collect_list(one).alias("gone")), "gone"))
    return keep


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _apply(window: int, texts: bool):
    def run(batches):
        for batch in batches:
            ids, gone = take(batch, "doc_id").cast(pa.int64()), take(batch, "gone")
            for chunk in chunks(take(batch, "text")):
                words = Words(chunk, SPACED, hashed=False)
                values, rows = _lists(gone, chunk)
                lost = covered(_ints(values, "at") + words.first[rows], _ints(values, "n") + window - 1, len(words.starts))
                out = []
                for r, count in enumerate(words.count.tolist()):
                    pieces, own = chunk.text(r).split(), lost[words.first[r] : words.first[r + 1]]
                    removed = int(own.sum())
                    if removed:
                        pieces = [p for p, x in zip(pieces, own.tolist(), strict=True) if not x]
                    kept = b" ".join(pieces)
                    out.append((count, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None))
                cols = list(zip(*out, strict=True))
                yield _batch(SCHEMA, ids.slice(chunk.lo, chunk.hi - chunk.lo), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()))

    return run


def dedup(documents: DataFrame, window: int = WINDOW, texts: bool = True, bits: int = ANCHOR_BITS) -> DataFrame:
    """One row per document: its words, how many were removed, the hash of what is kept and (if `texts`) the kept text.

    The result reads one shuffle of the texts by (doc_id, mark); rows without doc_id stay out of it.
    """
    rows, some = keyed(documents)
    joined, gone = rows.filter("doc_id is not null"), []
    for i, plan in enumerate(removal_plan(some, window, bits)):
        gone.append(F.coalesce(f"gone{i}", F.array().cast("array<struct<at: int, n: int>>")))
        joined = joined.join(plan.select(*_ROW, F.col("gone").alias(f"gone{i}")).filter(F.size(f"gone{i}") > 0).hint("shuffle_hash"), _ROW, "left")
    alone = rows.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<at: int, n: int>>").alias("gone"))
    return joined.select("doc_id", "text", F.concat(*gone).alias("gone")).union(alone).mapInArrow(lean(_apply(window, texts)), SCHEMA)
