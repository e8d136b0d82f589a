"""Benchmark decontamination with suffix arrays over the training texts.

Each executor builds, for one shard of documents at a time, a word-level suffix array, binary
searches every suffix of the test items in it, and extends every hit to its longest verbatim
match. A shard is judged where it is read.

Only positions that can begin a match enter the array: a run of words of the test vocabulary at
least as long as the shortest item or window. Likewise only test suffixes whose first words all
stand in the shard are searched. The rest cannot match, so this loses nothing.

Test items travel in blocks of BLOCK_BYTES (an item longer than that is a block of its own); an item is kept once,
its suffixes are places in it. A test set of one block rides with the task that reads the documents, and nothing is
shuffled. A larger one takes one pass over the documents for each block, so no worker and never the driver holds more
than a block; each pass keeps what it found in texts with hits alone, by the text's 128-bit hash, and one join brings
that back to the documents.

Edge cases: a null or empty text has no words and is clean; very long texts and items are searched whole; an item
without words, or with a null text, is ignored; items with a null item_id hit like others, count once in n_items, and are left out
of items_sha256; repeated rows are judged alike; a repeated item_id counts once; of longest matches of equal length the one that stands first counts, then the smaller item as a string; an empty
benchmark finds nothing; an empty table gives no rows; words are compared by 64-bit hashes of their bytes, so bytes that
are not UTF-8 are compared as they are; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.textcore import ALNUM_FOLDED, Words, chunks, covered, lean, take
from rasterloom.storage import only, written

WINDOW = 13
#: Bytes of test items that travel together.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that make one shard.
SHARD_BYTES = 4 << 20


def _by_name(item: str | None) -> tuple[bool, str]:
    """Items without id come first."""
    return item is not None, item or ""


class TestSet:
    """A block of test items as word numbers, ready for searching. Every suffix is a place in the items' words."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        items = [(None if i is None else str(i), t) for i, t in items]
        texts = pa.array([t for _, t in items], type=pa.large_string())
        parts = [Words(c, ALNUM_FOLDED) for c in chunks(texts, SHARD_BYTES)]
        hashes = np.concatenate([w.hashes for w in parts] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([w.count for w in parts] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.vocabulary = np.unique(hashes)
        self.text = np.append(np.searchsorted(self.vocabulary, hashes) + 1, 0).astype(np.int32)
        self.names = sorted({i for i, _ in items}, key=_by_name)
        number = {s: k for k, s in enumerate(self.names)}
        least = np.minimum(window, counts)
        n = np.where(counts > 0, counts - least + 1, 0)  # suffixes of each item
        row = np.repeat(np.arange(len(items)), n)
        ends = np.cumsum(counts)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.at = ((ends - counts)[row] + inside).astype(np.int32)
        self.lengths = (counts[row] - inside).astype(np.int32)
        self.need = least[row].astype(np.int32)
        self.item = row.astype(np.int32)
        self.owner = np.array([number[i] for i, _ in items], dtype=np.int32)
        self.longest = int(counts.max(initial=1))
        self.least = int(self.need.min(initial=window))

    def present(self, known: np.ndarray) -> np.ndarray:
        """The suffixes whose first `need` words are all among the words `known` of a shard."""
        seen = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        seen[known] = True
        missing = np.concatenate([[0], np.cumsum(~seen[self.text], dtype=np.int64)])
        return np.flatnonzero(missing[self.at] == missing[self.at + self.need])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first `depth` words (prefix doubling, ties by position)."""
    n = len(text)
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        k *= 2
        if step[-1] == n - 1:
            break
    return order


def _compare(text, begin, tests: TestSet, which, limit) -> np.ndarray:
    """Sign of (suffix of text) - (test suffix) over the first `limit` words, for each pair."""
    sign = np.zeros(len(begin), dtype=np.int64)
    live, k = np.arange(len(begin)), 0
    while len(live):
        live = live[limit[live] > k]
        a = text[np.minimum(begin[live] + k, len(text) - 1)]
        b = tests.text[tests.at[which[live]] + k]
        sign[live] = np.sign(a - b)
        live, k = live[a == b], k + 1
    return sign


def _bound(text, order, tests: TestSet, which: np.ndarray, upper: bool) -> np.ndarray:
    """For each of these test suffixes the first array slot not below (or, if upper, above) its first `need` words."""
    m = len(which)
    lo, hi = np.zeros(m, np.int64), np.full(m, len(order))
    while (open_ := lo < hi).any():
        k = np.flatnonzero(open_)
        mid = (lo[k] + hi[k]) // 2
        s = _compare(text, order[mid], tests, which[k], tests.need[which[k]])
        right = (s < 0) | ((s == 0) & upper)
        lo[k[right]] = mid[right] + 1
        hi[k[~right]] = mid[~right]
    return lo


def _runs(words: Words, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard's runs of test vocabulary, end to end with a 0 after each: word numbers of the tests, and places in the shard; and the words met."""
    slot = np.minimum(np.searchsorted(tests.vocabulary, words.hashes), len(tests.vocabulary) - 1)
    known = np.where(tests.vocabulary[slot] == words.hashes, slot + 1, 0).astype(np.int32)
    fresh = np.concatenate([[True], (known[1:] > 0) != (known[:-1] > 0)])
    fresh[words.first[:-1][words.first[:-1] < len(known)]] = True
    runs = np.flatnonzero(fresh)
    lengths = np.diff(np.append(runs, len(known)))
    good = (known[runs] > 0) & (lengths >= tests.least)
    runs, lengths = runs[good], lengths[good]
    total = int(lengths.sum()) + len(runs)
    text, place = np.zeros(total, np.int32), np.full(total, -1, np.int64)
    into = np.cumsum(lengths + 1) - (lengths + 1)
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    to, source = np.repeat(into, lengths) + step, np.repeat(runs, lengths) + step
    text[to], place[to] = known[source], source
    return text, place, known


def matches(words: Words, tests: TestSet, pairs: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, item) of each longest verbatim match in a shard of documents.

    A test suffix and a place in the shard that agree make a pair; about `pairs` of them are held at a time. Pairs that
    follow one another in both texts belong to one match, which the first of them begins.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(tests.need) or not len(words.hashes):
        return none, none, none
    text, place, known = _runs(words, tests)
    if not len(text):
        return none, none, none
    searched = tests.present(known)
    order = suffix_array(text, tests.longest)
    lo, hi = _bound(text, order, tests, searched, False), _bound(text, order, tests, searched, True)
    found = hi > lo
    searched, lo, n = searched[found], lo[found], (hi - lo)[found]
    before, a, out = np.concatenate([[0], np.cumsum(n)]), 0, []
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(before, before[a] + pairs, "right")) - 1)
        which = np.repeat(searched[a:z], n[a:z])
        begin = order[np.arange(int(n[a:z].sum())) - np.repeat(before[a:z] - before[a], n[a:z]) + np.repeat(lo[a:z], n[a:z])]
        a = z
        line = np.lexsort((begin, begin - tests.at[which], tests.item[which]))
        begin, which = begin[line], which[line]
        head = np.ones(len(begin), dtype=bool)
        head[1:] = (np.diff(begin) != 1) | (np.diff(which) != 1) | (np.diff(tests.item[which]) != 0)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(begin)) - 1
        begin, which, length = begin[first], which[first], (last - first + tests.need[which[first]]).astype(np.int64)
        live = np.arange(len(begin))
        while len(live):  # further only where the pairs held at a time end
            live = live[length[live] < tests.lengths[which[live]]]
            live = live[text[np.minimum(begin[live] + length[live], len(text) - 1)] == tests.text[tests.at[which[live]] + length[live]]]
            length[live] += 1
        out.append((place[begin], length, tests.item[which].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


#: What is known of one text: its words, those in test windows, the items, their hash, the verdict, and the longest match.
_FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_item string, longest_at long"
SCHEMA = f"doc_id long, {_FOUND}"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64()]


def _verdict(n_words: int, n_hit: int, items: set[str | None], length: int, item: str | None, at: int | None) -> tuple:
    return n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words, length, item, at


def _search(words: Words, tests: TestSet) -> tuple[dict[int, set[str]], dict[int, tuple[int, int, str]], np.ndarray, np.ndarray]:
    """By row with hits: the items, and the longest match (length, place, item); and first words and lengths of all matches."""
    begin, length, item = matches(words, tests)
    owner, row = tests.owner[item], words.row[begin]
    items: dict[int, set[str]] = {}
    for r, o in np.unique(np.stack([row, owner]), axis=1).T.tolist():
        items.setdefault(r, set()).add(tests.names[o])
    best = np.lexsort((owner, begin, -length, row))
    best = best[np.flatnonzero(np.append(True, np.diff(row[best]) != 0))] if len(best) else best
    longest = {r: (n, b, tests.names[o]) for r, n, b, o in zip(row[best].tolist(), length[best].tolist(), (begin - words.first[row])[best].tolist(), owner[best].tolist(), strict=True)}
    return items, longest, begin, length


def _judge(tests: TestSet):
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            ids, out = take(batch, "doc_id"), []
            for chunk in chunks(take(batch, "text"), SHARD_BYTES):
                words = Words(chunk, ALNUM_FOLDED)
                items, longest, begin, length = _search(words, tests)
                hits = np.concatenate([[0], np.cumsum(covered(begin, length, len(words.hashes)))])
                per_row = np.diff(hits[words.first]).tolist()
                out += [_verdict(n, per_row[r], items[r], *_turned(longest[r])) if r in items else (n, 0, 0, none, False, 0, None, None) for r, n in enumerate(words.count.tolist())]
            cols = list(zip(*out, strict=True)) if out else [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, type=k) for c, k in zip(cols, _KINDS, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return run


def _turned(longest: tuple[int, int, str]) -> tuple[int, str, int]:
    n, at, item = longest
    return n, item, at


def test_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[TestSet]:
    """The test items, streamed through the driver and packed into blocks of bounded size, one at a time."""
    pending, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        own = len((text or "").encode("utf-8", "surrogatepass"))
        if pending and size + own > block_bytes:
            yield TestSet(pending, window)
            pending, size = [], 0
        pending.append((item, text))
        size += own
    if pending:
        yield TestSet(pending, window)


_HITS = "text_key string, n_words long, begins array<long>, lengths array<long>, items array<string>, longest long, item string, at long"


def _hits(tests: TestSet):
    """What one block of tests finds in texts with hits: rows of _HITS."""

    def run(batches):
        for batch in batches:
            keys, rows = take(batch, "text_key"), []
            for chunk in chunks(take(batch, "text"), SHARD_BYTES):
                words = Words(chunk, ALNUM_FOLDED)
                items, longest, begin, length = _search(words, tests)
                order = np.argsort(words.row[begin], kind="stable")
                edges = np.searchsorted(words.row[begin][order], np.arange(len(words.count) + 1))
                for r, found in items.items():
                    own = order[edges[r] : edges[r + 1]]
                    n, at, item = longest[r]
                    rows.append((keys[chunk.lo + r].as_py(), int(words.count[r]), (begin[own] - words.first[r]).tolist(), length[own].tolist(), sorted(found, key=_by_name), n, item, at))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _HITS.split(", ")])

    return run


def _merged(batches):
    """(text_key, the verdict's columns) of what all blocks found in one text."""
    for batch in batches:
        out = []
        for key, blocks in zip(take(batch, "text_key").to_pylist(), take(batch, "blocks").to_pylist(), strict=True):
            begin, length = (np.array([v for b in blocks for v in b[k]], dtype=np.int64) for k in ("begins", "lengths"))
            hit = int(covered(begin, length, blocks[0]["n_words"]).sum())
            best = min(blocks, key=lambda b: (-b["longest"], b["at"], _by_name(b["item"])))
            out.append((key, *_verdict(blocks[0]["n_words"], hit, {i for b in blocks for i in b["items"]}, best["longest"], best["item"], best["at"])))
        cols = list(zip(*out, strict=True)) if out else [()] * (1 + len(_KINDS))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, [pa.string(), *_KINDS], strict=True)], names=["text_key", *(f.split()[0] for f in _FOUND.split(", "))])


def _found_in_passes(documents: DataFrame, blocks: Iterator[TestSet]) -> DataFrame:
    """(text_key, the verdict's columns) of the texts with hits: a pass over the documents for each block of tests."""
    texts, tables = documents.filter("text is not null").select(F.md5("text").alias("text_key"), "text"), []
    with only(documents.sparkSession) as results:
        for tests in blocks:
            rows = texts.mapInArrow(lean(_hits(tests)), _HITS)
            one = F.first(F.struct(*[f.split()[0] for f in _HITS.split(", ")[1:]])).alias("block")  # copies of a text have equal rows
            tables.append(written(rows.groupBy("text_key").agg(one), "hits"))
        every = reduce(DataFrame.union, tables)
        merged = written(every.groupBy("text_key").agg(F.collect_list("block").alias("blocks")).mapInArrow(lean(_merged), f"text_key string, {_FOUND}"), "found")
        results.append(merged)
    return merged


def _first_two(blocks: Iterator[TestSet]) -> tuple[TestSet, Iterator[TestSet] | None]:
    """The only block, or an iterator over all of several."""
    one = next(blocks, None)
    two = next(blocks, None)
    if two is None:
        return one if one is not None else TestSet([]), None
    return one, itertools.chain([one, two], blocks)


def _counted(batches):
    for batch in batches:
        n = [c for chunk in chunks(take(batch, "text"), SHARD_BYTES) for c in Words(chunk, ALNUM_FOLDED, hashed=False).count.tolist()]
        yield pa.RecordBatch.from_arrays([take(batch, "doc_id").cast(pa.int64()), take(batch, "key"), pa.array(n, type=pa.int64())], names=["doc_id", "key", "n"])


def judge(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words inside test windows, the items found, and the longest match."""
    tests, more = _first_two(test_blocks(benchmark, window, block_bytes))
    if more is None:
        return documents.select("doc_id", "text").mapInArrow(lean(_judge(tests)), SCHEMA)
    found = _found_in_passes(documents, more)
    rows = documents.select("doc_id", "text", F.md5("text").alias("key")).mapInArrow(lean(_counted), "doc_id long, key string, n long")
    zero = {"n_words": F.col("n"), "n_hit": F.lit(0), "n_items": F.lit(0), "items_sha256": F.sha2(F.lit(""), 256), "contaminated": F.lit(False), "longest_match": F.lit(0)}
    columns = [F.coalesce(c, zero[c]).alias(c) if c in zero else F.col(c) for c in (f.split()[0] for f in _FOUND.split(", "))]
    return rows.join(found, F.col("key") == F.col("text_key"), "left").select("doc_id", *columns)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`documents` without the contaminated ones. With one block of tests the verdict is taken on the row itself, without a join."""
    tests, more = _first_two(test_blocks(benchmark, window, block_bytes))
    if more is not None:
        bad = _found_in_passes(documents, more).filter("contaminated").select(F.col("text_key").alias("__decontam_key"))
        return documents.join(bad, F.md5(documents["text"]) == bad["__decontam_key"], "left_anti")
    inner = _judge(tests)

    def run(batches):
        for batch in batches:
            part = pa.RecordBatch.from_arrays([take(batch, "doc_id"), take(batch, "text")], names=["doc_id", "text"])
            (verdict,) = inner([part])
            yield batch.filter(pa.compute.invert(take(verdict, "contaminated")))

    return documents.mapInArrow(lean(run), documents.schema)
