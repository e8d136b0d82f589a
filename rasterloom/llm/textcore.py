"""Vectorised text kernels shared by the corpus operators.

Everything works on the raw UTF-8 buffers of an Arrow column: a *chunk* is a run of rows whose
texts together stay near a byte budget, so peak memory follows the budget (or the one longest
text), never the batch or the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=U64) + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(n, dtype=U64) + U64(seed) * U64(0x632BE59BD9B4E019))


class Alphabet:
    """Which bytes make words, whether A-Z fold to a-z, and the per-byte random weights."""

    def __init__(self, word_bytes: np.ndarray, fold: bool):
        self.is_word = word_bytes
        self._lanes = []
        for seed in (11, 12):
            weights = stream(seed, 256)
            if fold:
                weights[65:91] = weights[97:123]
            self._lanes.append([np.where(word_bytes, weights, U64(0)), stream(1002 + seed, 256) | U64(1)])

    def weights(self, lane: int = 0) -> np.ndarray:
        return self._lanes[lane][0]

    def steps(self, n: int, lane: int = 0) -> np.ndarray:
        own = self._lanes[lane]
        if n > len(own[1]):
            own[1] = stream(1013 + lane, max(n, 2 * len(own[1]))) | U64(1)
        return own[1]


def _bytes(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


_NOT_SPACE = ~_bytes((0x20, 0x20), (0x09, 0x0D))
#: Words as runs of anything but ASCII white space.
SPACED = Alphabet(_NOT_SPACE, fold=False)
#: The same, A-Z folded.
SPACED_FOLDED = Alphabet(_NOT_SPACE, fold=True)
#: Words as runs of ASCII letters, digits and all non-ASCII characters, A-Z folded.
ALNUM_FOLDED = Alphabet(_bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)), fold=True)


class Chunk:
    """Rows lo..hi of a batch; `data` holds their texts end to end, `bounds` each text's limits."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray, valid: np.ndarray):
        self.lo, self.hi, self.data, self.bounds, self.valid = lo, hi, data, bounds, valid

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def chunks(column: pa.Array, budget: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into chunks. A null text counts as empty, with `valid` false."""
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(n, dtype=bool)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], valid[lo:hi])
        lo = hi


class Words:
    """Words of a chunk: byte starts and ends, 64-bit hashes in each lane, and `first`, each text's first word (one more at the end)."""

    def __init__(self, chunk: Chunk, alphabet: Alphabet, hashed: bool = True, lanes: int = 1):
        data, n = chunk.data, len(chunk.data)
        inside = alphabet.is_word[data]
        starts = np.empty(n, dtype=bool)
        if n:
            starts[0] = True
            np.logical_not(inside[:-1], out=starts[1:])
            cuts = chunk.bounds[:-1]
            starts[cuts[cuts < n]] = True
            starts &= inside
        self.starts = np.flatnonzero(starts)
        ends = np.empty(n, dtype=bool)
        if n:
            ends[-1] = True
            np.logical_not(inside[1:], out=ends[:-1])
            cuts = chunk.bounds[1:-1]
            ends[cuts[(cuts > 0)] - 1] = True
            ends &= inside
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, chunk.bounds)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.lanes = [np.zeros(0, dtype=U64)] * lanes
        if hashed and len(self.starts):
            at = np.arange(n, dtype=np.int32)
            since = at - np.maximum.accumulate(np.where(starts, at, 0))
            for k in range(lanes):
                with np.errstate(over="ignore"):
                    parts = alphabet.weights(k)[data] * alphabet.steps(int(since.max()) + 1, k)[since]
                    self.lanes[k] = mix64(np.add.reduceat(parts, self.starts) + (self.ends - self.starts).astype(U64))
        self.hashes = self.lanes[0]

    def windows(self, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and hashes of all windows of `size` words that stay inside one text, from one lane of word hashes."""
        h, n = self.lanes[lane], len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        last = self.first[1:][self.row[:n]]
        at = np.flatnonzero(np.arange(n) + size <= last)
        keys = stream(77 + lane, size) | U64(1)
        with np.errstate(over="ignore"):
            total = np.zeros(n, dtype=U64)
            for k in range(size):
                total += h[k : k + n] * keys[k]
            return at, mix64(total[at])


def covered(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Marks the n positions that lie inside any interval [start, start + size)."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def lean(run):
    """`run`, a function over Arrow batches, giving freed memory back to the machine when a task is done.

    Workers outlive tasks and several stand beside one executor, so what an allocator keeps for later adds up.
    """

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def take(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with as many underscores behind it as it takes to differ from all in `taken` (whatever the case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
