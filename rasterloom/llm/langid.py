"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector of its own, drawn from its code point. A trigram's vector binds its letters'
vectors, the second and third permuted by one and two places; a language's prototype bundles (sums) the trigram vectors
of its training texts. Prototypes are normed, their common part is taken out, and a text gets the language whose
prototype has the greatest cosine with the text's own bundle.

A cosine with a bundle is a sum over the bundle's trigrams, so a text needs one table row for each trigram,
not a vector of its own, and its length divides out of the comparison. Prototypes are rounded to integers
once, and all sums are of integers: a prediction does not depend on how the rows are split into tasks.

Training reads all rows. A task counts (language, trigram) pairs, folds them into bundles when they grow too many, and
sends one sum for each language and dimension it met; what reaches the driver is the prototypes alone, at most
MAX_LANGS x DIMS numbers. A worker keeps the products of trigrams with the prototypes up to CACHE_NUMBERS, then starts afresh.

Edge cases: a null text, or one without letters, is `und` with score 0, as is every text if there is
nothing to learn from; rows with null lang or doc_id are not learned from; repeated rows count each time they stand
there; very long texts count whole; ties go to the first language by name; letters are what Unicode calls alphabetic,
lower-cased one by one; bytes that are not UTF-8 count as what stands between letters; an empty table gives no rows;
extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.textcore import U64, Chunk, chunks, lean, mix64, stream, take

DIMS = 2048
UNKNOWN = "und"
#: More distinct lang values than this are refused: they would not be languages.
MAX_LANGS = 4096
#: Numbers of a worker's table of products, letters with vectors at hand, and (language, trigram) counts held by a task.
CACHE_NUMBERS, CACHE_LETTERS, CACHE_COUNTS = 4_000_000, 8192, 2_000_000
_SCALE = 1 << 24
#: A trigram is three code points of so many bits.
_BITS = 21
_MASK = (1 << _BITS) - 1


def _letter_table(size: int = 0x33480) -> np.ndarray:
    """Code point to lower-cased letter; 0 for what is no letter. No letter lies beyond `size`."""
    lowered = [s.lower() if len(s.lower()) == 1 else s for s in map(chr, range(size))]
    return np.array([ord(s) if s.isalpha() else 0 for s in lowered])


class Profiles:
    """Letters and trigrams of texts, and the trigrams' vectors. Built once in each worker."""

    _one: Profiles | None = None

    def __init__(self) -> None:
        self.table = _letter_table()
        self.known, self.letters = np.zeros(0, dtype=np.int64), np.zeros((0, DIMS), dtype=np.int8)

    @classmethod
    def get(cls) -> Profiles:
        cls._one = cls._one or cls()
        return cls._one

    @staticmethod
    def letter_vectors(points: np.ndarray) -> np.ndarray:
        """The +-1 vectors of code points (0: the blank between words)."""
        with np.errstate(over="ignore"):
            words = mix64(points.astype(U64)[:, None] * U64(0x9E3779B97F4A7C15) ^ stream(29, DIMS // 64)[None, :])
        return (np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).astype(np.int8)

    def _rows(self, points: np.ndarray) -> np.ndarray:
        """Where the letters' vectors stand."""
        need = np.unique(points)
        fresh = np.setdiff1d(need, self.known, assume_unique=True)
        if len(fresh):
            held, vectors = (self.known, self.letters) if len(self.known) + len(fresh) <= CACHE_LETTERS else (self.known[:0], self.letters[:0])
            fresh = np.setdiff1d(need, held, assume_unique=True)
            every = np.concatenate([held, fresh])
            order = np.argsort(every)
            self.known, self.letters = every[order], np.concatenate([vectors, self.letter_vectors(fresh)])[order]
        return np.searchsorted(self.known, points)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        a, b, c = self._rows(np.stack([grams >> (2 * _BITS), (grams >> _BITS) & _MASK, grams & _MASK]))
        return self.letters[a] * np.roll(self.letters[b], 1, axis=1) * np.roll(self.letters[c], 2, axis=1)

    def grams(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigrams of all texts end to end, each text's limits in them, and each text's letters.

        Whatever stands between letters is one blank, as are a text's ends.
        """
        lead = (chunk.data & 0xC0) != 0x80
        bounds = np.concatenate([[0], np.cumsum(lead)])[chunk.bounds]
        try:
            points = np.frombuffer(chunk.data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        except UnicodeDecodeError:
            parts = [chunk.text(i).decode("utf-8", "replace") for i in range(len(chunk.bounds) - 1)]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.table[np.where(points < len(self.table), points, 0)]
        n = len(symbols)
        # two blanks are put between texts, then runs of blanks shrink to one
        wide = np.zeros(n + 2 * len(bounds), dtype=np.int64)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        wide[np.arange(n) + 2 * row + 2] = symbols
        keep = np.ones(len(wide), dtype=bool)
        keep[1:] = (wide[1:] != 0) | (wide[:-1] != 0)
        first = bounds + 2 * np.arange(len(bounds))  # the first of the two blanks before each text
        keep[first] = True
        keep[first + 1] = True
        keep[np.minimum(first + 2, len(wide) - 1)] &= wide[np.minimum(first + 2, len(wide) - 1)] != 0
        keep[first[first + 2 >= len(wide)]] = True
        at = np.concatenate([[0], np.cumsum(keep)])[first]
        s = wide[keep]
        grams = (s[:-2] << (2 * _BITS)) | (s[1:-1] << _BITS) | s[2:]
        # a trigram counts if its middle is a letter; it then lies inside one text
        middle = s[1:-1] != 0
        edges = np.concatenate([[0], np.cumsum(middle)])[np.clip(at, 0, len(middle))]
        letters = np.diff(np.concatenate([[0], np.cumsum(symbols > 0)])[bounds])
        return grams[middle], edges, letters


class Numbering:
    """Trigrams as small numbers, in the order met. Most are found in a table by their hash, the rest in a sorted list."""

    _SLOTS = 1 << 19

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots, self.held = np.zeros(self._SLOTS, dtype=np.int32), np.full(self._SLOTS, -1, dtype=np.int64)
        self.known, self.numbers = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.known)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams' numbers, and those of them that are new, by number."""
        slot = (mix64(grams.view(U64)) >> U64(45)).astype(np.int64)
        miss = np.flatnonzero(self.held[slot] != grams)
        out, fresh = self.slots[slot].astype(np.int64), np.zeros(0, dtype=np.int64)
        if len(miss):
            unique, back = np.unique(grams[miss], return_inverse=True)
            at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
            new = self.known[at] != unique if len(self.known) else np.ones(len(unique), dtype=bool)
            number = np.zeros(len(unique), dtype=np.int64)
            number[~new] = self.numbers[at[~new]] if len(self.known) else 0
            fresh = unique[new]
            number[new] = len(self.known) + np.arange(len(fresh))
            every, order = np.concatenate([self.known, fresh]), None
            order = np.argsort(every, kind="stable")
            self.known, self.numbers = every[order], np.concatenate([self.numbers, number[new]])[order]
            out[miss] = number[back]
            self.held[slot[miss]], self.slots[slot[miss]] = grams[miss], number[back]
        return out, fresh

    def grams(self) -> np.ndarray:
        """All trigrams by number."""
        out = np.empty(len(self.known), dtype=np.int64)
        out[self.numbers] = self.known
        return out


class Bundles:
    """Sums of trigram vectors by language, from counts that are folded in when they grow too many."""

    def __init__(self, limit: int = CACHE_COUNTS):
        self.limit, self.numbering, self.sums = limit, Numbering(), {}
        self.keys, self.counts, self.pending = [], [], 0  # language number * 2^40 + trigram number
        self.langs: dict[str, int] = {}

    def add(self, lang: str, grams: np.ndarray) -> None:
        numbers, _ = self.numbering(grams)
        if len(self.numbering) <= 4 * len(numbers) + 4096:
            counts = np.bincount(numbers)
            seen = np.flatnonzero(counts)
            counts = counts[seen]
        else:
            seen, counts = np.unique(numbers, return_counts=True)
        self.keys.append((self.langs.setdefault(lang, len(self.langs)) << 40) + seen)
        self.counts.append(counts)
        self.pending += len(seen)
        if self.pending > 2 * self.limit:
            self._pack()
            if self.pending > self.limit:
                self.fold()

    def _pack(self) -> None:
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.counts = [keys], [np.bincount(back, weights=np.concatenate(self.counts)).astype(np.int64)]
        self.pending = len(keys)

    def fold(self) -> dict[str, np.ndarray]:
        """All counts so far, as bundles."""
        if self.keys:
            self._pack()
            keys, counts, grams = self.keys[0], self.counts[0], self.numbering.grams()
            for lang, number in self.langs.items():
                a, z = np.searchsorted(keys, [number << 40, (number + 1) << 40])
                total = self.sums.setdefault(lang, np.zeros(DIMS, dtype=np.int64))
                for b in range(a, z, 1024):
                    part = slice(b, min(b + 1024, z))
                    total += (counts[part].astype(np.float64) @ Profiles.get().vectors(grams[keys[part] & ((1 << 40) - 1)]).astype(np.float64)).astype(np.int64)
            self.keys, self.counts, self.pending = [], [], 0
            self.numbering.clear()
        return self.sums


def _train(batches):
    profiles, bundles = Profiles.get(), Bundles()
    for batch in batches:
        langs = take(batch, "lang")
        for chunk in chunks(take(batch, "text")):
            grams, edges, _ = profiles.grams(chunk)
            names = langs.slice(chunk.lo, chunk.hi - chunk.lo).dictionary_encode()
            order = np.argsort(np.asarray(names.indices), kind="stable")
            size = np.diff(edges)[order]
            moved = grams[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edges[:-1][order], size)]
            ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(np.asarray(names.indices)[order], np.arange(len(names.dictionary) + 1))]
            for k, lang in enumerate(names.dictionary.to_pylist()):
                if ends[k + 1] > ends[k]:
                    bundles.add(lang, moved[ends[k] : ends[k + 1]])
    for lang, total in bundles.fold().items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(total)], names=["lang", "dim", "v"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes as integers, from rows with `text` and `lang`."""
    rows = labelled.filter("text is not null and lang is not null").select("text", "lang")
    sums = rows.mapInArrow(lean(_train), "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    got = sums.limit(MAX_LANGS * DIMS + 1).toPandas()
    if len(got) > MAX_LANGS * DIMS:
        raise ValueError(f"more than {MAX_LANGS} values of lang")
    langs = sorted(got["lang"].unique())
    raw = np.zeros((len(langs), DIMS))
    if len(langs):
        raw[np.searchsorted(np.array(langs), got["lang"].to_numpy().astype(str)), got["dim"].to_numpy()] = got["v"].to_numpy()
    norm = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
    unit = norm(raw)
    if len(langs) > 1:
        unit = norm(unit - unit.mean(axis=0))
    return langs, np.rint(unit * _SCALE).astype(np.int64)


class Scorer:
    """Integer products of trigram vectors with the prototypes, worked out when a trigram is first met."""

    def __init__(self, prototypes: np.ndarray, limit: int = CACHE_NUMBERS):
        self.profiles, self.prototypes = Profiles.get(), prototypes.astype(np.float64).T
        self.langs = prototypes.shape[0]
        self.limit, self.numbering = max(1, limit // max(1, self.langs)), Numbering()
        self.rows = np.zeros((0, self.langs), dtype=np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        if len(self.numbering) > self.limit:
            self.numbering.clear()
        numbers, fresh = self.numbering(grams)
        if len(fresh):
            done, total = len(self.numbering) - len(fresh), len(self.numbering)
            if total > len(self.rows):
                wider = np.empty((total + total // 4, self.langs), dtype=np.int64)
                wider[:done] = self.rows[:done]
                self.rows = wider
            for a in range(0, len(fresh), 1024):
                part = fresh[a : a + 1024]
                self.rows[done + a : done + a + len(part)] = (self.profiles.vectors(part).astype(np.float64) @ self.prototypes).astype(np.int64)  # exact: below 2^53
        return self.rows[numbers]

    def sums(self, grams: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """For each text, between its edges, the sum of its trigrams' products; a bounded number of products at a time."""
        out, step = np.zeros((len(edges) - 1, self.langs), dtype=np.int64), max(1, (1 << 20) // max(1, self.langs))
        row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        for a in range(0, len(grams), step):
            own = row[a : a + step]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[heads]] += np.add.reduceat(self(grams[a : a + step]), heads, axis=0)
        return out


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def _predict(langs: list[str], prototypes: np.ndarray):
    def run(batches):
        scorer, names = Scorer(prototypes), np.array([*langs, UNKNOWN], dtype=object)
        for batch in batches:
            out = []
            for chunk in chunks(take(batch, "text")):
                grams, edges, letters = scorer.profiles.grams(chunk)
                n = len(letters)
                best, score = np.full(n, len(langs)), np.zeros(n)
                some = np.flatnonzero((letters > 0) & bool(langs))
                if len(some):
                    sums = scorer.sums(grams, edges)[some]
                    best[some] = sums.argmax(axis=1)
                    positive = np.maximum(sums, 0).astype(np.float64)
                    score[some] = positive.max(axis=1) / np.maximum(positive.sum(axis=1), 1)
                out.append((names[best], np.round(score, 9)))
            pred = np.concatenate([p for p, _ in out]) if out else np.zeros(0, object)
            scores = np.concatenate([s for _, s in out]) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([take(batch, "doc_id").cast(pa.int64()), take(batch, "held_out"), pa.array(pred, type=pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of its key as text is divisible by `folds`. A null key is null."""
    return F.crc32(key.cast("string")) % folds == 0


def identify(documents: DataFrame, folds: int = 5) -> DataFrame:
    """One row per document; learned from the rows that are not held out, `score` is the winner's share of all positive cosines."""
    langs, prototypes = train(documents.filter(~held_out(F.col("doc_id"), folds)))
    rows = documents.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id"), folds), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(lean(_predict(langs, prototypes)), SCHEMA)
