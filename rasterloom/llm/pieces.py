"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and its decoding.

A text's lattice has an edge for every piece that stands in it. Forward filtering sums, at each place, the
probability of all segmentations up to it; backward sampling then draws edges from the end, so a whole
segmentation is drawn with its exact probability. Draws come from a counter-based generator keyed by (seed, row
key, segment, step): the same row gets the same pieces in whatever task, order or retry.

Pieces weigh p ~ 1 / (rank + 2)^alpha for vocabularies whose scores are ranks (BPE), and p ~ exp(alpha * score)
for those whose scores are log-probabilities (unigram).

The lattice falls apart wherever no piece holds the two neighbouring characters, as before most word-start
marks and around characters that no piece holds. Segments are therefore independent, and a worker keeps
the filtered lattice of each distinct segment for its later occurrences.

Decoding is lossless: blanks become marks and a leading mark is added and taken off again; characters that no
piece holds, and a literal mark, are written as byte pieces.

Edge cases: a null text has null pieces and decodes to null; an empty text has no pieces and decodes to an empty
text; bytes that are not UTF-8 are written as byte pieces, so they too come back; very long texts are encoded whole;
rows with a null key are seeded alike; repeated rows are segmented alike; an empty table gives no rows; extra columns are
carried along, those with the names of the results are replaced (`out` and `decoded` name these).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rasterloom.llm.textcore import U64, Chunk, chunks, lean, mix64, stream, take

MARK = 0x2581
#: Stands for a literal mark in a text; no code point.
_LITERAL = 0x110001
#: Symbols of distinct segments that a worker keeps; beyond, it starts afresh.
CACHE_SYMBOLS = 600_000
#: Pieces that are decoded together.
DECODE_PIECES = 250_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their log-weights, and the ids of the 256 byte pieces. Control pieces have empty bytes and are never drawn."""

    pieces: list[str]
    weights: np.ndarray
    byte_ids: np.ndarray

    @classmethod
    def load(cls, path: str, alpha: float = 1.0) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        byte_ids, pieces, scores = np.full(256, -1), [""] * n, np.full(n, -np.inf)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[i], scores[i] = piece, model.get_score(i)
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so decoding could lose characters")
        real = np.isfinite(scores)
        ranked = bool(real.any()) and np.array_equal(scores[real], np.round(scores[real]))
        weights = np.where(real, -alpha * np.log(2 - np.where(real, scores, 0)) if ranked else alpha * scores, -np.inf)
        return cls(pieces, weights, byte_ids)


def uniform(keys: np.ndarray, segment: np.ndarray, step: int) -> np.ndarray:
    """Draws in [0, 1), 24 bits, for (row key, segment, step)."""
    with np.errstate(over="ignore"):
        mixed = mix64(keys ^ mix64(segment.astype(U64) * U64(0x1F123BB5) + U64(step) * U64(0x9E3779B97F4A7C15)))
    return (mixed >> U64(40)).astype(np.float32) / np.float32(1 << 24)


def row_keys(ids: np.ndarray, seed: int) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(U64) ^ mix64(np.array([seed], dtype=U64)))


class Sampler:
    """The filtered lattices of the segments met so far, and draws from them."""

    def __init__(self, vocabulary: Vocabulary, cache_symbols: int = CACHE_SYMBOLS):
        self.limit = cache_symbols
        lengths = np.array([len(p) for p in vocabulary.pieces])
        self.width = int(lengths.max(initial=1))
        if self.width > 32_767:
            raise ValueError("a piece is longer than 32767 characters")
        self.weights, self.byte_ids = vocabulary.weights, vocabulary.byte_ids.astype(np.int32)
        self.steps = stream(41, self.width) | U64(1)
        self.bare_weight = 3 * self.weights[np.isfinite(self.weights)].min(initial=0.0)
        # prefixes of pieces by length: hash, and the piece's id or -1
        self.tables = []
        spelled = [(i, np.array([ord(c) for c in p], dtype=np.int64)) for i, p in enumerate(vocabulary.pieces) if p]
        for n in range(1, self.width + 1):
            own = [(i if len(q) == n else -1, q[:n]) for i, q in spelled if len(q) >= n]
            points = np.stack([q for _, q in own])
            with np.errstate(over="ignore"):
                keys = (mix64(points.astype(U64)) * self.steps[:n]).sum(axis=1, dtype=U64)
            ids = np.array([i for i, _ in own], dtype=np.int32)
            order = np.lexsort((-ids, keys))  # a whole piece comes before prefixes of the same letters
            keys, ids = keys[order], ids[order]
            new = np.append(True, keys[1:] != keys[:-1])
            self.tables.append((keys[new], ids[new]))
        # neighbours that some piece holds, by symbol classes
        letters = np.unique(np.concatenate([q for _, q in spelled]))
        self.classes = np.zeros(0x110002, dtype=np.int32)
        self.classes[letters] = 1 + np.arange(len(letters))
        self.tied = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        for _, q in spelled:
            c = self.classes[q]
            self.tied[c[:-1], c[1:]] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=U64)  # segment hashes in order, and where their symbols begin
        self.places = np.zeros(0, dtype=np.int64)
        self.symbols = 0
        # edges by the symbol they end with, then length: that symbol's number + the running probability, length, id;
        # heads: each symbol's first edge
        self.heads = np.zeros(0, dtype=np.int32)
        self.keys, self.lengths, self.ids = np.zeros(0), np.zeros(0, dtype=np.int16), np.zeros(0, dtype=np.int32)

    def _filter(self, symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, length, id) of all edges of the segments, and each symbol's first; id is -1 - code point for an edge of bytes."""
        total = len(symbols)
        inside = np.arange(total) - np.repeat(first, sizes)
        room = np.repeat(sizes, sizes) - inside
        mixed = mix64(symbols.astype(U64))
        live, key = np.arange(total), np.zeros(total, dtype=U64)
        ends, lengths, ids = [], [], []
        for n in range(1, self.width + 1):  # starts whose next n symbols begin some piece
            if n > 1:
                good = room[live] >= n
                live, key = live[good], key[good]
            if not len(live):
                break
            with np.errstate(over="ignore"):
                key = key + mixed[live + n - 1] * self.steps[n - 1]
            keys, own = self.tables[n - 1]
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            good = keys[slot] == key
            found = np.where(good, own[slot], -1)
            if n == 1:
                bare = found < 0  # no piece of its own: one edge of bytes
                found = np.where(bare, -1 - symbols, found).astype(np.int32)
                piece = np.ones(total, dtype=bool)
            else:
                piece = found >= 0
            ends.append(live[piece] + n - 1)
            lengths.append(np.full(len(ends[-1]), n))
            ids.append(found[piece])
            live, key = live[good], key[good]
        end, length, id_ = np.concatenate(ends), np.concatenate(lengths), np.concatenate(ids)
        order = np.lexsort((length, end, inside[end]))
        end, length, id_ = end[order], length[order], id_[order]
        weight = np.where(id_ >= 0, self.weights[np.maximum(id_, 0)], self.bare_weight)
        alpha = np.zeros(total + 1)  # alpha[p + 1]: all segmentations up to symbol p of its segment
        start = end - length + 1
        start = np.where(inside[start] == 0, -1, start)  # slot 0 stays 0
        at = np.where(start < 0, 0, start)
        alpha_slot = end + 1
        cum = np.empty(len(end))
        rounds = np.searchsorted(inside[end], np.arange(int(sizes.max(initial=0)) + 1))
        heads = np.append(True, end[1:] != end[:-1]) if len(end) else np.zeros(0, dtype=bool)
        for lo, hi in zip(rounds[:-1].tolist(), rounds[1:].tolist(), strict=True):
            head = np.flatnonzero(heads[lo:hi])
            size = np.diff(np.append(head, hi - lo))
            a = alpha[at[lo:hi]] + weight[lo:hi]
            top = np.maximum.reduceat(a, head)
            e = np.exp(a - np.repeat(top, size))
            run = np.cumsum(e)
            before = run[head] - e[head]
            whole = run[head + size - 1] - before
            alpha[alpha_slot[lo:hi][head]] = top + np.log(whole)
            part = (run - np.repeat(before, size)) / np.repeat(whole, size)
            part[head + size - 1] = 1.0
            cum[lo:hi] = part
        back = np.lexsort((length, end))
        return (end + cum)[back], length[back], id_[back], np.searchsorted(end[back], np.arange(total))

    def _places(self, hashes: np.ndarray, symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where each segment's lattice begins, filtering those not met before."""
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = self.known[slot] != unique if len(self.known) else np.ones(len(unique), dtype=bool)
        if self.symbols + int(sizes[where[new]].sum()) > self.limit and len(self.known):
            self.clear()
            return self._places(hashes, symbols, first, sizes)
        if new.any():
            own = where[new]
            n, begin = sizes[own], first[own]
            into = np.cumsum(n) - n
            pick = np.arange(int(n.sum())) - np.repeat(into, n) + np.repeat(begin, n)
            keys, lengths, ids, heads = self._filter(symbols[pick], into, n)
            places, known = np.concatenate([self.places, into + self.symbols]), np.concatenate([self.known, unique[new]])
            order = np.argsort(known)
            self.known, self.places = known[order], places[order]
            self.keys, self.lengths, self.ids = np.concatenate([self.keys, keys + self.symbols]), np.concatenate([self.lengths, lengths.astype(np.int16)]), np.concatenate([self.ids, ids])
            self.heads = np.concatenate([self.heads, (heads + len(self.keys) - len(keys)).astype(np.int32)])
            self.symbols += len(pick)
        return self.places[np.searchsorted(self.known, unique)][back]

    def segments(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts with their leading marks, where segments begin, their sizes, and each text's limits in segments."""
        n, texts = len(points), np.diff(bounds)
        some = texts > 0  # an empty text has no segment
        extra = np.cumsum(some)
        symbols = np.full(n + int(some.sum()), MARK, dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), texts)
        values = np.where(points == 0x20, MARK, np.where(points == MARK, _LITERAL, points))
        symbols[np.arange(n) + extra[row]] = values
        edges = bounds + np.concatenate([[0], extra])
        kind = self.classes[symbols]
        begin = np.ones(len(symbols), dtype=bool)
        begin[1:] = ~self.tied[kind[:-1], kind[1:]]
        begin[edges[:-1][some]] = True
        first = np.flatnonzero(begin)
        return symbols, first, np.diff(np.append(first, len(symbols))), np.searchsorted(first, edges)

    def draw(self, points: np.ndarray, bounds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and each text's limits in them."""
        symbols, first, sizes, limits = self.segments(points, bounds)
        if not len(first):
            return np.zeros(0, dtype=np.int32), np.zeros(len(bounds), dtype=np.int64)
        at = np.arange(len(symbols)) - np.repeat(first, sizes)
        grown = self.steps_for(int(sizes.max()))
        with np.errstate(over="ignore"):
            hashes = mix64(np.add.reduceat(mix64(symbols.astype(U64)) * grown[at], first) + sizes.astype(U64))
        place = self._places(hashes, symbols, first, sizes)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(limits))
        number = np.arange(len(first)) - limits[row]
        live, end = np.arange(len(first)), sizes.copy()
        drawn, owners, step = [], [], 0
        while len(live):
            spot = place[live] + end[live] - 1
            u = uniform(keys[row[live]], number[live], step)
            target, edge = spot + u.astype(np.float64), self.heads[spot]
            late = np.flatnonzero(self.keys[edge] <= target)
            while len(late):
                edge[late] += 1
                late = late[self.keys[edge[late]] <= target[late]]
            drawn.append(self.ids[edge])
            owners.append(live)
            end[live] -= self.lengths[edge]
            live, step = live[end[live] > 0], step + 1
        ids, owner = np.concatenate(drawn), np.concatenate(owners)
        turn = np.repeat(np.arange(len(drawn)), [len(d) for d in drawn])
        count = np.bincount(owner, minlength=len(first))
        out = np.empty(len(ids), dtype=np.int32)
        out[(np.cumsum(count) - 1)[owner] - turn] = ids  # drawn from the end
        stops = np.concatenate([[0], np.cumsum(count)])[limits]
        if (out < 0).any():
            out, stops = self._as_bytes(out, stops)
        return out, stops

    def steps_for(self, n: int) -> np.ndarray:
        if not hasattr(self, "_long") or len(self._long) < n:
            self._long = stream(43, max(256, 2 * n)) | U64(1)
        return self._long

    def _as_bytes(self, ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, spot = np.unique(-1 - ids[ids < 0], return_inverse=True)
        coded = [chr(MARK if p == _LITERAL else p).encode("utf-8", "surrogateescape") for p in points.tolist()]
        sizes = np.ones(len(ids), dtype=np.int64)
        sizes[ids < 0] = np.array([len(c) for c in coded])[spot]
        ends = np.cumsum(sizes)
        out = np.repeat(ids, sizes)
        low = out < 0
        starts = np.cumsum([0, *(len(c) for c in coded)])[:-1]
        flat = self.byte_ids[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        within = np.arange(len(out)) - np.repeat(ends - sizes, sizes)
        out[low] = flat[(starts[np.repeat(spot, sizes[ids < 0])] + within[low])]
        return out, np.concatenate([[0], ends])[stops]


def code_points(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, and each text's limits. A byte that is not UTF-8 counts as U+DC00 and its value."""
    try:
        decoded, lead = chunk.data.tobytes().decode("utf-8"), (chunk.data & 0xC0) != 0x80
        bounds = np.concatenate([[0], np.cumsum(lead)])[chunk.bounds]
    except UnicodeDecodeError:
        parts = [chunk.text(i).decode("utf-8", "surrogateescape") for i in range(len(chunk.bounds) - 1)]
        decoded, bounds = "".join(parts), np.cumsum([0, *map(len, parts)]).astype(np.int64)
    return np.frombuffer(decoded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64), bounds


#: Bytes of text that are encoded together.
ENCODE_BYTES = 1 << 19


def _encoder(vocabulary: Vocabulary, seed: int, key: str, text: str, out: str):
    def run(batches):
        sampler = Sampler(vocabulary)
        for batch in batches:
            ids = np.asarray(take(batch, key).cast(pa.int64()).fill_null(-1))
            keys = row_keys(ids, seed)
            for chunk in chunks(take(batch, text), ENCODE_BYTES):
                points, bounds = code_points(chunk)
                values, stops = sampler.draw(points, bounds, keys[chunk.lo : chunk.hi])
                nulls = {} if chunk.valid.all() else {"mask": np.append(~chunk.valid, False)}
                lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32), **nulls), pa.array(values))
                part = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])

    return run


def _decoder(vocabulary: Vocabulary, pieces: str, out: str):
    coded = [p.replace(chr(MARK), " ").encode() for p in vocabulary.pieces]
    for value, i in enumerate(vocabulary.byte_ids.tolist()):
        coded[i] = bytes([value])
    flat = np.frombuffer(b"".join(coded), dtype=np.uint8)
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes

    def run(batches):
        for batch in batches:
            every = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(take(batch, pieces)), 0)).astype(np.int64)
            before, lo = np.concatenate([[0], np.cumsum(every)]), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(before, before[lo] + DECODE_PIECES, "right")) - 1)
                part, counts = batch.slice(lo, hi - lo), every[lo:hi]
                lists, lo = take(part, pieces), hi
                ids = np.asarray(lists.flatten())
                n = sizes[ids]
                ends = np.cumsum(n)
                text = flat[np.repeat(starts[ids] - (ends - n), n) + np.arange(int(n.sum()))]
                stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                valid = np.asarray(lists.is_valid())
                texts = [(text[a + 1 : b].tobytes() if ok else None) for a, b, ok in zip(stops[:-1].tolist(), stops[1:].tolist(), valid.tolist(), strict=True)]
                # the bytes as they are, UTF-8 or not
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, type=pa.binary()).view(pa.string())], names=[*part.schema.names, out])

    return run


def _kept(df: DataFrame, *replaced: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in replaced]


def encode(documents: DataFrame, vocabulary: Vocabulary, seed: int = 1, key: str = "doc_id", text: str = "text", out: str = "pieces") -> DataFrame:
    """`documents` with a sampled segmentation of `text` as piece ids in column `out` (replaced if there)."""
    own = _kept(documents, out)
    schema = T.StructType([*own, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return documents.select(*(f.name for f in own)).mapInArrow(lean(_encoder(vocabulary, seed, key, text, out)), schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """`rows` with the text of the piece ids in column `pieces` as column `out` (replaced if there)."""
    own = _kept(rows, out)
    schema = T.StructType([*own, T.StructField(out, T.StringType())])
    return rows.select(*(f.name for f in own)).mapInArrow(lean(_decoder(vocabulary, pieces, out)), schema)


def encode_and_decode(documents: DataFrame, vocabulary: Vocabulary, seed: int = 1, key: str = "doc_id", text: str = "text", out: str = "pieces", decoded: str = "decoded") -> DataFrame:
    """`documents` with the pieces and the decoded text: both steps in one worker, so the pieces cross to it once."""
    own = _kept(documents, out, decoded)
    schema = T.StructType([*own, T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    into, back = _encoder(vocabulary, seed, key, text, out), _decoder(vocabulary, out, decoded)
    return documents.select(*(f.name for f in own)).mapInArrow(lean(lambda batches: back(into(batches))), schema)
