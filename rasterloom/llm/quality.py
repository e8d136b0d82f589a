"""Quality rules as a short-circuit cascade.

A bounded sample gives each rule's cost (seconds a megabyte) and selectivity (share of texts it
rejects); rules then run by falling rejection per cost, and a text leaves at its first rejection.
The verdict is the conjunction of all rules, so the order affects time alone, never the result.

Edge cases: a null or empty text has no words, all measures are 0, and it fails the base (fewer than
20 words); a text without words divides by nothing, as all rules compare products of integers; very long texts are
judged whole; bytes that are not UTF-8 count as they are; repeated rows are judged alike; an empty table gives no rows and
leaves the rules in the order given; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.llm.textcore import SPACED, Chunk, Words, chunks, lean, take

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: At most so many rows are timed to order the cascade. It orders the rules; it decides nothing.
SAMPLE_ROWS, SAMPLE_PARTS = 200, 4

_SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_STARTS = (np.arange(256) & 0xC0) != 0x80
_LOWER = np.isin(np.arange(256), np.arange(97, 123))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTERS = _LOWER | _UPPER | (np.arange(256) >= 0xC3)
_LINES = re.compile(rb"[^\x20\x09-\x0D]")


def _per_row(chunk: Chunk, marks: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return np.diff(total[chunk.bounds])


def _per_row_words(words: Words, marks: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[words.first])


def _word_letters(chunk: Chunk, words: Words) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTERS[chunk.data], dtype=np.int64)])
    return total[words.ends] - total[words.starts]


def base(chunk: Chunk) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and per text: characters in words, symbols, repeated lines, words in repeated 8-word windows."""
    words = Words(chunk, SPACED)
    chars = _per_row(chunk, SPACED.is_word[chunk.data] & _STARTS[chunk.data])
    symbols = _per_row(chunk, _SYMBOLS[chunk.data])
    lines = np.zeros(len(words.count), dtype=np.int64)
    several = _per_row(chunk, chunk.data == 10) > 0
    for r in np.flatnonzero(several):
        own = [x for x in chunk.text(r).split(b"\n") if _LINES.search(x)]
        lines[r] = len(own) - len(set(own))
    at, keys = words.windows(REPEAT_WINDOW)
    repeated = np.zeros(len(words.hashes) + 1, dtype=np.int32)
    if len(at):
        order = np.lexsort((keys, words.row[at]))
        k, r = keys[order], words.row[at][order]
        same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        twice = np.zeros(len(k), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        starts = at[order][twice]
        np.add.at(repeated, starts, 1)
        np.add.at(repeated, starts + REPEAT_WINDOW, -1)
    return words, chars, symbols, lines, _per_row_words(words, np.cumsum(repeated[:-1]) > 0)


@dataclass(frozen=True)
class Rule:
    """`rejects` gets (chunk, words, base measures) of the texts still in and marks those to go."""

    name: str
    rejects: Callable[[Chunk, Words, dict], np.ndarray]


def _symbols(chunk, words, m):
    """More than one symbol for ten words."""
    return 10 * m["n_symbols"] > words.count


def _word_length(chunk, words, m):
    """A mean word length outside 2 to 12 characters."""
    return (m["word_chars"] < 2 * words.count) | (m["word_chars"] > 12 * words.count)


def _lines(chunk, words, m):
    """Five lines or more repeat an earlier one, and they are over half of all."""
    return (m["n_dup_lines"] >= 5) & (2 * m["n_dup_lines"] > _per_row(chunk, chunk.data == 10) + 1)


def _shouting(chunk, words, m):
    """More than half of the ASCII letters are capitals."""
    upper, lower = _per_row(chunk, _UPPER[chunk.data]), _per_row(chunk, _LOWER[chunk.data])
    return upper > lower


def _letters(chunk, words, m):
    """Under 70 % of words hold a letter (A-Z, a-z, or any character from U+00C0 on)."""
    return 10 * _per_row_words(words, _word_letters(chunk, words) > 0) < 7 * words.count


def _stutter(chunk, words, m):
    """Over 20 % of words equal the word before them."""
    h = words.hashes
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    return 5 * _per_row_words(words, same) > words.count


RULES = [Rule("symbols", _symbols), Rule("word_length", _word_length), Rule("lines", _lines), Rule("shouting", _shouting), Rule("letters", _letters), Rule("stutter", _stutter)]

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _subset(chunk: Chunk, rows: np.ndarray) -> Chunk:
    if len(rows) == len(chunk.bounds) - 1:
        return chunk
    parts = [chunk.data[chunk.bounds[r] : chunk.bounds[r + 1]] for r in rows]
    return Chunk(0, len(rows), np.concatenate([*parts, np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), chunk.valid[rows])


def _cascade(chunk: Chunk, words: Words, measures: dict, keep: np.ndarray, rules: list[Rule]) -> np.ndarray:
    """What of `keep` passes all rules. Texts rejected so far are cut out once they are half of the chunk."""
    keep, rows = keep.copy(), np.arange(len(keep))
    for rule in rules:
        left = keep[rows]
        if not left.any():
            break
        if 2 * left.sum() <= len(left):
            rows = rows[left]
            chunk, measures = _subset(chunk, np.flatnonzero(left)), {k: v[left] for k, v in measures.items()}
            words = Words(chunk, SPACED)
        keep[rows] &= ~rule.rejects(chunk, words, measures)
    return keep


def judge_chunk(chunk: Chunk, rules: list[Rule]) -> list[np.ndarray]:
    words, chars, symbols, lines, repeats = base(chunk)
    n = words.count
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    measures = {"word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines}
    return [n, chars, symbols, lines, repeats, failed, _cascade(chunk, words, measures, ~failed, rules)]


def _sample(documents: DataFrame, rows: int, parts: int) -> list[str | None]:
    """The first texts of a few partitions, spread over the table; all of them, up to `rows`, where these hold none."""
    texts = documents.select("text").rdd
    n = texts.getNumPartitions()
    if not n:
        return []
    each, chosen = -(-rows // min(parts, n)), sorted({(2 * k + 1) * n // (2 * parts) for k in range(parts)})
    found = documents.sparkSession.sparkContext.runJob(texts, lambda own: [r[0] for r in itertools.islice(own, each)], chosen)
    return found or [r[0] for r in documents.select("text").take(rows)]


def order_rules(documents: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, sample_parts: int = SAMPLE_PARTS) -> list[Rule]:
    """The rules by falling rejection per cost, both estimated on a sample of about `sample_rows` texts.

    It reads the beginnings of `sample_parts` partitions, so it costs as many tasks at any size.
    """
    sample = _sample(documents, sample_rows, sample_parts)
    if not sample:
        return rules
    timed = []
    parts = [(c, *base(c)) for c in chunks(pa.array(sample, type=pa.large_string()))]
    for at, rule in enumerate(rules):
        began, rejected, rows = time.perf_counter(), 0, 0
        for chunk, words, chars, symbols, lines, _ in parts:
            out = rule.rejects(chunk, words, {"word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines})
            rejected, rows = rejected + int(out.sum()), rows + len(out)
        cost = max(time.perf_counter() - began, 1e-6)
        timed.append((-(rejected / rows) / cost, cost, at, rule))
    return [rule for *_, rule in sorted(timed, key=lambda x: x[:3])]


def judge(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: the base measures, and whether it is kept."""
    ordered = order_rules(documents) if rules is None else rules

    def run(batches):
        for batch in batches:
            ids = take(batch, "doc_id").cast(pa.int64())
            parts = [judge_chunk(c, ordered) for c in chunks(take(batch, "text"))]
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)] * 2
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=pa.bool_() if c.dtype == bool else pa.int64()) for c in cols)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)


def keep_good(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """`documents` without the rejected ones, decided on the row itself."""
    ordered = order_rules(documents) if rules is None else rules

    def run(batches):
        for batch in batches:
            parts = [judge_chunk(c, ordered)[-1] for c in chunks(take(batch, "text"))]
            yield batch.filter(pa.array(np.concatenate(parts) if parts else np.zeros(0, bool)))

    return documents.mapInArrow(lean(run), documents.schema)
