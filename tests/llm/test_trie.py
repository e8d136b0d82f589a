"""op13 against a trie built plainly."""

import hashlib
import random
import zlib

import pytest

from rasterloom import joins
from rasterloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c > 0 else -1)
        full = own.get(c - rest, [])[:h] + mine[h:]
        for d in range(len(full) + 1):
            members.setdefault(tuple(full[:d]), []).append((c, len(full) == d))
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        leaves, saved = 0, (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        for x in kids.get(k, []):
            a, b = done[x]
            leaves, saved = leaves + a, saved + b
        return leaves or 1, saved

    done, out = {}, []
    for k in sorted(members, key=len, reverse=True):
        done[k] = below(k)
    low = {k: min(c for c, _ in m) for k, m in members.items()}
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c, e in m if e)))
        out.append((low[k], len(k), low[k[:-1]] if k else None, len(m), len(kids.get(k, [])), *done[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def _random(seed, convs, turns, words):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-12, 4 * convs), convs):
        for t in range(r.randint(1, turns)):
            rows.append((c, t, r.choice(["user", "assistant"]) if t > 1 else "user", r.choice(["é", "b" * 40, "b" * 39 + "c", ""][:words])))
    r.shuffle(rows)
    return rows


def test_random_conversations(spark):
    check(spark, _random(1, 60, 12, 2))


def test_small_blocks_and_crowded_keys(spark, monkeypatch):
    """Conversations that go over several blocks, keys beyond the share that is looked up by broadcast, and tables too large for it."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(joins, "FEW", 5)
    monkeypatch.setattr(joins, "SMALL", 1)
    check(spark, _random(2, 40, 30, 3))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(0, None, "user", "first"), (0, 1, None, None), (0, 1, "a", "x"), (0, 1, "a", "x"), (1, 5, "user", "y"), (None, 0, "user", "z"), (7, 0, "user", "q"), (8, 0, "user", "q"), (9, None, None, None)]
    check(spark, rows)


def test_one_long_conversation_holds_most_rows(spark):
    rows = [(3, t, "user", f"turn {t % 7}") for t in range(600)] + [(5 * k, 0, "user", "hello") for k in range(200)]
    check(spark, rows)


def test_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", d long, path string, n_convs int")
    assert trie.prefix_trie(empty).collect() == []
    more = spark.createDataFrame([(10, 0, "user", "x", 1, "p", 2)], SCHEMA + ", d long, path string, n_convs int")
    assert sorted(map(tuple, trie.prefix_trie(more).collect()), key=repr) == plain([(10, 0, "user", "x")])


@pytest.mark.parametrize("c", [2**63 - 1, -(2**63)])
def test_extreme_numbers(spark, c):
    check(spark, [(c, 0, "user", "x" * 100_000), (c, 1, "user", "y")])
