"""Language profiles, host trust, piece lattices, resharding, components and the pipeline."""

import itertools
import math
import random

import numpy as np
import pytest

pytest.importorskip("rasterloom.llm")

import pyarrow as pa
from corpus import SCHEMA, documents
from pyspark.sql import functions as F

from rasterloom.llm import langid, pieces, resharding, urlgraph
from rasterloom.llm.components import components
from rasterloom.llm.textcore import chunks


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


def test_language_profiles(spark):
    rng = random.Random(3)
    stems = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "tz", "ung"], "cc": ["eau", "oi", "ché"]}
    rows = [(i, " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(12)), lang) for i, lang in enumerate(sorted(stems) * 40)]
    rows += [(900, None, "aa"), (901, "123 ...", "bb"), (902, "", "cc"), (None, "kalomi kalo", "aa"), (903, "schtz", None), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    right = [got[d].lang_pred == lang for d, t, lang in rows if d is not None and d < 900 and got[d].held_out]
    assert len(right) > 10 and all(right)
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902))
    assert got[903].lang_pred == "bb" and got[None].held_out is False
    again = {r.doc_id: r for r in langid.identify(df.repartition(7)).collect()}
    assert got == again
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_score_is_the_cosine_of_the_bundle(spark):
    """The table of products gives what bundling whole vectors gives."""
    profiles = langid.Profiles.get()
    (chunk,) = chunks(pa.array(["kalo mika", "tzung é"]))
    grams, edges, letters = profiles.grams(chunk)
    prototypes = np.random.default_rng(0).integers(-1000, 1000, (3, langid.DIMS))
    products = langid.Scorer(prototypes)(grams)
    for i in range(2):
        bundle = profiles.vectors(grams[edges[i] : edges[i + 1]]).astype(np.int64).sum(axis=0)
        assert (products[edges[i] : edges[i + 1]].sum(axis=0) == prototypes @ bundle).all()
    assert letters.tolist() == [8, 6]


def bundle_model(text):
    """A text's bundle, trigram by trigram, letter by letter."""
    letters = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spaced = [0]
    for c in letters:
        if c.isalpha() or spaced[-1] != 0:
            spaced.append(ord(c) if c.isalpha() else 0)
    spaced += [0] if spaced[-1] else []
    vector = lambda p: langid.Profiles.letter_vectors(np.array([p]))[0].astype(np.int64)
    out = np.zeros(langid.DIMS, dtype=np.int64)
    for a, b, c in zip(spaced, spaced[1:], spaced[2:], strict=False):
        if b:
            out += vector(a) * np.roll(vector(b), 1) * np.roll(vector(c), 2)
    return out


def test_languages_against_plain_bundles(spark):
    """Train and predict, in several scripts, against whole vectors."""
    rng = random.Random(8)
    stems = {"el": ["και", "του", "ής"], "ja": ["日本", "東京", "のは"], "ru": ["ого", "ние", "Ста"], "uk": ["ого", "ння", "Ста"]}
    rows = [(i, " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(5)) + "!", lang) for i, lang in enumerate(sorted(stems) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    raw = np.stack([sum(bundle_model(t) for d, t, lang in rows if lang == own and not got[d].held_out) for own in sorted(stems)]).astype(float)
    unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    unit = unit - unit.mean(axis=0)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    right = 0
    for d, t, lang in rows:
        cosines = np.rint(unit * (1 << 24)) @ bundle_model(t)
        assert got[d].lang_pred == sorted(stems)[int(cosines.argmax())]
        assert math.isclose(got[d].score, cosines.max() / np.maximum(cosines, 0).sum(), abs_tol=1e-6)
        right += got[d].lang_pred == lang and got[d].held_out
    assert right >= 0.9 * sum(r.held_out for r in got.values())


@pytest.mark.parametrize("n", [40, 200])
def test_many_languages(spark, n):
    """Languages that differ in their favourite syllables alone; a task sends one row for each language and dimension."""
    rng = random.Random(n)
    letters = "абвгдежзиклмнопрстуфхцчшыэюя"
    own = {f"l{k:03}": ["".join(rng.choices(letters, k=3)) for _ in range(6)] for k in range(n)}
    rows = [(i, " ".join("".join(rng.choices(own[lang], k=2)) for _ in range(15)), lang) for i, lang in enumerate(sorted(own) * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    sent = df.select("text", "lang").mapInArrow(langid._train, "lang string, dim int, v long").groupBy("lang", "dim").count()
    assert sent.count() == n * langid.DIMS and sent.filter("count > 2").count() == 0
    got = [(r.lang_pred, lang) for r in langid.identify(df).collect() if r.held_out for d, _, lang in rows if d == r.doc_id]
    assert sum(a == b for a, b in got) > 0.95 * len(got) > 50


def test_bounds_change_no_result():
    """Small tables of products, letters and counts give what large ones give."""
    profiles = langid.Profiles()
    texts = ["kalo mika été", "日本 の はな", "каша"] * 5
    (chunk,) = chunks(pa.array(texts))
    grams, edges, _ = profiles.grams(chunk)
    prototypes = np.random.default_rng(0).integers(-1000, 1000, (3, langid.DIMS))
    small = langid.Scorer(prototypes, limit=12)
    parts = np.concatenate([small.sums(grams[a:b], np.array([0, b - a])) for a, b in itertools.pairwise(edges.tolist())])
    assert (parts == langid.Scorer(prototypes).sums(grams, edges)).all()
    few, many = langid.Bundles(limit=3), langid.Bundles()
    for k, (a, b) in enumerate(itertools.pairwise(edges.tolist())):
        for bundles in (few, many):
            bundles.add(f"l{k % 2}", grams[a:b])
    assert all((few.fold()[lang] == total).all() for lang, total in many.fold().items())


def test_held_out_accuracy_on_the_corpus(spark):
    import os

    where = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(where):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(where).select("doc_id", "text", "lang")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right, every = got.filter("lang = lang_pred").count(), got.count()
    print("held-out accuracy", right / every, "of", every)
    assert every > 100 and right / every > 0.93


def test_texts_that_are_not_unicode_or_very_long(spark):
    df = spark.sql("select 1L as doc_id, cast(X'6b61ff6c6f20' as string) as text, 'aa' as lang, 'x' as held_out union all select 2, repeat('kalo mika ', 300000), 'aa', 'y' union all select 6, repeat('sch tzung ', 10), 'bb', 'y'")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert set(got) == {1, 2, 6} and got[2].lang_pred in ("aa", "bb")


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(df.limit(0)).count() == 0


RULES = [urlgraph.Rule("good.org", "/", "allow"), urlgraph.Rule("bad.com", "/", "block"), urlgraph.Rule("bad.com", "/ok/", "allow")]
PAGES = [
    (1, "http://good.org/a?x#y", '<a href="http://n1.net/x">1</a> <A HREF=\'//n2.net\'>2</a>'),
    (2, "https://WWW.Good.org", '<a href=http://n1.net/y>1</a><a href="/local">l</a>'),
    (3, "http://n3.net/p", '<a href="http://bad.com/">b</a>'),
    (4, "http://n4.net/p", '<a href="http://n3.net/">b</a>'),
    (5, "http://bad.com/x", None),
    (6, "http://sub.bad.com/ok/1", ""),
    (7, "http://n1.net/", '<a href="http://n1.net/self">s</a>'),
    (8, None, '<a href="http://bad.com/">b</a>'),
    (9, "no scheme", "x"),
    (10, "ftp://n9.net", "x"),
    (10, "ftp://n9.net", "x"),
    (11, "http://notbad.com/x", ""),
]


def test_host_trust(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r.page_id: r for r in urlgraph.judge(df, RULES).collect()}
    edges = {("good.org", "n1.net"): 1, ("good.org", "n2.net"): 1, ("www.good.org", "n1.net"): 1, ("n3.net", "bad.com"): 1, ("n4.net", "n3.net"): 1}
    assert {(r.src, r.dst): r.w for r in urlgraph.host_edges(df).collect()} == edges

    def walk(edges, seeds):
        now = dict(seeds)
        for _ in range(urlgraph.ROUNDS):
            nxt = {h: s * (1 - urlgraph.DAMPING) for h, s in seeds.items()}
            for (a, b), w in edges.items():
                total = sum(v for (x, _), v in edges.items() if x == a)
                nxt[b] = nxt.get(b, 0) + now.get(a, 0) * w / total * urlgraph.DAMPING
            now = nxt
        return now

    trust = walk(edges, {"good.org": 1 / 2, "sub.bad.com": 1 / 2})
    distrust = walk({(b, a): w for (a, b), w in edges.items()}, {"bad.com": 1.0})
    for r in urlgraph.host_scores(df, RULES).collect():
        assert math.isclose(r.trust, trust.get(r.host, 0), abs_tol=1e-12) and math.isclose(r.distrust, distrust.get(r.host, 0), abs_tol=1e-12)
    verdicts = {k: v.verdict for k, v in got.items()}
    assert verdicts == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}
    assert (got[1].host, got[1].path, got[1].rule) == ("good.org", "/a", "good.org/")
    assert (got[6].rule, got[5].rule, got[2].host, got[2].path, got[8].host) == ("bad.com/ok/", "bad.com/", "www.good.org", "", "")
    assert urlgraph.judge(df, RULES).count() == len(PAGES)
    assert urlgraph.judge(df.limit(0), RULES).count() == 0


def test_unrelated_pages_leave_verdicts(spark):
    df = spark.createDataFrame([(20, "http://bad.com/ok/no", None), *PAGES, (21, "http://small.net/x", ""), (22, "http://small.net/bad/1", ""), (23, "http://n5.net/", '<a href="http://small.net/">s</a>')], "page_id long, url string, html string")
    rules = [*RULES, urlgraph.Rule("small.net", "/bad/", "block"), urlgraph.Rule("else.net", "/", "block")]
    more = spark.range(200_000).select((F.col("id") + 1000).alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".else.net/")).alias("url"), F.lit("").alias("html"))
    got = {r.page_id: r.verdict for r in urlgraph.judge(df.union(more), rules).filter("page_id < 1000").collect()}
    assert {k for k, v in got.items() if v == "block"} == {3, 4, 5, 21, 22, 23}


@pytest.mark.parametrize(("seeds", "rule"), [(10, "allow"), (100_000, "allow"), (10, "block"), (100_000, "block")])
def test_seeds_elsewhere_leave_hosts_with_both_scores_alone(spark, seeds, rule):
    """m.net is linked from one allowed page and links to two blocked ones; t.net the other way round."""
    pages = [
        (1, "http://good.org/1", '<a href="http://m.net/">m</a><a href="http://t.net/">t</a>'),
        (2, "http://good.org/2", '<a href="http://t.net/">t</a>'),
        (3, "http://m.net/x", '<a href="http://bad.com/">b</a>'),
        (4, "http://t.net/x", '<a href="http://bad.com/">b</a><a href="http://c1.net/">c</a><a href="http://c2.net/">c</a><a href="http://c3.net/">c</a>'),
        (5, "http://bad.com/x", ""),
        (6, "http://bad.com/y", ""),
    ]
    more = spark.range(seeds).select((F.col("id") + 1000).alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".else.net/")).alias("url"), F.lit("").alias("html"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = [*RULES, urlgraph.Rule("else.net", "/", rule)]
    verdicts = {r.page_id: r.verdict for r in urlgraph.judge(df.union(more), rules).filter("page_id < 1000").collect()}
    assert verdicts == {r.page_id: r.verdict for r in urlgraph.judge(df, rules).collect()}
    assert (verdicts[3], verdicts[4]) == ("block", "allow")


def test_pages_keep_their_meaning_beside_odd_columns(spark):
    df = spark.createDataFrame([(p, u, h, "x", "y", "z") for p, u, h in PAGES] + [(50, "http://long.net/", "<p>" * 400_000 + '<a href="//bad.com/">', "x", "y", "z")], "page_id long, url string, html string, host string, verdict string, bad string")
    got = {r.page_id: r for r in urlgraph.judge(df, [*RULES, urlgraph.Rule("bad.com", "/a/", "allow"), urlgraph.Rule("bad.com", "/b/", "block")]).collect()}
    assert got[1].host == "good.org" and got[5].verdict == "block" and got[50].verdict == "block"


def test_trust_goes_as_far_as_links(spark):
    chain = [(k, f"http://c{k}.net/", f'<a href="http://{f"c{k - 1}.net" if k > 1 else "bad.com"}/">n</a>') for k in range(1, 13)]
    df = spark.createDataFrame([*chain, (100, "http://bad.com/", "")], "page_id long, url string, html string")
    assert {r.verdict for r in urlgraph.judge(df, RULES).collect()} == {"block"}


def vocabulary():
    letters = "abcdeh▁tn"
    own = [*letters, "the", "▁the", "he", "▁t", "an", "▁▁", "then", "▁a", "ab", "bc", "abc"]
    names = [""] * 3 + [""] * 256 + own
    weights = np.full(len(names), -np.inf)
    weights[259:] = -np.log(2 + np.arange(len(own)))
    return pieces.Vocabulary(names, weights, np.arange(3, 259))


TEXTS = ["the then abc", "", None, " ", "  a  the▁b\nç日 t", "qqq", "▁", "then" * 50, "a b c d e h t n " * 20]


def lattice_model(v, text, key):
    """Forward filtering and backward sampling of one text, symbol by symbol."""
    if not text:
        return []
    symbols = [pieces.MARK] + [pieces.MARK if c == " " else pieces._LITERAL if ord(c) == pieces.MARK else ord(c) for c in text]
    table = {p: i for i, p in enumerate(v.pieces) if p}
    tied = {(ord(a), ord(b)) for p in table for a, b in zip(p, p[1:], strict=False)}
    low, out, segments = 3 * min(w for w in v.weights if np.isfinite(w)), [], []
    for i, s in enumerate(symbols):
        if i and (symbols[i - 1], s) in tied:
            segments[-1].append(s)
        else:
            segments.append([s])
    for number, own in enumerate(segments):
        alpha, edges = [0.0], [None]
        for j in range(1, len(own) + 1):
            found = []
            for n in range(1, j + 1):
                part = own[j - n : j]
                piece = table.get("".join(map(chr, part))) if pieces._LITERAL not in part else None
                if piece is not None:
                    found.append((n, piece, alpha[j - n] + v.weights[piece]))
                elif n == 1:
                    found.append((1, -1 - part[0], alpha[j - 1] + low))
            top = max(a for *_, a in found)
            whole = sum(math.exp(a - top) for *_, a in found)
            alpha.append(top + math.log(whole))
            edges.append([(n, i, math.exp(a - top) / whole) for n, i, a in found])
        j, step, drawn = len(own), 0, []
        while j:
            u, run = float(pieces.uniform(np.array([key]), np.array([number]), step)[0]), 0.0
            for n, i, p in edges[j]:
                run += p
                if u < run:
                    break
            drawn.append(i)
            j, step = j - n, step + 1
        for i in reversed(drawn):
            out += [i] if i >= 0 else [int(v.byte_ids[b]) for b in chr(pieces.MARK if -1 - i == pieces._LITERAL else -1 - i).encode()]
    return out


def test_sampled_pieces(spark):
    v = vocabulary()
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "the", 0), (0, TEXTS[0], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces int")
    got = pieces.decode(pieces.encode(df, v, seed=5), v).collect()
    assert all(r.decoded == r.text for r in got)
    for r in got:
        key = pieces.row_keys(np.array([-1 if r.doc_id is None else r.doc_id]), 5)[0]
        assert r.pieces == (None if r.text is None else lattice_model(v, r.text, key)), r.text
    again = pieces.encode(df.repartition(5), v, seed=5).collect()
    assert {(r.doc_id, r.text): r.pieces for r in again} == {(r.doc_id, r.text): r.pieces for r in got}
    other = pieces.encode(df, v, seed=6).collect()
    assert {(r.doc_id, r.text): r.pieces for r in other} != {(r.doc_id, r.text): r.pieces for r in got}
    assert pieces.encode(df.limit(0), v).count() == 0
    both = pieces.encode_and_decode(df, v, seed=5).collect()
    assert {(r.doc_id, r.text): (r.pieces, r.decoded) for r in both} == {(r.doc_id, r.text): (r.pieces, r.text) for r in got}


def test_bytes_that_are_not_unicode_come_back(spark):
    v = vocabulary()
    df = spark.sql("select 1L as doc_id, cast(X'746865ff20c3' as string) as text, 'a' as pieces, 'b' as decoded union all select 2, 'the', 'a', 'b' union all select null, cast(X'80' as string), 'a', 'b'")
    got = pieces.encode_and_decode(df, v, out="mine", decoded="back")
    assert got.columns == ["doc_id", "text", "pieces", "decoded", "mine", "back"]
    assert got.filter("text <=> back").count() == 3 and got.filter("pieces = 'a' and decoded = 'b'").count() == 3
    assert {r.doc_id: r.mine for r in got.collect()}[None][-1] == v.byte_ids[0x80]


def test_long_pieces():
    names = ["", *[""] * 256, "▁", "a", "a" * 100, "▁" + "a" * 70]
    weights = np.full(len(names), -np.inf)
    weights[257:] = [-1.0, -5.0, -1.0, -1.0]
    v = pieces.Vocabulary(names, weights, np.arange(1, 257))
    sampler, text = pieces.Sampler(v), "a" * 170
    key = pieces.row_keys(np.array([4]), 1)
    ids, _ = sampler.draw(np.array([ord(c) for c in text]), np.array([0, len(text)]), key)
    assert "".join(names[i] for i in ids) == "▁" + text and max(len(names[i]) for i in ids) >= 71


def test_pieces_are_drawn_with_their_probability():
    v = vocabulary()
    sampler = pieces.Sampler(v)
    n = 20_000
    points = np.tile(np.array([ord(c) for c in "the"]), n)
    ids, stops = sampler.draw(points, np.arange(n + 1) * 3, pieces.row_keys(np.arange(n), 1))
    seen = {}
    for a, b in itertools.pairwise(stops.tolist()):
        k = tuple(v.pieces[i] for i in ids[a:b])
        seen[k] = seen.get(k, 0) + 1 / n
    table = {p: v.weights[i] for i, p in enumerate(v.pieces) if p}
    whole = {}
    text = "▁the"
    for cuts in itertools.product([0, 1], repeat=3):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), 4]
        parts = tuple(text[a:b] for a, b in itertools.pairwise(at))
        if all(p in table for p in parts):
            whole[parts] = math.exp(sum(table[p] for p in parts))
    total = sum(whole.values())
    assert set(seen) <= set(whole)
    for k, p in whole.items():
        assert abs(seen.get(k, 0) - p / total) < 0.02


def test_cache_that_overflows_changes_nothing():
    v = vocabulary()
    small, large = pieces.Sampler(v, cache_symbols=4), pieces.Sampler(v)
    for text in ("the abc then", "abc the", "the abc then"):
        points = np.array([ord(c) for c in text])
        args = (points, np.array([0, len(text)]), pieces.row_keys(np.array([1]), 1))
        assert small.draw(*args)[0].tolist() == large.draw(*args)[0].tolist()


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(30):
        old, shards = 3, rng.choice([2, 3, 4])
        sizes = [[rng.choice([1, 2, 4, 8]) for _ in range(rng.randrange(0, 5))] for _ in range(old)]
        supply = {}
        for i, own in enumerate(sizes):
            for s in own:
                n, b = supply.get((i, s), (0, 0))
                supply[i, s] = (n + 1, b + s)
        home = {i: i for i in range(min(old, shards))}
        got = resharding.solve(supply, shards, home)
        cost = sum(n * key[1] for key, to in got.items() for j, n in to.items() if home.get(key[0]) != j)
        counts = [sum(to.get(j, 0) for to in got.values()) for j in range(shards)]
        total = sum(map(len, sizes))
        assert sum(counts) == total and max(counts) - min(counts) <= 1
        assert all(sum(got.get(k, {}).values()) == n for k, (n, _) in supply.items())
        floor, odd = divmod(total, shards)
        best = math.inf
        for extra in itertools.combinations(range(shards), odd):
            lost = 0
            for i, own in enumerate(sizes):
                keep = floor + (home.get(i) in extra) if i in home else 0
                lost += sum(sorted(own)[: max(0, len(own) - keep)])
            best = min(best, lost)
        assert cost == best


def test_resharding(spark, docs, tmp_path):
    placed = resharding.reshard(docs)
    rows = placed.collect()
    assert len(rows) == len(documents())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and r.size >= 8
    counts = [len(by.get(j, [])) for j in range(resharding.NEW_SHARDS)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    touched = resharding.rewrite_affected(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    moved = {r.shard for r in rows if r.moved} | {r.old for r in rows if r.moved}
    assert touched == sorted(moved)
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {j: len(by[j]) for j in touched if j in by}
    assert resharding.reshard(docs.limit(0)).count() == 0


def test_rows_that_move_have_the_fewest_bytes(spark):
    """Unequal sizes within a factor of two and beyond, ties, empty shards, rows without a shard, more and fewer new shards."""
    rng = random.Random(11)
    for turn in range(8):
        shards, n_old = rng.choice([2, 3, 5]), rng.choice([1, 3, 4])
        rows = [(i, "x" * rng.choice([0, 7, 8, 9, 15, rng.randrange(3000)]), rng.choice([0, 0, 0, *range(n_old), None])) for i in range(rng.randrange(1, 60))]
        df = spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(2)
        got = resharding.reshard(df, old=F.col("at"), shards=shards).collect()
        assert sorted(r.doc_id for r in got) == [i for i, *_ in rows]
        counts = [sum(r.shard == j for r in got) for j in range(shards)]
        assert max(counts) - min(counts) <= 1
        own = [sorted(len(t) + 8 for _, t, a in rows if a == i) for i in range(n_old)]
        floor, odd = divmod(len(rows), shards)
        fixed = sum(len(t) + 8 for _, t, a in rows if a is None or a >= shards)
        best = min(fixed + sum(sum(own[i][: max(0, len(own[i]) - floor - (i in extra))]) for i in range(min(n_old, shards))) for extra in itertools.combinations(range(shards), odd))
        assert sum(r.size for r in got if r.moved) == best, turn


def test_rewrite_of_rows_with_clashing_names(spark, tmp_path):
    rows = [(i % 4 if i % 5 else None, "t" * (i % 3) if i % 7 else None, f"s{i % 3}", i, "c", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _crc long, copy string, old int").repartition(3)
    placed = resharding.reshard(df, shards=5)
    shards = resharding.rewrite_affected(df, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*df.columns, "shard"}
    assert sorted(map(repr, (tuple(r) for r in back.select(*df.columns).collect()))) == sorted(map(repr, rows))
    counts = {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()}
    assert counts == {j: 12 for j in range(5)} and shards == list(range(5))
    resharding.rewrite_affected(df.withColumn("shard", F.lit(9)), placed, str(tmp_path / "other"))
    other = spark.read.parquet(str(tmp_path / "other"))
    assert other.filter("shard = 9").count() == 60 and {r["shard_"]: r["count"] for r in other.groupBy("shard_").count().collect()} == counts


def test_equal_rows_of_different_shards_are_told_apart(spark, tmp_path):
    df = spark.createDataFrame([(i, "a", str(s)) for i in range(20) for s in ((0, 1), (1, 0))[i % 2]] + [(99, "b", "1")], "doc_id long, text string, source string")
    rows = df.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.col("source").cast("int").alias("old"))
    placed = rows.withColumn("shard", F.when(F.col("doc_id") == 99, 2).otherwise(F.col("old"))).withColumn("moved", F.col("doc_id") == 99)
    assert resharding.rewrite_affected(df, placed, str(tmp_path / "out"), old=F.col("source").cast("int")) == [1, 2]
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "source", "shard").collect()
    assert sorted(map(tuple, back)) == [*((i, "1", 1) for i in range(20)), (99, "1", 2)]


def test_equal_rows_and_many_sources_crowd_no_task(spark, tmp_path, monkeypatch):
    """Rows without doc_id and text, more sources than are shards of their own, old shards beyond the new ones; blocks and crowds small, so that all are cut."""
    for name, value in (("MAX_OLD", 3), ("LEAST_BLOCK", 16), ("CROWD", 40)):
        monkeypatch.setattr(resharding, name, value)
    rows = [(None, None, "s0", "e")] * 150 + [(i, "t" * (i % 9), f"s{i % 40}", "f") for i in range(300)] + [(1, "u", "s1", "g")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string").repartition(3)
    placed = resharding.reshard(df, shards=7)
    got = placed.collect()
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(d), len(t or "") + 8) for d, t, *_ in rows)
    by = {j: sorted(r.slot for r in got if r.shard == j) for j in range(7)}
    assert all(v == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} == {77, 78}
    assert {r.old for r in got} == {-1, 0, 1, 2}
    resharding.rewrite_affected(df, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {j: len(v) for j, v in by.items()}
    assert sorted(map(repr, (tuple(r) for r in back.select(*df.columns).collect()))) == sorted(map(repr, rows))
    numbers = resharding.reshard(df, old=F.coalesce("doc_id", F.lit(2)), shards=7).collect()  # 300 old shards, 7 new
    assert {r.old for r in numbers} == set(range(300)) and {sum(r.shard == j for r in numbers) for j in range(7)} == {77, 78}


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: top(n) for n in linked}


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from rasterloom.llm import minhash, quality

    spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s, *_ in documents()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    texts = {d: t for d, t, *_ in documents()}
    spark.createDataFrame([(1, texts[2])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    sizes = []
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, before, str(tmp_path))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        ids = {r.doc_id for r in docs.collect()}
        if name == "quality_rules":
            assert sizes[-1] == quality.judge(before).filter("kept").count()
        if name == "near_dedup":
            assert ids == {r.doc_id for r in minhash.near_duplicates(before).filter("kept").collect()}
        if name == "decontamination":
            assert 2 not in ids
    assert sizes[0] > sizes[2] >= sizes[3] == sizes[4]
    assert docs.filter(~F.col("lossless")).count() == 0
    whole = pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, whole.select("doc_id", "text", "pieces").collect())) == sorted(map(repr, docs.select("doc_id", "text", "pieces").collect()))
    assert all(len(r.pieces) > 0 for r in docs.collect())
