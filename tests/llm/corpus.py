"""A small corpus with the awkward rows every operator must stand, and plain-Python models of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, h long"


def documents(seed=7):
    """Rows (doc_id, text, lang, source, and two columns whose names clash with those of results)."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "été", "naïve", "日本", "x1", "Zeta", "end."] + [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(30)
    base = prose(120)
    texts = [prose(40) for _ in range(10)]
    texts += [base, base, base.replace("alpha", "alpha2", 1), base.upper(), prose(20) + " " + shared, shared + "\n" + prose(10), prose(5) + "  " + shared + "\t" + prose(7)]
    lines = [prose(6) for _ in range(5)]
    texts += ["\n".join(lines), "\n".join([prose(3), *lines, prose(3)]), "\n".join(lines[:2]), "\n\n".join(lines), "\n".join(lines * 3)]
    texts += ["", " \t\n ", None, "one", "one two three", "one two three", "a b c d e", "@@@ ### ***", "THE QUICK BROWN FOX " * 12, "same same " * 40, "\n\n\n", "x" * 5000]
    texts += [prose(4000)]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}", 1, 2) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, texts[4], "en", None, None, None))
    rows.append((None, None, None, None, None, None))
    rng.shuffle(rows)
    return rows


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
