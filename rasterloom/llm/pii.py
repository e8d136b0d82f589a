"""Personal data and secrets by patterns, checksums and context, in DataFrame functions alone.

Patterns propose spans; validators confirm them (Luhn for cards, mod 97 for IBANs, ranges and digit counts for
the rest); words near a span adjust its score. The four base kinds (email, ip, card, phone) are always
reported once confirmed; the added kinds (iban, ssn, and the secrets key, jwt, private_key and secret) if their score
reaches `threshold`. A `secret` is any long run of token characters with letters and digits that such a word stands by.

A kind's guard is a cheaper test that every text with a match passes; a text that fails it is not searched.

Patterns are written so that a match can only begin where a run begins, and repeat single characters or a
bounded group only: time is linear in the text and no long run can exhaust the regex engine's stack.

Places are code points, from 0, the end exclusive. All of it is one projection: no shuffle.

Edge cases: a null or empty text has no spans; very long texts are scanned whole; bytes that are not UTF-8 count as
Spark's functions count them; repeated rows are scanned alike; spans of different kinds may overlap; an empty table gives
no rows; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 40, 20
_BLOCK = 512
#: Lengths of IBANs and the countries that use them.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: An IBAN of its country's length; what follows may be a capital or digit after a space.
_FITTING = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
#: Else any run, up to where a fitting one begins.
_IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_FITTING}|[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!{_FITTING}))?[A-Z0-9]){{11,30}})"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), body), 0)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(text: Column) -> Column:
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _card(match: Column) -> Column:
    return bound(_digits(match), lambda d: F.length(d).between(13, 19) & _luhn(d))


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _iban(match: Column) -> Column:
    return bound(F.replace(match, F.lit(" "), F.lit("")), lambda s: F.length(s).between(15, 34) & _mod97(s))


def _mixed(match: Column) -> Column:
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]")


def _always(match: Column) -> Column:
    return F.lit(True)


def _has(what: str) -> Callable[[Column], Column]:
    return lambda text: F.contains(text, F.lit(what))


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


@dataclass(frozen=True)
class Kind:
    """`base` kinds need no score. `alone`: no letter or digit may touch the span. Scores are prior + lift if a context word is near.

    `guard` is true of every text in which the pattern matches.
    """

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    base: bool
    alone: bool
    prior: float
    lift: float
    context: str
    guard: Callable[[Column], Column] = _always


_SECRETS = "token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential"

KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)", _always, True, False, 0.9, 0.1, "mail|contact|kontakt|correo|courriel", _has("@")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, True, False, 0.7, 0.2, "ip|host|server|address|adresse", _like(r"[0-9]\.[0-9]")),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", _card, True, False, 0.7, 0.3, "card|visa|credit|karte|tarjeta|carte", _like("[0-9][ -]?[0-9]")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone, True, False, 0.6, 0.3, "phone|tel|call|mobile|fax|telefon", _has("+")),
    Kind("iban", _IBAN, _iban, False, True, 0.6, 0.3, "iban|bank|account|konto|cuenta|compte", _like("[A-Z]{2}[0-9]{2}")),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _always, False, True, 0.2, 0.5, "ssn|social|security", _like("[0-9]-[0-9]{2}-[0-9]")),
    Kind("key", r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_live_[0-9A-Za-z]{24,}", _always, False, True, 0.8, 0.1, _SECRETS, _like("A[KS]IA|gh[pousr]_|xox[abprs]-|AIza|k_live_")),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _always, False, True, 0.8, 0.1, _SECRETS, _has(".eyJ")),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*", _always, False, False, 0.8, 0.1, _SECRETS, _has("PRIVATE KEY-----")),
    Kind("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])", _mixed, False, False, 0.2, 0.5, _SECRETS),
]


def _sums(lengths: Column) -> Column:
    """Running totals before each element, block by block, so that long lists cost their length times a block at most."""

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["out"], F.array(acc["t"])).alias("out")), lambda acc: acc)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK)), lambda b: within(F.slice(lengths, (b * _BLOCK + 1).cast("int"), _BLOCK)))
    start = F.struct(F.lit(0).alias("t"), F.array().cast("array<array<int>>").alias("out"))
    joined = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["t"] + b["t"]).alias("t"), F.concat(acc["out"], F.array(F.transform(b["out"], lambda x: x + acc["t"]))).alias("out")), lambda acc: acc["out"])
    return F.flatten(joined)


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind, in order."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def place(matches: Column) -> Column:
        pieces = F.split(text, kind.pattern, -1)
        # pieces and matches take turns; a match starts after its piece
        lengths = F.transform(F.arrays_zip(pieces.alias("p"), matches.alias("m")), lambda z: F.struct(F.length(z["p"]).alias("p"), F.coalesce(F.length(z["m"]), F.lit(0)).alias("m")))
        starts = bound(lengths, lambda own: F.zip_with(_sums(F.transform(own, lambda z: z["p"] + z["m"])), own, lambda t, z: t + z["p"]))
        found = F.zip_with(F.slice(starts, 1, F.size(matches)), matches, lambda s, m: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))
        found = F.filter(found, lambda x: kind.confirm(x["m"]))
        if kind.alone:
            edge = lambda at: F.substr(text, at, F.lit(1)).rlike("^[A-Za-z0-9]")
            found = F.filter(found, lambda x: ~((x["s"] > 0) & edge(x["s"])) & ~edge(x["e"] + 1))
        near = lambda x: F.concat(F.substr(text, F.greatest(x["s"] - BEFORE, F.lit(0)) + 1, F.least(x["s"], F.lit(BEFORE))), F.lit(" "), F.substr(text, x["e"] + 1, F.lit(AFTER)))
        scored = F.transform(found, lambda x: F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), (F.lit(kind.prior) + F.when(F.lower(near(x)).rlike(kind.context), kind.lift).otherwise(0.0)).alias("score")))
        return scored if kind.base else F.filter(scored, lambda x: x["score"] >= THRESHOLD)

    matches = F.when(kind.guard(text), F.regexp_extract_all(text, F.lit(kind.pattern), 0))
    return bound(matches, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(empty))


def find(documents: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end, score) by kind as listed, then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", bound(text, lambda t: F.flatten(F.array(*(_spans(t, k) for k in kinds)))).alias("spans"))


def digest(found: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """The counts and the joined spans of find()."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = [k.name for k in kinds if k.base]
    count = lambda name: F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *map(count, base), F.sha2(shown(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
