"""URL filters: rules by host and path, and trust spread over the link graph where no rule fits.

A host's trust is a personalised PageRank walk along links from the hosts of allowed pages; its distrust is
the same walk against the links from the hosts of blocked pages, so a host that links to blocked hosts is
held to account. A page without a rule is blocked if its host's distrust exceeds its trust by more than
the part `threshold` of it.

For a verdict every ruled page starts its walk with one unit, whatever the table holds besides. A walk is a sum over
its seeds, so pages elsewhere, ruled or not, change no score of a host that they don't reach, and no verdict depends
on the size of the table. `host_scores` gives the same walks with seeds that sum to 1, as PageRank is usually told.

Links are hosts named in absolute or protocol-relative `href` values; repeated links between two hosts count
once for each page. They are summed before any walk, so what iterates has one row for each pair of hosts.
Rounds of the walk are joins on that list, STRIDE rounds at a time written to the shared folder, until no host is new
and no score has changed by more than the part SETTLED of it, or for `horizon` rounds (100 at a damping of 0.85): a seed has then less
than SETTLED of itself left to give, so a host further off than that from all seeds, which could get no more of any, is not reached.
Nothing of the graph reaches the driver.

Edge cases: a null url, or one without "://", has empty host and path, no rule, and no host to judge it by,
so it is allowed; a null or empty html has no links, a very long one is searched whole; links of a host to itself are
ignored; a host without links out passes nothing on; repeated rows are judged alike, and count as seeds and links once
each; no trusted or no blocked seed leaves that walk empty; of rules of equal length that fit, the one whose name comes
last in order holds; an empty table gives no rows; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.storage import discard, only, written

#: A-Z and a-z.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?is)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
DAMPING = 0.85
#: Rounds of OP5_SQL; the code's go on until scores settle, or to the horizon.
ROUNDS = 10
#: The part of a score by which the rounds between two tables may still change it; and of a seed what the rounds left out may still move.
SETTLED = 1e-7
#: Rounds from one table to the next.
STRIDE = 3
#: A part of a host's trust.
THRESHOLD = 1e-6


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tried first, so it is wrapped last
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts and how many pages make them."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), lambda x: host_of(F.regexp_replace(x, "^[^/]*//", "x://"))))
    rows = pages.filter(F.contains("html", F.lit("//"))).select(host_of(F.col("url")).alias("src"), F.explode(links).alias("dst"))
    return rows.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def horizon(damping: float) -> int:
    """Rounds after which a seed has less than SETTLED of itself left to give: no host further off can get more than that of it."""
    return max(1, math.ceil(math.log(SETTLED) / math.log(damping))) if 0 < damping < 1 else 1


def _walks(edges: DataFrame, seeds: DataFrame, rounds: int | None, damping: float) -> DataFrame:
    """(walk, host, score): both walks at once from `seeds` (walk, host, seed), until scores settle, `horizon` rounds at most. `rounds` fixes their number."""
    most = rounds if rounds is not None else horizon(damping)
    seeds = written(seeds, "seeds")
    both = edges.select(F.lit("trust").alias("walk"), F.col("src").alias("a"), F.col("dst").alias("b"), "w").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "w"))
    out = both.groupBy("walk", "a").agg(F.sum("w").alias("total"))
    shares = written(both.join(out, ["walk", "a"]).select("walk", "a", "b", (F.col("w") / F.col("total")).alias("p")), "shares")
    start = seeds.select("walk", "host", (F.col("seed") * (1 - damping)).alias("score"))
    if shares.isEmpty():
        return start

    def step(now: DataFrame) -> DataFrame:
        moved = now.withColumnRenamed("host", "a").join(shares, ["walk", "a"]).select("walk", F.col("b").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"))
        return moved.union(start).groupBy("walk", "host").agg(F.sum("score").alias("score"))

    last, was, done = None, seeds.select("walk", "host", F.col("seed").alias("score")), 0
    while done < most:
        now = was
        for _ in range(min(STRIDE, most - done)):
            now, done = step(now), done + 1
        both = now.withColumn("was", F.lit(0.0)).union(was.select("walk", "host", F.lit(0.0), "score"))
        table = written(both.groupBy("walk", "host").agg(F.sum("score").alias("score"), F.sum("was").alias("was")), "walk")
        if last is not None:
            discard(last)
        last, was = table, table.select("walk", "host", "score")
        if rounds is None and table.filter(F.abs(F.col("score") - F.col("was")) > F.col("score") * SETTLED).isEmpty():
            break
    return was


def _raw_scores(pages: DataFrame, rules: list[Rule], rounds: int | None, damping: float) -> tuple[DataFrame, DataFrame]:
    """(walk, host, score) from one unit for each ruled page, and the ruled pages (host, verdict, n)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = pages.select(host.alias("host"), rule_of(host, path, rules)["verdict"].alias("verdict")).filter("verdict is not null")
    counts = written(ruled.groupBy("host", "verdict").agg(F.count("*").alias("n")), "ruled")
    walk = F.when(F.col("verdict") == "allow", "trust").otherwise("distrust")
    return _walks(host_edges(pages), counts.select(walk.alias("walk"), "host", F.col("n").cast("double").alias("seed")), rounds, damping), counts


def _by_host(scores: DataFrame, totals: dict[str, int]) -> DataFrame:
    pick = lambda name, total: (F.coalesce(F.sum(F.when(F.col("walk") == name, F.col("score"))), F.lit(0.0)) / total).alias(name)
    return scores.groupBy("host").agg(pick("trust", totals.get("allow", 1)), pick("distrust", totals.get("block", 1)))


def host_scores(pages: DataFrame, rules: list[Rule], rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of every host that a walk reaches; the seeds of each walk sum to 1."""
    scores, counts = _raw_scores(pages, rules, rounds, damping)
    totals = {r["verdict"]: r["n"] for r in counts.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}  # two rows at most
    return _by_host(scores, totals)


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each page."""
    with only(pages.sparkSession) as results:
        scores = _by_host(_raw_scores(pages, rules, rounds, damping)[0], {})
        bad = written(scores.filter(F.col("distrust") > F.col("trust") * (1 + threshold)).select(F.col("host").alias("bad")), "distrusted")
        results.append(bad)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    joined = ruled.join(bad, ruled["host"] == bad["bad"], "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
