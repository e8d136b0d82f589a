"""The corpus queries, each over its whole table with production parameters, and their SQL equivalents."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontam, embdedup, langid, linedup, minhash, pieces, pii, quality, resharding, substring_dedup, trie, urlgraph, whitening
from rasterloom.storage import shared_dir

#: A-Z and a-z, for folding ASCII letters alone.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, w, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
             length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS upper_, length(regexp_replace(t, '[^a-z]+', '', 'g')) AS lower_,
             len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{C0}}-\x{{10FFFF}}]'))) AS lettered, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR (n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines)
            OR upper_ > lower_ OR 10 * lettered < 7 * n_words OR 5 * stutters > n_words) AS kept
FROM b
"""

def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM windows) WHERE doc_id > lo),
lost AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM gone),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN lost USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


#: The rules of op5.
URL_RULES = [
    urlgraph.Rule("org", "/", "allow"),
    urlgraph.Rule("example.org", "/es/", "block"),
    urlgraph.Rule("example.org", "/en/1", "block"),
    urlgraph.Rule("com", "/fr/", "allow"),
    urlgraph.Rule("com", "/de/", "block"),
]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _op5_sql() -> str:
    """The walks as one common table expression a round."""
    rules = sorted(URL_RULES, key=lambda r: -len(r.name))
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in rules) + " END"
    walks = [f"s0 AS MATERIALIZED (SELECT walk, host, seed AS score FROM seeds)"]
    for k in range(urlgraph.ROUNDS):
        walks.append(f"""s{k + 1} AS MATERIALIZED (SELECT walk, host, sum(score) AS score FROM (
            SELECT s.walk, b AS host, sum(score * p) * {urlgraph.DAMPING} AS score FROM s{k} s JOIN shares e ON s.walk = e.walk AND s.host = e.a GROUP BY 1, 2
            UNION ALL SELECT walk, host, seed * {1 - urlgraph.DAMPING} FROM seeds) GROUP BY 1, 2)""")
    return rf"""
WITH u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT page_id, host, path, {case("name")} AS rule, {case("verdict")} AS ruled FROM u),
counts AS (SELECT host, ruled, count(*) AS n FROM r WHERE ruled IS NOT NULL GROUP BY 1, 2),
seeds AS (SELECT CASE WHEN ruled = 'allow' THEN 'trust' ELSE 'distrust' END AS walk, host, n::DOUBLE AS seed FROM counts),
links AS (SELECT DISTINCT page_id, host AS src, translate(regexp_extract(l, '^[^/]*//([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS dst
          FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '(?is)\bhref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1)) AS l FROM u)),
edges AS (SELECT src, dst, count(*) AS w FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
both_ AS (SELECT 'trust' AS walk, src AS a, dst AS b, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
shares AS (SELECT walk, a, b, w / sum(w) OVER (PARTITION BY walk, a) AS p FROM both_),
{", ".join(walks)},
bad AS (SELECT host FROM s{urlgraph.ROUNDS} GROUP BY 1 HAVING coalesce(sum(score) FILTER (walk = 'distrust'), 0) > (1 + {urlgraph.THRESHOLD}) * coalesce(sum(score) FILTER (walk = 'trust'), 0))
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM r LEFT JOIN bad ON r.host = bad.host
"""


OP5_SQL = _op5_sql()


#: Where the vocabulary lies on the driver; RASTERLOOM_VOCABULARY names another.
VOCABULARY = os.environ.get("RASTERLOOM_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(VOCABULARY)
    rows = pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    count = F.coalesce(F.size("pieces"), F.lit(0)).cast("long")
    return rows.select("doc_id", count.alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resharding.reshard(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def reshard_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards that op7's plan changes, written and read back: shard, n_rows, n_bytes."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/rasterloom-shards-{uuid.uuid4().hex}"
    resharding.rewrite_affected(docs, resharding.reshard(docs), path)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + resharding.ROW_BYTES
    return spark.read.schema(docs.select(*docs.columns, F.lit(0).alias("shard")).schema).parquet(path).groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85, 100)


OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACED}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a),
comp AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _op9_sql() -> str:
    """Each kind's plain pattern; places from the lengths of what lies between matches."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
        "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "key": r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_live_[0-9A-Za-z]{24,}",
        "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
        "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*",
        "secret": r"[A-Za-z0-9+/_=-]+",
    }
    digits = "regexp_replace(m, '[^0-9]+', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN (({digits})[i]::INT * 2) - CASE WHEN ({digits})[i]::INT > 4 THEN 9 ELSE 0 END ELSE ({digits})[i]::INT END)) % 10 = 0"
    packed = "replace(m, ' ', '')"
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split((({packed})[5:]) || (({packed})[1:4]), ''), lambda c: ascii(c))), lambda r, c: CASE WHEN c < 58 THEN r * 10 + c - 48 ELSE r * 100 + c - 55 END % 97) = 1"
    confirm = {
        "email": "true",
        "ip": r"len(list_filter(string_split(m, '.'), lambda p: NOT regexp_matches(p, '^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$'))) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({packed}) BETWEEN 15 AND 34 AND {mod97}",
        "ssn": "true",
        "key": "true",
        "jwt": "true",
        "private_key": "true",
        "secret": "length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
    }
    parts = []
    for at, k in enumerate(pii.KINDS):
        extra = f"AND {k.prior} + CASE WHEN regexp_matches(lower(near), '{k.context}') THEN {k.lift} ELSE 0 END >= {pii.THRESHOLD}" if not k.base else ""
        alone = "AND NOT (s > 0 AND regexp_matches(t[s], '^[A-Za-z0-9]')) AND NOT regexp_matches(t[e + 1], '^[A-Za-z0-9]')" if k.alone else ""
        parts.append(f"""SELECT doc_id, {at} AS o, '{k.name}' AS kind, s, e FROM (
            SELECT *, s + length(m) AS e, substr(t, greatest(s - {pii.BEFORE}, 0) + 1, least(s, {pii.BEFORE})) || ' ' || substr(t, s + length(m) + 1, {pii.AFTER}) AS near FROM (
            SELECT doc_id, t, m[i] AS m, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM (
            SELECT doc_id, t, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, t, regexp_extract_all(t, '{patterns[k.name]}') AS m, string_split_regex(t, '{patterns[k.name]}') AS p FROM d) WHERE len(m) > 0)))
            WHERE {confirm[k.name]} {alone} {extra}""")
    base = [k.name for k in pii.KINDS if k.base]
    counts = ", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
per AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < {len(base)}) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans FROM found GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0)::BIGINT AS n_{n}" for n in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (doc_id)
"""


OP9_SQL = _op9_sql()


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(s) AS x, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
v AS (SELECT doc_id, x, i, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z, lead(i, 1) OVER o AS j, lead(i, 2) OVER o AS k
      FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, i, j, k FROM v WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, j, k]) AS i FROM later),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
total AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1)
SELECT doc_id, coalesce(total.n, 0)::BIGINT AS n_lines, (coalesce(total.n, 0) - coalesce(kept.n, 0))::BIGINT AS n_removed_lines, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
comp AS (SELECT vec_id, min(other) AS c FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def whitening_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact statistics that op12 decomposes."""
    return whitening.scatter_rows(table(spark, sf_dir, "embeddings"))


WHITENING_SCATTER_SQL = """
WITH v AS (SELECT embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT DISTINCT list_transform(e, lambda c: (floor(64 * c::DOUBLE) + 1000000)::HUGEINT) AS x FROM v),
own AS (SELECT x FROM x WHERE len(x) = (SELECT len(x) FROM x GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
one AS (SELECT r, i, x[i] AS a FROM (SELECT x, row_number() OVER () AS r, unnest(range(1, len(x) + 1)) AS i FROM own)),
s AS (SELECT i, count(*) AS n, sum(a)::HUGEINT AS s FROM one GROUP BY 1),
p AS (SELECT l.i, r.i AS j, sum(l.a * r.a)::HUGEINT AS p FROM one l JOIN one r ON l.r = r.r AND l.i <= r.i GROUP BY 1, 2)
SELECT (p.i - 1)::INT AS i, (p.j - 1)::INT AS j, l.n, l.s::VARCHAR AS sum_i, r.s::VARCHAR AS sum_j, (l.n * p.p - l.s * r.s)::VARCHAR AS scatter
FROM p JOIN s l ON l.i = p.i JOIN s r ON r.i = p.j
"""


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a short ASCII text `s`, bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(s)), lambda i: ((ascii(s[i // 8 + 1]) >> (i % 8)) & 1)::BIGINT)), lambda crc, bit: xor(crc >> 1, (xor(crc, bit) & 1) * 3988292384)), 4294967295)"

OP13_SQL = f"""
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role || chr(31) || length(text) || ':' || text AS k, strlen(text)::BIGINT AS b
      FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id AS c, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)),
r AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, k, b FROM (
      SELECT c, 0 AS part, i, k, b FROM c JOIN t ON t.conv_id = base AND i <= h UNION ALL SELECT c, 1, i, k, b FROM c JOIN t ON t.conv_id = c AND i > h)),
p AS MATERIALIZED (SELECT c, d, b, sha256(string_agg(k, chr(30)) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS key FROM r),
q AS MATERIALIZED (SELECT c, 0 AS d, 0 AS b, '' AS key, NULL AS up FROM c UNION ALL SELECT c, d, b, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), '') FROM p),
n AS MATERIALIZED (SELECT d, key, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b FROM q GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, key)),
sums AS (SELECT q.d, q.key, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.b)::BIGINT AS saved FROM m JOIN q ON q.c = m.conv_id AND q.d <= m.d GROUP BY 1, 2),
ends AS (SELECT d, key, string_agg(c::VARCHAR, ',' ORDER BY c) AS names FROM q JOIN (SELECT c, max(d) AS d FROM q GROUP BY 1) USING (c, d) GROUP BY 1, 2)
SELECT m.conv_id, m.d AS depth, above.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(names, '')) AS ends_sha256
FROM m JOIN sums USING (d, key) LEFT JOIN ends USING (d, key) LEFT JOIN m above ON above.d = m.d - 1 AND above.key = m.up
"""

QUERIES = {"op1_decontamination": op1_decontamination, "op2_quality": op2_quality, "op3_substring_dedup": op3_substring_dedup, "op4_langid": op4_langid, "op5_urls": op5_urls, "op6_pieces": op6_pieces, "op7_resharding": op7_resharding, "reshard_rewrite": reshard_rewrite, "op8_minhash": op8_minhash, "op9_pii": op9_pii, "op10_line_dedup": op10_line_dedup, "op11_embeddings": op11_embeddings, "op12_whitening": op12_whitening, "op13_trie": op13_trie, "whitening_scatter": whitening_scatter}
ORACLES = {"op1_decontamination": OP1_SQL, "op2_quality": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_urls": OP5_SQL, "op8_minhash": OP8_SQL, "op9_pii": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_embeddings": OP11_SQL, "op13_trie": OP13_SQL, "whitening_scatter": WHITENING_SCATTER_SQL}
