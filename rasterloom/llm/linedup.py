"""Line dedup by overlapping three-line windows, in DataFrame functions alone.

A document's lines are its text split at \\n; lines without a visible character are passed over and always
stay. A window is three consecutive lines of those left, compared as they are. Its first occurrence, by
(doc_id, row hash, place), stays; every line that a later occurrence covers goes.

Windows travel as two hashes (128 bits) and a place, never as text. They are counted with partial
aggregation, so a passage that a third of all rows share sends one row for each task; the join back has one
row a key on its small side, which adaptive execution splits where a key is hot.

Edge cases: a null text stays null and an empty one empty, with no lines removed; fewer than three lines
make no window; rows with the same doc_id and text are one document: they get the same decision and do not
remove each other; a null doc_id sorts first; very long texts and lines are read whole; bytes that are not UTF-8 are
compared as they are; an empty table gives no rows; extra columns are left alone (dedup() replaces those that have the
names of its own, cleaned() none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.storage import written

LINES = 3
_VISIBLE = r"[^\x20\x09-\x0D]"


def _bound(array: Column, body) -> Column:
    """`body` of an array that is computed once, however often the lambda inside reads it."""
    return F.get(F.transform(F.array(array), body), 0)


def _windows_of(lines: Column) -> Column:
    """Windows of a text's lines: two hashes and the numbers i, j, k of the three lines; null for fewer than three."""
    visible = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda line: line["x"].rlike(_VISIBLE))

    def window(own: Column, at: Column) -> Column:
        parts = [F.get(own, at + k) for k in range(LINES)]
        texts = [p["x"] for p in parts]
        return F.struct(F.xxhash64(F.lit(1), *texts).alias("h"), F.xxhash64(F.lit(2), *texts).alias("g"), F.array(*(p["i"] for p in parts)).alias("lines"))

    return _bound(visible, lambda own: F.when(F.size(own) >= LINES, F.transform(F.sequence(F.lit(0), F.size(own) - LINES), lambda at: window(own, at))))


def windows(documents: DataFrame) -> DataFrame:
    """(h, g, doc_id, rid, lines): every window's hashes and the numbers of its lines; rid is a hash of doc_id and text."""
    rows = documents.filter(F.col("text").contains("\n")).select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.explode(_windows_of(F.split("text", "\n", -1))).alias("w"))
    return rows.select("w.h", "w.g", "doc_id", "rid", "w.lines")


def removal_plan(documents: DataFrame) -> DataFrame:
    """(doc_id, rid, gone): numbers of the lines that a repeat of an earlier window covers."""
    every, place = windows(documents), F.struct("doc_id", "rid", F.get("lines", 0).alias("i"))
    firsts = every.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("h", "g", "first")
    later = every.join(firsts.hint("shuffle_hash"), ["h", "g"]).filter(place != F.col("first"))
    return written(later.select("doc_id", "rid", F.explode("lines").alias("line")).groupBy("doc_id", "rid").agg(F.collect_set("line").alias("gone")), "lines")


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose numbers are not in `gone`, in order, in time linear in both."""
    return _bound(lines, lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), gone), lambda i: F.get(own, i)))


_OWN = ("__line_dedup_id", "__line_dedup_rid", "__line_dedup_gone")


def _joined(documents: DataFrame) -> tuple[DataFrame, Column]:
    """`documents` with the lines to remove (_OWN), and the text without them. A null doc_id and 0 differ by rid."""
    id_, rid, gone = _OWN
    number = F.coalesce("doc_id", F.lit(0))
    plan = removal_plan(documents).select(number.alias(id_), F.col("rid").alias(rid), F.col("gone").alias(gone))
    rows = documents.withColumns({id_: number, rid: F.xxhash64("doc_id", "text")}).join(plan.hint("shuffle_hash"), [id_, rid], "left")
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_without(F.split("text", "\n", -1), F.col(gone)), "\n"))
    return rows, kept


def dedup(documents: DataFrame) -> DataFrame:
    """`documents` and, per row, `kept_text`, `n_lines` and `n_removed_lines` (names that clash are replaced)."""
    own = [c for c in documents.columns if c not in ("kept_text", "n_lines", "n_removed_lines")]
    rows, kept = _joined(documents.select(*own))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return rows.select(*own, kept.alias("kept_text"), total.cast("long").alias("n_lines"), F.coalesce(F.size(_OWN[2]), F.lit(0)).cast("long").alias("n_removed_lines"))


def cleaned(documents: DataFrame, length: str = "n_chars") -> DataFrame:
    """`documents` with what is kept as `text`, and its characters as column `length` if there is one."""
    rows, kept = _joined(documents)
    rows = rows.withColumn(_OWN[0], kept)
    changed = {"text": F.col(_OWN[0]), length: F.length(_OWN[0]).cast("long")}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns))
