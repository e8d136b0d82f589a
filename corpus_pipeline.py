"""From raw documents to training pieces: rules, line dedup, near dedup, decontamination, encoding.

Every stage reads what its predecessor wrote and works on all of it. All but the last return the columns of
`documents`; the last adds the sampled pieces. Sampled segmentations have no SQL equivalent, so the whole has
none either; the stages before it are checked against SQL by their own queries.

In every stage an empty table gives an empty one, very long texts are read whole, and columns beside those a stage
reads, whatever their names, come through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontam, linedup, minhash, pieces, quality
from rasterloom.llm.queries import VOCABULARY, table
from rasterloom.llm.textcore import free_name
from rasterloom.storage import discard, only, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade keeps. A null or empty text goes; repeated rows, and rows with a null doc_id, are judged alike."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier three-line window; n_chars follows.

    No row goes. A null text stays null; rows with one doc_id and text count as one; of equal windows the one with the
    smallest doc_id stays, null first.
    """
    return linedup.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8), the one with the smallest doc_id.

    Texts without words, null ones, and rows without doc_id stay; rows with one doc_id are one document.
    """
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates. Null and empty texts stay; repeated rows are judged alike; an item without text is ignored, one without id is not."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with sampled `pieces` and whether these decode to the text (`lossless`).

    A null text has null pieces and is lossless; an empty one has none; rows without doc_id are seeded alike. Where the
    documents have columns of these names, they stay, and the results are called pieces_ and lossless_ (and so on).
    """
    vocabulary = pieces.Vocabulary.load(VOCABULARY)
    out, same = free_name("pieces", docs.columns), free_name("lossless", docs.columns)
    decoded = free_name("decoded", [*docs.columns, out, same])
    rows = pieces.encode_and_decode(docs, vocabulary, out=out, decoded=decoded)
    return rows.select(*docs.columns, out, F.col(decoded).eqNullSafe(F.col("text")).alias(same))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next reads it. Of the tables that they write, the last one read stays."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with only(spark) as results:
            docs = written(stage(spark, docs, sf_dir), name)
            results.append(docs)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
