"""From raw documents to token ids: rules, line dedup, near-dedup, mixing, encoding.

Edge cases: an empty table gives an empty one at every stage. Only the columns of documents are read and written, so
others, and clashing names, do no harm. A null doc_id, lang or source is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm import line_dedup, mixing, quality_rules, sentence_pieces, simhash
from reportloom.llm.runtime import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep. Null and empty texts have no words and go; repeated rows go or stay
    together; a null source is a host of its own."""
    return quality_rules.judge(docs).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks that an earlier document has; documents left without a word go, but one
    from which nothing was removed stays, be it null or empty. Repeated rows are one document and lose the same."""
    out = line_dedup.dedup(docs)
    return _documents(out.filter((F.col("n_removed") == 0) | F.col("text").rlike(mixing.WORD)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null and empty texts are copies of each other, and one row of
    repeated rows stays."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in its order; null and empty texts are never taken."""
    return _documents(mixing.apply(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, source, n_tokens, ids, exact (do they decode to the text?). A null text has
    null ids, an empty one none."""
    return sentence_pieces.encode(docs, keep_text=False, check=True).select("doc_id", "source", "n_tokens", "ids", "exact")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("source_mixing", mix), ("sentence_pieces", encode)]

# Hash-chosen chunks, fingerprints and piece search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again but for the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
