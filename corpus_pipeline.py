"""Five stages from raw documents to encoded training text.

Every stage takes all documents that the one before kept, as rows of ``documents``, and its decisions
take effect: rejected, emptied, duplicate and contaminated documents go, deleted lines are gone from the
text.  The last stage returns token ids.

Edge cases, in every stage: an empty table gives an empty table; columns other than doc_id and text pass
through as they are, whatever their names (n_chars is counted anew where lines went); a null ``doc_id`` is an
id like any other; rows that repeat an id are documents of their own.  What each stage does with null, empty and very
long texts, ties and repeated rows stands at the stage; more is in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import decontaminate, jaccard, lines, pieces, quality
from sedimark.llm.common import cut, release, table
from sedimark.llm.registry import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.7).

    Null and empty texts have the score of a text without features; equal texts have equal scores; whole texts
    are scored, long ones in slices; labels of unknown documents, null and odd labels aren't learnt from.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs deleted; documents that had nothing else go.

    A null text stays; an empty one is one blank line, which never goes alone; rows equal in id and text keep
    their lines alike; rows that repeat an id are ordered by a hash of their text.
    """
    told = lines.dedup_lines(docs).where("n_deleted = 0 or n_deleted < n_lines")
    return told.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Texts without words, null ones too, are linked with nothing and stay; of rows that repeat the least id the
    first by a hash stays, and rows equal in id and text are one; null ids come after all others.
    """
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts, and texts shorter than any item, stay; null items and items without words match
    nothing; repeated rows are judged alike.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number and crc32, and the digest of the text decoded from them.

    Null and empty texts have no ids; repeated rows are kept.
    """
    return pieces.encoding_report(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can't express the classifier and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return docs
