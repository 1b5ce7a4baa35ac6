"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimark.llm.common import table
from sedimark.llm.decontaminate import MATCHES_SQL, matches
from sedimark.llm.jaccard import JACCARD_SQL, jaccard_report
from sedimark.llm.language import language_id
from sedimark.llm.lines import line_report, line_sql
from sedimark.llm.media import media_columns
from sedimark.llm.pieces import encoding_report
from sedimark.llm.quality import quality
from sedimark.llm.repeats import REPEATS_SQL, repeats
from sedimark.llm.secrets import scan_sql, secret_scan
from sedimark.llm.token_binary import token_binary

#: Bytes of text from which a run counts in op2_line_dedup_long_runs.
LONG_RUN = 100


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op2_line_dedup_long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), least_bytes=LONG_RUN)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_token_binary, op2_line_dedup, op2_line_dedup_long_runs, op3_repeats, op4_sentencepiece, op5_jaccard,
    op6_language_id, op7_decontaminate, op8_quality, op9_media_columns, op10_secret_scan,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_repeats": REPEATS_SQL, "op2_line_dedup": line_sql(), "op2_line_dedup_long_runs": line_sql(LONG_RUN), "op5_jaccard": JACCARD_SQL, "op7_decontaminate": MATCHES_SQL, "op10_secret_scan": scan_sql()}
