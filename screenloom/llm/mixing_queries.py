"""Queries of problem 8. No SQL: it has no tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import mixing


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of the mixture, with the parts of documents that it holds."""
    return _mixture(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and shares, aimed at and reached, per source."""
    return _mixture(spark, sf_dir)[1]


def p8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every block of the mixture."""
    return mixing.tokens_of(_mixture(spark, sf_dir)[0], table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p8_blocks": p8_blocks, "p8_report": p8_report, "p8_tokens": p8_tokens}
ORACLES: dict[str, str] = {}
