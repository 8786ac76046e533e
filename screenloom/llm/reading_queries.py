"""Queries of problem 9. No SQL: the model is fitted; tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import reading


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and number of running sentences of every document; level null: none."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return reading.levels(documents, reading.fit(documents, table(spark, sf_dir, "reading_labels")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).where("level >= 4").select("doc_id").distinct()


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and running sentences per source and level, over the whole corpus."""
    sources = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"))
    return p9_levels(spark, sf_dir).join(sources, "doc_id").groupBy("source", "level").agg(F.count("*").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


QUERIES = {"p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile}
ORACLES: dict[str, str] = {}
