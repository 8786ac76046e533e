"""Queries of problem 1. No SQL: the operator is tested against an independent conversion by unicodedata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import plainform


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, field, id, text) of the three fields, without NULLs."""
    screens, items = table(spark, sf_dir, "lc_screens"), table(spark, sf_dir, "lc_tappable_items")
    both = screens.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "ocr_text")])).alias("v")).select(F.lit("lc_screens").alias("src_table"), "v.field", "id", "v.text")
    return both.unionByName(items.select(F.lit("lc_tappable_items").alias("src_table"), F.lit("text").alias("field"), "id", "text")).where("text is not null")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plainform.not_plain(values(spark, sf_dir), "text", ["src_table", "field", "id"])


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels per field before and after conversion, over whole tables."""
    v = values(spark, sf_dir).withColumn("row", F.concat_ws("/", "src_table", "field", "id"))
    out = plainform.plain_texts(v, "text", "row")
    return out.groupBy("src_table", "field").agg(F.count("*").alias("n_values"), F.count_if(F.col("plain") != F.col("text")).alias("n_changed"), F.countDistinct("text").alias("n_distinct_before"), F.countDistinct("plain").alias("n_distinct_after"))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
ORACLES: dict[str, str] = {}
