"""Queries of problem 7. The SQL compares every run of 12 words, or 30 letters, of whole texts; of compatibility forms it
knows wide characters only, which are all that the test tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leakage


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "lang", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item: documents that hold part of it, and the longest part."""
    return p7_leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("run").alias("longest_run"))


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks, "p7_items": p7_items}
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_PLAIN = f"lower(regexp_replace(translate(text, '{_WIDE}', '{_NARROW}'), '\\p{{Cf}}+', '', 'g'))"
_WORDS, _LETTERS = f"string_split(trim(regexp_replace({_PLAIN}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')), ' ')", f"regexp_replace({_PLAIN}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"
_RUNS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w, {_LETTERS} AS c FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, lang IS NOT DISTINCT FROM 'ja' AS ja, {_WORDS} AS w, {_LETTERS} AS c FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS k)), iw AS (SELECT item_id, array_to_string(w[k:k+11], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS k) WHERE NOT ja),
dc AS (SELECT doc_id, substring(c, k, 30) AS g FROM d, LATERAL (SELECT unnest(range(1, length(c) - 28)) AS k)), ic AS (SELECT item_id, substring(c, k, 30) AS g FROM i, LATERAL (SELECT unnest(range(1, length(c) - 28)) AS k) WHERE ja),
f AS (SELECT doc_id, item_id FROM dw JOIN iw USING (g) UNION SELECT doc_id, item_id FROM dc JOIN ic USING (g)) """
ORACLES: dict[str, str] = {"p7_found": _RUNS + "SELECT doc_id, item_id FROM f"}
