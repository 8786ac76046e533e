"""Queries of problem 4. No SQL: whole tables need the linking of every two rows; tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import neardup


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per screen: its group and its number of links."""
    return neardup.groups(table(spark, sf_dir, "lc_screens"), "id", "phash", "ocr_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a group, as asked for; p4_groups holds the same without expanding groups into pairs."""
    return neardup.pairs_within(p4_groups(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
ORACLES: dict[str, str] = {}
