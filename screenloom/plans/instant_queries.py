"""Queries of problem 6. SQL: the instants of all forms but those that need a zone table are not simpler in SQL; the
operator is tested against an independent conversion by datetime and zoneinfo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import instants
from ..session import table


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, id, text, zone) of the three columns. Of a session delivered again the smallest id counts."""
    devices = table(spark, sf_dir, "devices").groupBy("device_id").agg(F.min("tz_name").alias("zone"))
    sessions = table(spark, sf_dir, "lc_sessions")
    of_session = sessions.where("session_id is not null").groupBy("session_id").agg(F.min_by("device_id", "id").alias("device_id"))
    screens = table(spark, sf_dir, "lc_screens").select("id", "session_id", F.col("discovered_at").alias("text")).join(of_session, "session_id", "left")
    parts = [
        screens.select(F.lit("lc_screens").alias("src_table"), "id", "text", "device_id"),
        sessions.select(F.lit("lc_sessions").alias("src_table"), "id", F.col("started_at").alias("text"), "device_id"),
        table(spark, sf_dir, "crawl_sessions").select(F.lit("crawl_sessions").alias("src_table"), "id", F.col("started_at").alias("text"), "device_id"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(devices, "device_id", "left").select("src_table", "id", "text", "zone")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.instants(_times(spark, sf_dir), "text", "zone").where("utc_us is not null").select("src_table", "id", "utc_us")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each shape there are and how many of them denote a time."""
    times = instants.instants(_times(spark, sf_dir).where("text is not null"), "text", "zone")
    return times.groupBy("src_table", instants.mask_of(instants.text_of("text")).alias("shape")).agg(F.count("*").alias("n"), F.count("utc_us").alias("n_times"))


QUERIES = {"p6_found": p6_found, "p6_forms": p6_forms}
ORACLES: dict[str, str] = {}
