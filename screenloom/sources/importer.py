"""Import of session summaries into the tables (M3-M5, S1): idempotent, as joins of state and batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import insert_ignore, with_ids


def new_sessions(summaries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions to append: the first summary by path of each session_id that isn't there."""
    rows = summaries.select("session_id", F.size(F.coalesce("screens", F.array())).cast("long").alias("screens_found"), F.get("screens", F.lit(0))["discovered_at"].alias("started_at"), F.lit("completed").alias("status"), F.coalesce("game_title", F.lit("Unknown Game")).alias("game_title"), F.coalesce("device_mode", F.lit("SIMULATOR")).alias("device_mode"), "path")
    return with_ids(insert_ignore(sessions, rows, ["session_id"], "path"), sessions, "id", "path").drop("path")


def new_projects(summaries: DataFrame, projects: DataFrame) -> DataFrame:
    """Titles to append as projects (M3)."""
    titles = summaries.select(F.coalesce("game_title", F.lit("Unknown Game")).alias("game_title")).distinct()
    return with_ids(titles.join(projects.select("game_title"), "game_title", "left_anti"), projects, "id", "game_title")


def new_screens(screens: DataFrame, stored: DataFrame) -> DataFrame:
    """Screens to append: of each (session_id, fingerprint) that isn't there the first by path and position; ocr_text is
    the items' texts joined by a blank (M5, A12, N14). screens: of readers.screens_of()."""
    rows = screens.withColumn("_pos", F.struct("path", "pos")).withColumns({"ocr_text": F.array_join(F.transform(F.coalesce("tappable_items", F.array()), lambda i: i["text"]), " "), "depth": F.coalesce("depth", F.lit(0))})
    first = insert_ignore(stored, rows.select("session_id", "fingerprint", "_pos", "title", "depth", "parent_fp", "phash", "screenshot_path", "ocr_text", "discovered_at", "tappable_items"), ["session_id", "fingerprint"], "_pos")
    return with_ids(first.withColumn("_order", F.concat_ws("/", "_pos.path", F.lpad(F.col("_pos.pos").cast("string"), 9, "0"))), stored, "id", "_order").drop("_pos", "_order")


def items_of(new: DataFrame) -> DataFrame:
    """(screen_id, pos, text, confidence) of the items of appended screens (M2, M5)."""
    return new.select(F.col("id").alias("screen_id"), F.posexplode("tappable_items").alias("pos", "i")).select("screen_id", "pos", "i.text", F.coalesce("i.confidence", F.lit(0.0)).alias("confidence"))
