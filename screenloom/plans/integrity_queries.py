"""Queries and SQL of problem 2 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from ..session import table


def _relations(spark: SparkSession, sf_dir: str) -> list[tuple]:
    gone = table(spark, sf_dir, "lc_deletions")
    screens = table(spark, sf_dir, "lc_screens").select("id", "session_id", "fingerprint", "parent_fp", "import_batch")
    sessions = table(spark, sf_dir, "lc_sessions").select("session_id", "import_batch")
    items = table(spark, sf_dir, "lc_tappable_items").select("id", "screen_id", "import_batch")
    live_screens = integrity.live(screens, "id", gone, "lc_screens")
    live_sessions = integrity.live(sessions, "session_id", gone, "lc_sessions")
    return [
        ("lc_screens", "session_id", (live_screens, "id", ["session_id"], "import_batch", live_sessions, ["session_id"], "import_batch"), ()),
        ("lc_screens", "parent_fp", (live_screens, "id", ["session_id", "parent_fp"], "import_batch", live_screens, ["session_id", "fingerprint"], "import_batch"), ("parent_fp",)),
        ("lc_tappable_items", "screen_id", (items, "id", ["screen_id"], "import_batch", live_screens, ["id"], "import_batch"), ()),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [integrity.orphans(*args, blank_is_null=blank).select(F.lit(t).alias("src_table"), F.lit(f).alias("field"), "id", "import_batch") for t, f, args, blank in _relations(spark, sf_dir)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [integrity.orphan_report(*args, blank_is_null=blank).select(F.lit(t).alias("src_table"), F.lit(f).alias("field"), "import_batch", "n_refs", "n_orphans", "n_orphan_keys") for t, f, args, blank in _relations(spark, sf_dir)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}

_LIVE = """
WITH s AS (SELECT * FROM lc_screens x WHERE NOT EXISTS (SELECT 1 FROM lc_deletions d WHERE d.table_name = 'lc_screens' AND d.row_key = CAST(x.id AS VARCHAR))),
e AS (SELECT * FROM lc_sessions x WHERE NOT EXISTS (SELECT 1 FROM lc_deletions d WHERE d.table_name = 'lc_sessions' AND d.row_key = x.session_id)),
refs AS (
  SELECT 'lc_screens' AS src_table, 'session_id' AS field, id, CAST(import_batch AS BIGINT) AS import_batch, session_id AS key,
    EXISTS (SELECT 1 FROM e WHERE e.session_id = s.session_id AND e.import_batch <= s.import_batch) AS ok FROM s WHERE session_id IS NOT NULL
  UNION ALL
  SELECT 'lc_screens', 'parent_fp', id, CAST(import_batch AS BIGINT), session_id || '/' || parent_fp,
    EXISTS (SELECT 1 FROM s p WHERE p.session_id = s.session_id AND p.fingerprint = s.parent_fp AND p.import_batch <= s.import_batch) FROM s WHERE parent_fp <> '' AND session_id IS NOT NULL
  UNION ALL
  SELECT 'lc_tappable_items', 'screen_id', id, CAST(import_batch AS BIGINT), CAST(screen_id AS VARCHAR),
    EXISTS (SELECT 1 FROM s WHERE s.id = i.screen_id AND s.import_batch <= i.import_batch) FROM lc_tappable_items i WHERE screen_id IS NOT NULL)
"""

ORACLES = {
    "p2_found": _LIVE + "SELECT src_table, field, id, import_batch FROM refs WHERE NOT ok",
    "p2_report": _LIVE + "SELECT src_table, field, import_batch, count(*) AS n_refs, count(*) FILTER (NOT ok) AS n_orphans, count(DISTINCT key) FILTER (NOT ok) AS n_orphan_keys FROM refs GROUP BY ALL",
}
