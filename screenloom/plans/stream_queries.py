"""Streaming operators run to their end over the test events, and sinks, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, search
from ..session import shared_path, table
from ..sources import writers
from ..streaming import monitor

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def drain(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is to a table in the shared folder and read that."""
    path = shared_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _frames(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    # a pattern, as a stream's path may be a folder or match files, but not name a file
    s = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    return s.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("action"))


def stream_monitor(spark: SparkSession, d: str) -> DataFrame:
    out = drain(monitor.monitor(_frames(spark, d)), spark, "monitor")
    return out.select("id", F.round("dist", 6).alias("dist"), F.col("unchanged").cast("long").alias("unchanged"), F.col("dead_ends").cast("long").alias("dead_ends"), "stall")


QUERIES["stream_monitor"] = stream_monitor
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
ORACLES["stream_monitor"] = f"""WITH f AS (SELECT *, coalesce(abs(value - lag(value) OVER {_W}), 999) AS dist, row_number() OVER {_W} AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER {_W} AS t FROM events),
i AS (SELECT *, max(CASE WHEN dist >= 5 THEN n END) OVER {_W} AS start, max(CASE WHEN dist >= 5 THEN ts END) OVER {_W} AS since, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER {_W}, 0) AS r FROM f)
SELECT event_id AS id, round(dist, 6) AS dist, n - start AS unchanged, CAST(t - r AS BIGINT) AS dead_ends, CASE WHEN epoch(ts - since) >= 14400 THEN 'fatal' WHEN epoch(ts - since) >= 7200 THEN 'corner_action' ELSE 'ok' END AS stall FROM i"""


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts per action; complete mode, so that the last windows are there, too. Each batch writes the whole
    result anew to a table in the shared folder."""
    path = shared_path(spark, "counts")
    c = monitor.action_counts(_frames(spark, d))
    q = c.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/{i % 2}")).option("checkpointLocation", path + "-state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress if p["numInputRows"]), default=0)
    return spark.read.schema(c.schema).parquet(f"{path}/{last % 2}").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "action", "n", F.round("total", 6).alias("total"))


QUERIES["stream_counts"] = stream_counts
ORACLES["stream_counts"] = "SELECT date_trunc('hour', ts) AS start, event_type AS action, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"


def summary_json(spark: SparkSession, d: str) -> DataFrame:
    return writers.summary_documents(table(spark, d, "lc_screens"), table(spark, d, "lc_tappable_items"), search.first_sessions(table(spark, d, "lc_sessions")))


def tree_json(spark: SparkSession, d: str) -> DataFrame:
    n = graph.nodes(table(spark, d, "lc_screens"), "session_id", "fingerprint", "id", "title", "depth", "parent_fp", "phash", "discovered_at")
    return writers.tree_documents(n, graph.edges(n, "session_id", "fingerprint", "parent_fp"))


def api_json(spark: SparkSession, d: str) -> DataFrame:
    s = search.with_sessions(table(spark, d, "lc_screens"), search.first_sessions(table(spark, d, "lc_sessions")))
    return writers.api_answer(s.select("id", "title", "depth", "game_title"), [F.desc("id")], 20)


def anomaly_json(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lc_screens").where("title is null or title = '' or ocr_text is null")
    return writers.anomalies(s, "no text: check!")


def tidy_paths(spark: SparkSession, d: str) -> DataFrame:
    from .structure_queries import _nodes, _placed

    titles = _nodes(spark, d).select(F.col("session_id").alias("scope"), F.col("fingerprint").alias("node"), F.coalesce("title", F.lit("unknown")).alias("title"))
    chains = graph.title_chain(_placed(spark, d), titles)
    return writers.tidy_paths(chains).select(F.col("scope").alias("session_id"), F.col("node").alias("fingerprint"), "dest_path")


_SLUG = "coalesce(nullif(trim(left(regexp_replace(coalesce(n.title, 'unknown'), '[\\\\/:*?\"<>|\\s\\x{00A0}\\x{3000}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{1680}\\x{85}]', '_', 'g'), 30), '_'), ''), 'unknown')"
ORACLES["tidy_paths"] = f"""WITH RECURSIVE n AS (SELECT * FROM lc_screens s WHERE id = (SELECT max(id) FROM lc_screens t WHERE t.session_id = s.session_id AND t.fingerprint = s.fingerprint)),
t AS (SELECT session_id, fingerprint, {_SLUG} AS last, {_SLUG} AS dirs FROM n WHERE NOT EXISTS (SELECT 1 FROM n p WHERE p.session_id = n.session_id AND p.fingerprint = nullif(n.parent_fp, ''))
UNION ALL SELECT n.session_id, n.fingerprint, {_SLUG}, t.dirs || '/' || {_SLUG} FROM t JOIN n ON n.session_id = t.session_id AND n.parent_fp = t.fingerprint)
SELECT session_id, fingerprint, dirs || '/' || left(fingerprint, 8) || '_' || last || '.png' AS dest_path FROM t"""
QUERIES |= {"summary_json": summary_json, "tree_json": tree_json, "api_json": api_json, "anomaly_json": anomaly_json, "tidy_paths": tidy_paths}
