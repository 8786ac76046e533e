"""Sinks (S13-S19, A17, A19): nested documents, API answers, reports. Documents are one JSON text per session; the cell holds a
session's screens, so its size is the session's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug


def summary_documents(screens: DataFrame, items: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, json): a summary per session with its screens in order of id."""
    nested = items.groupBy(F.col("screen_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").alias("n"), "text", "confidence"))), lambda i: F.struct(i["text"].alias("text"), i["confidence"].alias("confidence"))).alias("tappable_items"))
    s = screens.join(nested, "id", "left").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("id", "fingerprint", "title", "depth", "parent_fp", "phash", "screenshot_path", "discovered_at", "tappable_items"))).alias("x"))
    shown = F.transform("x", lambda r: F.struct(*[r[c].alias(c) for c in ("fingerprint", "title", "depth", "parent_fp", "tappable_items", "phash", "screenshot_path", "discovered_at")]))
    d = s.join(sessions.select("session_id", "game_title", "device_mode"), "session_id", "left")
    return d.select("session_id", F.to_json(F.struct("session_id", "game_title", "device_mode", shown.alias("screens"), F.struct(F.size("x").alias("screens_found")).alias("stats"))).alias("json"))


def tree_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, json): nodes by fingerprint and edges of each session."""
    n = nodes.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("fingerprint", F.struct("title", "depth", "phash", "discovered_at").alias("node"))))).alias("nodes"))
    e = edges.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("from_fp"), F.col("dst").alias("to_fp")))).alias("edges"))
    return n.join(e, "session_id", "left").select("session_id", F.to_json(F.struct("session_id", "nodes", F.coalesce("edges", F.expr("cast(array() as array<struct<from_fp:string,to_fp:string>>)")).alias("edges"))).alias("json"))


def anomalies(screens: DataFrame, reason: str) -> DataFrame:
    """(id, file_reason, json): evidence of screens that look wrong, with all words of their text."""
    safe = F.substring(F.regexp_replace(F.lit(reason), "[^A-Za-z0-9_-]", "_"), 1, 24)
    return screens.select("id", safe.alias("file_reason"), F.to_json(F.struct("discovered_at", safe.alias("reason"), "title", F.split(F.coalesce("ocr_text", F.lit("")), " ").alias("ocr"))).alias("json"))


def api_answer(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """One row: the first rows as an API answer with their number (S17); the limit bounds it."""
    return rows.orderBy(*order).limit(limit).agg(F.to_json(F.struct(F.collect_list(F.struct(*rows.columns)).alias("screens"), F.count("*").alias("count"))).alias("json"))


def tidy_paths(chains: DataFrame) -> DataFrame:
    """Where a screenshot belongs: folders by the titles from the root down, a name by fingerprint and title.
    chains: node, chain (array of titles)."""
    folders = F.array_join(F.transform("chain", lambda t: slug(t)), "/")
    return chains.select("*", F.concat(folders, F.lit("/"), F.substring("node", 1, 8), F.lit("_"), slug(F.element_at("chain", -1)), F.lit(".png")).alias("dest_path"))


def markdown_list(tree_lines: DataFrame) -> DataFrame:
    """Tree lines as a nested Markdown list."""
    indent = F.regexp_extract("line", "^ *", 0)
    return tree_lines.withColumn("line", F.concat(indent, F.lit("- "), F.ltrim("line")))


def write_documents(documents: DataFrame, path: str) -> None:
    """One line of JSON per document."""
    documents.select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def session_counts(screens: DataFrame) -> DataFrame:
    """Screens, items, links and greatest depth of each session, as reports head them (A17, A19). screens: n_items."""
    return screens.groupBy("session_id").agg(F.count("*").alias("screens_found"), F.sum("n_items").alias("n_items"), F.count_if(F.coalesce("parent_fp", F.lit("")) != "").alias("n_links"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"))


def report_table(screens: DataFrame) -> DataFrame:
    """(session_id, line_no, line): the rows of a session's screen table by depth and title, in order of id on ties (S16,
    O6). screens: n_items."""
    w = Window.partitionBy("session_id").orderBy(F.coalesce("depth", F.lit(0)), F.coalesce("title", F.lit("")), "id")
    seen = F.coalesce(F.substring(F.nullif("discovered_at", F.lit("")), 1, 19), F.lit("-"))
    cells = [F.col("line_no").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("depth", F.lit(0)).cast("string"), F.concat(F.lit("`"), F.substring(F.coalesce("fingerprint", F.lit("")), 1, 8), F.lit("`")), F.concat("n_items", F.lit("件")), seen]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return screens.withColumn("line_no", F.row_number().over(w)).select("session_id", "line_no", line.alias("line"))


def tidy_counts(paths: DataFrame, there: DataFrame) -> DataFrame:
    """One row: screenshots to copy and those whose place is taken already (S18). paths: of tidy_paths(); there: dest_path."""
    t = there.select("dest_path").distinct().withColumn("_there", F.lit(True))
    return paths.join(t, "dest_path", "left").agg(F.count_if(F.col("_there").isNull()).alias("copied"), F.count_if(F.col("_there").isNotNull()).alias("skipped"))


def report(profiles: DataFrame, slug_: str, sessions: DataFrame, screens: DataFrame, log: DataFrame) -> DataFrame:
    """(part, line_no, line): what a report of the title with that slug holds (S19): its profile, the newest session's
    screens and the end of the log. profiles: title, platform; sessions: session_id, game_title, id; log: line_no, line."""
    mine = profiles.where(slug(F.col("title")) == slug_).orderBy("title").limit(1)
    head = mine.select(F.lit(0).alias("part"), F.lit(1).alias("line_no"), F.concat_ws(" ", "title", "platform").alias("line"))
    newest = sessions.join(mine.select(F.col("title").alias("game_title")), "game_title").orderBy(F.desc("id")).limit(1).select("session_id")
    body = report_table(screens.join(newest, "session_id")).select(F.lit(1).alias("part"), "line_no", "line")
    return head.unionByName(body).unionByName(log.select(F.lit(2).alias("part"), F.col("line_no").cast("int").alias("line_no"), "line"))
