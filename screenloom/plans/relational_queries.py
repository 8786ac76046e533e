"""Search, coverage, panels, details, upserts and imports over the screen tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, search
from ..session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return search.first_sessions(table(spark, d, "lc_sessions"))


def _screens(spark: SparkSession, d: str) -> DataFrame:
    return search.with_sessions(table(spark, d, "lc_screens"), _sessions(spark, d))


_S = """WITH ses AS (SELECT * FROM lc_sessions x WHERE session_id IS NOT NULL AND id = (SELECT min(id) FROM lc_sessions y WHERE y.session_id = x.session_id)),
scr AS (SELECT s.*, coalesce(e.game_title, 'Unknown Game') AS game_title, coalesce(e.device_mode, 'SIMULATOR') AS device_mode FROM lc_screens s LEFT JOIN ses e USING (session_id)) """
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(_S + "SELECT game_title, count(DISTINCT fingerprint) AS unique_screens, CAST(coalesce(max(depth), 0) AS BIGINT) AS max_depth, count(DISTINCT session_id) AS sessions FROM scr GROUP BY 1")
def coverage_by_game(spark, d):
    return search.coverage(_screens(spark, d), "game_title")


@query(_S + "SELECT count(DISTINCT fingerprint) AS unique_screens, CAST(coalesce(max(depth), 0) AS BIGINT) AS max_depth, count(DISTINCT session_id) AS sessions FROM scr WHERE game_title = 'no such game'")
def coverage_missing_game(spark, d):
    return search.coverage(_screens(spark, d).where("game_title = 'no such game'"))


@query("SELECT DISTINCT game_title FROM lc_sessions WHERE game_title IS NOT NULL")
def game_titles(spark, d):
    return search.titles(table(spark, d, "lc_sessions"))


_PANEL = "SELECT c.id, g.name AS game_name, g.platform, c.status, c.screens_found, c.ended_at, CASE WHEN c.ended_at IS NULL THEN 'running' ELSE strftime(c.ended_at, '%Y%m%d_%H%M%S') END AS session_dir FROM crawl_sessions c JOIN games g ON g.id = c.game_id"


def _panel(spark, d):
    return search.panel(table(spark, d, "crawl_sessions"), table(spark, d, "games"))


@query(_PANEL + " ORDER BY c.ended_at DESC NULLS LAST, c.id DESC LIMIT 20")
def session_panel(spark, d):
    return search.newest(_panel(spark, d))


@query(_PANEL + " WHERE g.platform = 'android' AND c.status = 'failed'")
def session_panel_filtered(spark, d):
    return _panel(spark, d).where("platform = 'android' and status = 'failed'")


@query("SELECT device_id, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed, count(*) AS total FROM crawl_sessions GROUP BY 1")
def running_badge(spark, d):
    return search.running(table(spark, d, "crawl_sessions"), "device_id")


@query(_S + f"SELECT id, session_id, title, discovered_at, game_title FROM scr WHERE {_FOLD.format('title')} LIKE '%rank_1%' OR {_FOLD.format('ocr_text')} LIKE '%rank_1%'")
def search_keyword_all(spark, d):
    """Every screen that matches; % and _ of the keyword stay wildcards."""
    return _screens(spark, d).where(search.matching(keyword="RANK_1")).select("id", "session_id", "title", "discovered_at", "game_title")


@query(_S + f"SELECT id, session_id, title, discovered_at, game_title FROM scr WHERE {_FOLD.format('title')} LIKE '%lv%' OR {_FOLD.format('ocr_text')} LIKE '%lv%' ORDER BY discovered_at DESC NULLS LAST, id DESC LIMIT 20")
def search_keyword(spark, d):
    return search.search(table(spark, d, "lc_screens"), _sessions(spark, d), keyword="Lv").select("id", "session_id", "title", "discovered_at", "game_title")


@query(_S + f"SELECT id, title, ocr_text, game_title FROM scr WHERE {_FOLD.format('title')} LIKE '%メニュー%' AND ({_FOLD.format('title')} LIKE '%lv%' OR {_FOLD.format('ocr_text')} LIKE '%lv%') AND game_title <> 'Unknown Game'")
def search_advanced(spark, d):
    return _screens(spark, d).where(search.all_of(search.matching(title="メニュー", keyword="LV"), F.col("game_title") != "Unknown Game")).select("id", "title", "ocr_text", "game_title")


@query(_S + "SELECT id, game_title, device_mode FROM scr")
def search_default_title(spark, d):
    return _screens(spark, d).select("id", "game_title", "device_mode")


@query("""WITH t AS (SELECT id, string_split(lower(coalesce(ocr_text, '')), ' ') AS w FROM lc_screens),
c AS (SELECT id, len(list_filter(w, lambda x: x = 'confirm')) AS a, len(list_filter(w, lambda x: starts_with(x, 'can'))) AS b FROM t),
n AS (SELECT count(*) AS n, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT id, round(coalesce(a * pow(log10(n / nullif(da, 0)), 2), 0) + coalesce(b * pow(log10(n / nullif(db, 0)), 2), 0), 6) AS relevance FROM c JOIN lc_screens USING (id), n WHERE a > 0 OR b > 0 ORDER BY relevance DESC, discovered_at DESC NULLS LAST, id DESC LIMIT 50""")
def search_prefix_rank(spark, d):
    return search.ranked(table(spark, d, "lc_screens"), "confirm can", 50).select("id", "relevance")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the ') AND (contains(lower(text), 'map') OR contains(lower(game_title), 'map'))")
def search_literal_ci(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.col("game_title").alias("name"), F.col("text").alias("ocr_text"))
    return search.filtered(rows, "map", "The ").where(F.lower("ocr_text").contains("the ")).select("doc_id", "lang")


@query("""WITH b AS (SELECT fingerprint, min(id) AS first_id, min(depth) AS min_depth, min(discovered_at) AS first_seen FROM lc_screens GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY coalesce(depth, 2147483647), coalesce(discovered_at, '￿'), id) AS rn FROM lc_screens)
SELECT b.fingerprint, first_id, CAST(coalesce(min_depth, -1) AS INT) AS min_depth, first_seen, r.title, r.session_id, r.phash FROM b JOIN r USING (fingerprint) WHERE rn = 1""")
def project_screens(spark, d):
    return search.project_screens(table(spark, d, "lc_screens")).withColumn("min_depth", F.coalesce("min_depth", F.lit(-1)))


@query("SELECT s.id, count(i.id) AS n_items, round(coalesce(max(i.confidence), -1), 6) AS best FROM lc_screens s LEFT JOIN lc_tappable_items i ON i.screen_id = s.id GROUP BY s.id")
def screen_items(spark, d):
    return search.item_counts(table(spark, d, "lc_screens"), table(spark, d, "lc_tappable_items")).select("id", "n_items", F.round(F.coalesce("best", F.lit(-1.0)), 6).alias("best"))


@query("SELECT s.id, coalesce((SELECT min(p.id) FROM lc_screens p WHERE p.session_id = s.session_id AND p.fingerprint = s.parent_fp), -1) AS parent_id FROM lc_screens s")
def screen_parents(spark, d):
    return search.parents_of(table(spark, d, "lc_screens")).select("id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


@query(_S + "SELECT id, coalesce(nullif(title, ''), 'unknown') AS name, 'depth=' || coalesce(depth, 0) AS category, screenshot_path, CAST(NULL AS VARCHAR) AS thumbnail_path, 1 AS visited_count, discovered_at AS last_seen_at, game_title, 'ios' AS platform FROM scr")
def api_shape(spark, d):
    return search.api_rows(_screens(spark, d))


@query(_S + "SELECT DISTINCT game_title, phash FROM scr WHERE phash <> ''")
def known_hashes(spark, d):
    return search.known_hashes(_screens(spark, d))


@query("SELECT device_id, CAST(round_even(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (status = 'failed') * 100.0 / count(*) END, 0) AS BIGINT) AS percent FROM crawl_sessions GROUP BY 1")
def known_ratio(spark, d):
    n = table(spark, d, "crawl_sessions").groupBy("device_id").agg(F.count_if(F.col("status") == "failed").alias("s"), F.count_if(~F.coalesce(F.col("status") == "failed", F.lit(False))).alias("f"))
    return n.select("device_id", search.known_ratio(F.col("f"), F.col("s")).alias("percent"))


@query("SELECT id, coalesce(contains(screenshot_path, '/' || left(session_id, 15) || '/'), FALSE) AS in_session, CASE WHEN starts_with(screenshot_path, 'evidence/') AND lower(regexp_extract(screenshot_path, '\\.([A-Za-z0-9]+)$', 1)) = 'png' THEN 'image/png' END AS mime FROM lc_screens")
def image_paths(spark, d):
    s = table(spark, d, "lc_screens")
    return s.select("id", F.coalesce(search.path_has_session(F.col("screenshot_path"), F.substring("session_id", 1, 15)), F.lit(False)).alias("in_session"), search.image_type(F.col("screenshot_path"), ["evidence/"]).alias("mime"))


@query("SELECT user_id, event_type, count(*) AS visited_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at, arg_min(props, row(ts, event_id)) AS name FROM events GROUP BY ALL")
def upsert_visits(spark, d):
    e = table(spark, d, "events")
    keys, half = ["user_id", "event_type"], F.col("event_id") % 2 == 0
    first, second = (ingest.fold_visits(e.where(c), keys, "props", "ts", "event_id") for c in (F.col("ts") < "2024-01-03", F.col("ts") >= "2024-01-03"))
    return ingest.upsert_visits(first, second, keys)


@query("SELECT session_id, fingerprint, min(id) AS id FROM lc_screens GROUP BY ALL")
def import_dedup(spark, d):
    return ingest.first_of(table(spark, d, "lc_screens").select("session_id", "fingerprint", "id"), ["session_id", "fingerprint"], "id")


@query("""SELECT session_id, fingerprint, min(id) AS id FROM lc_screens s WHERE import_batch > 12 AND NOT EXISTS (SELECT 1 FROM lc_screens p WHERE p.import_batch <= 12 AND p.session_id = s.session_id AND p.fingerprint = s.fingerprint) GROUP BY ALL""")
def import_antijoin(spark, d):
    s = table(spark, d, "lc_screens").select("session_id", "fingerprint", "id", "import_batch")
    return ingest.insert_ignore(s.where("import_batch <= 12").drop("import_batch"), s.where("import_batch > 12").drop("import_batch"), ["session_id", "fingerprint"], "id")


@query("SELECT screen_id, string_agg(text, ' ' ORDER BY id) AS joined FROM lc_tappable_items WHERE text IS NOT NULL GROUP BY 1")
def import_nested_items(spark, d):
    return ingest.joined_texts(table(spark, d, "lc_tappable_items"), "screen_id", "text", "id")


@query("SELECT id, session_id, coalesce(game_title, 'Unknown Game') AS game_title, coalesce(device_mode, 'SIMULATOR') AS device_mode, coalesce(status, 'completed') AS status, '' AS note FROM lc_sessions")
def migrate_defaults(spark, d):
    s = table(spark, d, "lc_sessions").select("id", "session_id", "game_title", "device_mode", "status")
    return ingest.migrate(s, {"game_title": ("string", "Unknown Game"), "device_mode": ("string", "SIMULATOR"), "status": ("string", "completed"), "note": ("string", "")})


@query("SELECT g.id, g.name, (SELECT count(*) FROM crawl_sessions c WHERE c.game_id = g.id) AS hit_count FROM games g")
def hit_counter(spark, d):
    state = table(spark, d, "games").select("id", "name", F.lit(0).cast("long").alias("hit_count"))
    return ingest.add_hits(state, table(spark, d, "crawl_sessions").select(F.col("game_id").alias("id")), "id")


@query("SELECT i.id, i.screen_id FROM lc_tappable_items i WHERE i.screen_id IS NULL OR NOT EXISTS (SELECT 1 FROM lc_deletions x WHERE x.table_name = 'lc_screens' AND x.row_key = CAST(i.screen_id AS VARCHAR))")
def cascade_delete(spark, d):
    gone = table(spark, d, "lc_deletions").where("table_name = 'lc_screens'").select(F.col("row_key").try_cast("long").alias("k"))
    return ingest.without(table(spark, d, "lc_tappable_items").select("id", "screen_id"), "screen_id", gone).select("id", "screen_id")


@query("SELECT id, coalesce(CASE WHEN EXISTS (SELECT 1 FROM lc_deletions x WHERE x.table_name = 'lc_sessions' AND x.row_key = s.session_id) THEN NULL ELSE session_id END, '-') AS session_id FROM lc_screens s")
def set_null(spark, d):
    gone = table(spark, d, "lc_deletions").where("table_name = 'lc_sessions'").select("row_key")
    return ingest.nulled(table(spark, d, "lc_screens").select("id", "session_id"), "session_id", gone).select("id", F.coalesce("session_id", F.lit("-")).alias("session_id"))


@query("""SELECT session_id, arg_max(status, id) AS status, arg_max(screens_found, id) AS screens_found, min(id) AS hit_count FROM lc_sessions GROUP BY 1""")
def replace_keeping(spark, d):
    s = table(spark, d, "lc_sessions").select("session_id", "status", "screens_found", "id")
    state = ingest.first_of(s, ["session_id"], "id").withColumnRenamed("id", "hit_count")
    latest = s.groupBy("session_id").agg(F.max_by(F.struct("status", "screens_found"), "id").alias("r"), F.max("id").alias("id")).select("session_id", "r.status", "r.screens_found", "id")
    return ingest.replace_keeping(state, latest, "session_id", "id", "hit_count")


@query("SELECT s.session_id, CASE WHEN n IS NULL THEN s.status ELSE 'completed' END AS status, coalesce(n, s.screens_found) AS screens_found, last AS ended_at FROM (SELECT * FROM lc_sessions x WHERE id = (SELECT min(id) FROM lc_sessions y WHERE y.session_id = x.session_id)) s LEFT JOIN (SELECT session_id, count(*) AS n, max(import_batch) AS last FROM lc_screens GROUP BY 1) USING (session_id) WHERE last IS NOT NULL")
def session_status(spark, d):
    done = table(spark, d, "lc_screens").groupBy("session_id").agg(F.count("*").alias("screens_found"), F.max("import_batch").alias("ended_at"))
    state = _sessions(spark, d).select("session_id", "status", "screens_found", F.lit(None).cast("int").alias("ended_at"))
    return ingest.set_status(state, done, "session_id").where("ended_at is not null")


@query("SELECT key, min(src) AS src FROM (SELECT game_title AS key, 'a' AS src FROM lc_projects UNION ALL SELECT name, 'b' FROM games) GROUP BY 1")
def by_priority(spark, d):
    a = table(spark, d, "lc_projects").select(F.col("game_title").alias("key"), F.lit("a").alias("src")).distinct()
    b = table(spark, d, "games").select(F.col("name").alias("key"), F.lit("b").alias("src")).distinct()
    return ingest.by_priority([a, b], "key")


@query("SELECT game_title, (SELECT max(id) FROM lc_projects) + row_number() OVER (ORDER BY game_title) AS id FROM (SELECT DISTINCT game_title FROM documents WHERE game_title NOT IN (SELECT game_title FROM lc_projects))")
def upsert_projects(spark, d):
    state = table(spark, d, "lc_projects").select("id", "game_title")
    new = table(spark, d, "documents").where("game_title is not null").select("game_title").distinct().join(state, "game_title", "left_anti")
    return ingest.with_ids(new, state, "id", "game_title").select("game_title", "id")
