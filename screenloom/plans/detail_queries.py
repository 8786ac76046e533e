"""Lookups, lists, details, templates, badges and smaller functions over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from ..operators import frames, ingest, rules, search
from ..session import table
from .relational_queries import _S, _screens
from .structure_queries import _W, _frames, _with_items
from .text_queries import _B, boxes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT id, session_id, coalesce(title, '-') AS title FROM lc_screens WHERE id = 42")
def screen_by_id(spark, d):
    return search.by_id(table(spark, d, "lc_screens"), 42).select("id", "session_id", F.coalesce("title", F.lit("-")).alias("title"))


@query(_S + "SELECT s.id, g.id AS game_id, g.platform FROM scr s JOIN games g ON g.name = s.game_title")
def screens_games(spark, d):
    return search.with_games(_screens(spark, d), table(spark, d, "games")).select("id", "game_id", "platform")


_EL = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS screen_id, l_partkey % 900 AS bbox_x, l_suppkey * 17 % 1800 AS bbox_y, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey END AS navigates_to FROM lineitem)"


@query(f"SELECT e.id, screen_id, coalesce(p_name, '-') AS target_name, row_number() OVER (PARTITION BY screen_id ORDER BY bbox_y, bbox_x, e.id) AS place FROM {_EL} e LEFT JOIN part ON p_partkey = navigates_to")
def screen_detail_elements(spark, d):
    """Lines stand for elements of a screen, parts for the screens they lead to."""
    e = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("screen_id"), (F.col("l_partkey") % 900).alias("bbox_x"), (F.col("l_suppkey") * 17 % 1800).alias("bbox_y"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_partkey")).alias("navigates_to"))
    out = search.elements(e, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return out.select("id", "screen_id", F.coalesce("target_name", F.lit("-")).alias("target_name"), F.col("place").cast("long").alias("place"))


@query("SELECT id, coalesce(text, '-') AS text FROM lc_tappable_items WHERE screen_id = 5")
def screen_items_of(spark, d):
    return search.items_of_screen(table(spark, d, "lc_tappable_items"), 5).select("id", F.coalesce("text", F.lit("-")).alias("text"))


@query("SELECT fingerprint, min(id) AS first_id, CAST(coalesce(min(depth), -1) AS INT) AS min_depth FROM lc_screens GROUP BY 1 ORDER BY min(depth) NULLS LAST, min(discovered_at) NULLS LAST, fingerprint LIMIT 500")
def project_list(spark, d):
    return search.project_list(search.project_screens(table(spark, d, "lc_screens"))).select("fingerprint", "first_id", F.coalesce("min_depth", F.lit(-1)).alias("min_depth"))


@query("SELECT id, CAST(coalesce(depth, -1) AS INT) AS depth, coalesce(title, '-') AS title FROM lc_screens ORDER BY lc_screens.depth NULLS LAST, lc_screens.title NULLS LAST, id LIMIT 500")
def screens_by_depth(spark, d):
    return search.by_depth(table(spark, d, "lc_screens")).select("id", F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("title", F.lit("-")).alias("title"))


@query("SELECT id, priority, area FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 180 < 10 OR l_partkey % 180 > 155 THEN 9 WHEN l_partkey % 180 < 25 THEN 10 WHEN l_partkey % 180 < 35 THEN 4 WHEN l_partkey % 180 < 85 THEN 6 WHEN l_partkey % 180 < 125 THEN 7 ELSE 5 END AS priority, l_suppkey * 17 % 1800 AS area FROM lineitem) ORDER BY priority DESC, area DESC, id LIMIT 20")
def tap_candidates(spark, d):
    """The most urgent coloured candidates: a line's part number gives its hue, its supplier the area."""
    name = geo.colour(F.col("l_partkey") % 180, F.lit(200), F.lit(200))
    c = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), geo.colour_priority(name).alias("priority"), (F.col("l_suppkey") * 17 % 1800).alias("area"))
    return search.most_urgent(c, "priority", "area", 20)


@query("SELECT id FROM lc_screens WHERE (contains(lower(coalesce(title, '')), 'メニュ') OR contains(lower(coalesce(ocr_text, '')), 'メニュ')) AND (contains(lower(coalesce(title, '')), 'lv_') OR contains(lower(coalesce(ocr_text, '')), 'lv_') OR contains(lower(coalesce(ocr_text, '')), 'lv'))")
def search_fallback(spark, d):
    """Both strings must occur in name or text; a keyword '0' doesn't count."""
    rows = table(spark, d, "lc_screens").select("id", F.col("title").alias("name"), "ocr_text")
    return search.filtered(search.filtered(rows, "メニュ", "LV"), "", "0").select("id")


@query("SELECT id, CASE status WHEN 'running' THEN '🟢' WHEN 'completed' THEN '✅' WHEN 'failed' THEN '❌' WHEN 'paused' THEN '⏸' ELSE '' END AS icon FROM crawl_sessions")
def status_badges(spark, d):
    return table(spark, d, "crawl_sessions").select("id", search.icon(F.col("status"), search.STATUS_ICONS).alias("icon"))


_SC = "SELECT l_orderkey AS image, l_linenumber AS template_id, 1 - l_discount * 4 AS score, 0.6 + l_tax AS threshold, l_returnflag <> 'N' AS open FROM lineitem"


@query(f"SELECT image, template_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, template_id) AS r FROM ({_SC}) WHERE score >= threshold AND open) WHERE r = 1")
def best_template(spark, d):
    """Lines stand for the scores of templates on an image; the return flag for the gate."""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("template_id"), (1 - F.col("l_discount") * 4).alias("score"), (F.lit(0.6) + F.col("l_tax")).alias("threshold"), (F.col("l_returnflag") != "N").alias("open"))
    return rules.best_template(s, ["image"]).withColumn("score", F.round("score", 6))


_D = sorted(rules.DESCRIPTIONS.items(), key=lambda kv: -len(kv[0]))


@query("SELECT id, CASE " + " ".join(f"WHEN contains(text, '{k}') THEN '{v}'" for k, v in _D) + " ELSE '未知の操作が実行される' END AS description FROM lc_tappable_items WHERE text IS NOT NULL")
def predict_description(spark, d):
    t = table(spark, d, "lc_tappable_items").where("text is not null")
    return t.select("id", rules.prediction(F.col("text"))["description"].alias("description"))


@query("SELECT id FROM lc_tappable_items WHERE text NOT IN ('OK', 'Menu') AND NOT starts_with(text, 'プレイヤー') AND NOT contains(text, '/')")
def other_words(spark, d):
    t = table(spark, d, "lc_tappable_items").where("text is not null")
    return t.where(rules.other_than(F.col("text"), ["OK", "Menu"], ["プレイヤー"], ["/"])).select("id")


@query("SELECT id, len(list_filter(string_split(ocr_text, ' '), lambda t: t = 'Lv')) >= 1 AS lv, array_to_string(list_filter(string_split(ocr_text, ' '), lambda t: length(t) > 1), ' / ') AS joined FROM lc_screens WHERE ocr_text IS NOT NULL")
def text_counts(spark, d):
    words = F.split("ocr_text", " ")
    return table(spark, d, "lc_screens").where("ocr_text is not null").select("id", rules.repeated(words, "Lv", 1).alias("lv"), ingest.several_joined(words).alias("joined"))


@query(_B + "SELECT screen_id, array_to_string(list(text ORDER BY cy, n), '|') AS by_y, arg_max(text, row(conf, -n)) AS surest FROM b GROUP BY 1")
def boxes_by_y(spark, d):
    b = boxes(spark, d)
    return b.select("screen_id", F.array_join(F.transform(geo.rows_by_y(F.col("boxes")), lambda r: r["text"]), "|").alias("by_y"), geo.surest_text(F.col("boxes")).alias("surest"))


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean, coalesce(list_min(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 999) AS least FROM embeddings")
def array_means(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(geo.mean(e), 6).alias("mean"), frames.least_distance(e).alias("least"))


@query("SELECT id, coalesce(device_id IN (SELECT device_id FROM crawl_sessions WHERE status = 'failed' AND device_id IS NOT NULL), FALSE) AS known FROM crawl_sessions")
def resumed_flag(spark, d):
    s = table(spark, d, "crawl_sessions")
    return ingest.known(s.select("id", "device_id"), ["device_id"], s.where("status = 'failed'")).select("id", "known")


@query("SELECT phash FROM (SELECT DISTINCT phash FROM lc_screens WHERE phash IS NOT NULL AND import_batch > 12) WHERE phash NOT IN (SELECT phash FROM lc_screens WHERE phash IS NOT NULL AND import_batch <= 12)")
def failed_hashes(spark, d):
    """Hashes of late batches without those of the early ones."""
    s = table(spark, d, "lc_screens").where("phash is not null")
    return ingest.without(s.where("import_batch > 12").select("phash").distinct(), "phash", s.where("import_batch <= 12").select("phash"))


@query("WITH f AS (SELECT session_id AS hash, arg_min(status, id) AS action, min(id) AS seen, 'auto' AS source FROM lc_sessions WHERE session_id IS NOT NULL AND id % 2 = 0 GROUP BY 1), t AS (SELECT session_id AS hash, coalesce(max_by(coalesce(status, '-'), id), '-') AS action, max(id) AS seen, 'human_solved' AS source FROM lc_sessions WHERE session_id IS NOT NULL AND id % 3 = 0 GROUP BY 1) SELECT hash, coalesce(action, '-') AS action, seen, source FROM t UNION ALL SELECT hash, coalesce(action, '-'), seen, source FROM f WHERE hash NOT IN (SELECT hash FROM t)")
def taught_actions(spark, d):
    s = table(spark, d, "lc_sessions").where("session_id is not null").select(F.col("session_id").alias("hash"), F.coalesce("status", F.lit("-")).alias("action"), F.col("id").alias("seen"))
    first = s.where("seen % 2 = 0").groupBy("hash").agg(F.min(F.struct("seen", "action")).alias("r")).select("hash", "r.action", "r.seen", F.lit("auto").alias("source"))
    return ingest.teach(first, s.where("seen % 3 = 0"), "hash", "seen")


ORACLES["taught_actions"] = ORACLES["taught_actions"].replace("arg_min(status, id)", "arg_min(coalesce(status, '-'), id)")


@query("WITH w AS (SELECT c.id, c.game_id, c.status AS owner, g.name AS title FROM crawl_sessions c JOIN games g ON g.id = c.game_id), r AS (SELECT *, CASE WHEN lower(owner) = 'failed' THEN 0 WHEN lower(owner) = 'completed' THEN 1 WHEN contains(lower(coalesce(owner, '') || ' ' || coalesce(title, '')), 'failed') OR contains(lower(coalesce(owner, '') || ' ' || coalesce(title, '')), 'completed') THEN 2 END AS k FROM w) SELECT game_id, arg_min(id, row(k, id)) AS id, CASE WHEN min(k) < 2 THEN 'owner' ELSE 'title' END AS by FROM r WHERE k IS NOT NULL GROUP BY 1")
def owned_window(spark, d):
    """Crawl sessions stand for windows, their status for the owner."""
    g = table(spark, d, "games").select(F.col("id").alias("game_id"), F.col("name").alias("title"))
    w = table(spark, d, "crawl_sessions").select("id", "game_id", F.col("status").alias("owner")).join(g, "game_id")
    return ingest.owned_window(w, "game_id", ["Failed", "COMPLETED"])


@query(f"""WITH f AS (SELECT *, value <= 10 AS dark, sum(CASE WHEN value <= 10 THEN 1 ELSE 0 END) OVER {_W} AS lit FROM events), l AS (SELECT *, coalesce(abs(value - lag(value) OVER w), 999) >= 5 AS changed, row_number() OVER w AS n FROM f WHERE NOT dark WINDOW w AS (PARTITION BY user_id, lit ORDER BY ts, event_id))
SELECT event_id AS id, n - coalesce(max(CASE WHEN changed THEN n END) OVER (PARTITION BY user_id, lit ORDER BY ts, event_id), 1) AS unchanged FROM l""")
def dark_frames(spark, d):
    f = frames.lit_islands(_frames(spark, d), F.col("value"), 10, lambda w: frames.distance_to_last(F.col("value"), w) >= 5, frames.order("user_id"), "user_id")
    return f.select("id", F.col("unchanged").cast("long").alias("unchanged"))


@query(f"""WITH f AS (SELECT *, event_type = 'error' AS bites FROM events), g AS (SELECT *, bites AND NOT coalesce(lag(bites) OVER {_W}, FALSE) AS begins FROM f), h AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER {_W} AS n FROM g) SELECT event_id AS id, CAST(n AS BIGINT) AS recovery FROM h WHERE begins AND n <= 3""")
def watchdog_recoveries(spark, d):
    """Errors stand for bites of the watchdog."""
    f = frames.recoveries(_frames(spark, d), F.col("event_type") == "error", frames.order("user_id"))
    return f.where("recovery is not null").select("id", "recovery")


@query(f"SELECT user_id, coalesce(min(CASE WHEN event_type = 'view' AND value >= 20 AND value < 80 AND n <= 5 THEN n END), -1) AS attempt FROM (SELECT *, row_number() OVER {_W} AS n FROM events) GROUP BY 1")
def root_reappears(spark, d):
    f = frames.found_within(_frames(spark, d), "user_id", F.col("event_type") == "view", F.col("value"), 20, 80)
    return f.select("user_id", F.coalesce("attempt", F.lit(-1)).cast("long").alias("attempt"))


@query("SELECT device_id, CASE WHEN platform = 'ios' THEN 'ios' WHEN tz_name <> '' THEN 'android' ELSE 'unknown' END AS platform, regexp_matches(device_id, '^([0-9A-Fa-f]{8}-[0-9A-Fa-f]{16}|[0-9A-Fa-f]{24,40})$') AS udid, CASE WHEN upper(platform) IN ('MIRROR', 'ANDROID') THEN upper(platform) WHEN trim(model) <> '' THEN 'ANDROID' ELSE 'SIMULATOR' END AS mode FROM devices")
def device_facts(spark, d):
    ios = F.when(F.col("platform") == "ios", F.col("device_id"))
    return table(spark, d, "devices").select("device_id", tx.platform_of([ios], [F.col("tz_name")]).alias("platform"), tx.is_udid(F.col("device_id")).alias("udid"), tx.device_mode(F.col("platform"), F.col("model")).alias("mode"))


@query("WITH v AS (SELECT p_brand, p_size % 25 AS a, p_partkey % 12 AS b, p_partkey FROM part) SELECT p_brand, arg_max(p_partkey, row(a < 20, a, b, p_partkey)) AS newest FROM v GROUP BY 1")
def newest_model(spark, d):
    version = F.concat_ws(".", (F.col("p_size") % 25).cast("string"), (F.col("p_partkey") % 12).cast("string"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(tx.model_key(F.lit("x"), version), "p_partkey")).alias("newest"))


@query("SELECT s.id, CASE WHEN title = 'unknown' THEN '❓ unknown' ELSE coalesce(title, '') END AS shown, CASE WHEN title = 'unknown' THEN '← 要調査' WHEN n <= 1 AND depth > 0 THEN '⚠ タップ候補少' ELSE '' END AS warning FROM lc_screens s JOIN (SELECT x.id, count(i.id) AS n FROM lc_screens x LEFT JOIN lc_tappable_items i ON i.screen_id = x.id GROUP BY 1) USING (id)")
def title_warnings(spark, d):
    s = _with_items(spark, d)
    return s.select("id", tx.shown_title(F.col("title")).alias("shown"), tx.title_warning(F.col("title"), F.col("n_items"), F.col("depth")).alias("warning"))


@query("SELECT session_id, count(*) AS screens_found, CAST(sum(n) AS BIGINT) AS n_items, count(*) FILTER (coalesce(parent_fp, '') <> '') AS n_links, CAST(coalesce(max(depth), 0) AS BIGINT) AS max_depth FROM (SELECT x.id, x.session_id, x.parent_fp, x.depth, count(i.id) AS n FROM lc_screens x LEFT JOIN lc_tappable_items i ON i.screen_id = x.id GROUP BY ALL) GROUP BY 1")
def session_counts(spark, d):
    from ..sources import writers

    return writers.session_counts(_with_items(spark, d))


@query("WITH n AS (SELECT s.*, (SELECT count(*) FROM lc_tappable_items i WHERE i.screen_id = s.id) AS c FROM lc_screens s) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(depth, 0), coalesce(title, ''), id) AS line_no, '| ' || row_number() OVER (PARTITION BY session_id ORDER BY coalesce(depth, 0), coalesce(title, ''), id) || ' | ' || coalesce(title, '') || ' | ' || coalesce(depth, 0) || ' | `' || left(coalesce(fingerprint, ''), 8) || '` | ' || c || '件 | ' || coalesce(left(nullif(discovered_at, ''), 19), '-') || ' |' AS line FROM n")
def report_table(spark, d):
    from ..sources import writers

    return writers.report_table(_with_items(spark, d)).withColumn("line_no", F.col("line_no").cast("long"))
