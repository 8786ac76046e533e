"""Hashes, graphs and frame sequences over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import phash
from ..operators import frames, graph, hierarchy, ingest, similarity
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


# Hashes: a vector of 64 numbers is a block of 8 by 8 coefficients.

_H = """WITH v AS (SELECT vec_id, label, list_transform(embedding[:64], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) >= 64),
b AS (SELECT vec_id, label, array_to_string(list_transform(e, lambda x: CASE WHEN x > list_sum(e) / 64 THEN '1' ELSE '0' END), '') AS bits FROM v) """


def _bits(spark, d):
    e = table(spark, d, "embeddings").where(F.size("embedding") >= 64)
    return e.select("vec_id", "label", phash.bits_of_block(F.transform(F.slice("embedding", 1, 64), lambda x: x.cast("double"))).alias("bits")).withColumn("h", phash.signed("bits"))


@query(_H + "SELECT vec_id, bits FROM b")
def phash_bits(spark, d):
    return _bits(spark, d).select("vec_id", "bits")


@query(_H + "SELECT a.vec_id AS a, c.vec_id AS b, CAST(hamming(a.bits, c.bits) AS INT) AS distance FROM b a JOIN b c ON a.vec_id < c.vec_id AND hamming(a.bits, c.bits) < 16")
def phash_pairs(spark, d):
    """Pairs of vectors whose bits differ in fewer than 16 places."""
    v = _bits(spark, d)
    near = similarity.hamming_pairs(v, 16).unionByName(v.select(F.col("h").alias("a"), F.col("h").alias("b")).distinct().withColumn("distance", F.lit(0)))
    ids = v.select("vec_id", "h")
    pairs = near.join(ids.toDF("p", "a"), "a").join(ids.toDF("q", "b"), "b")
    return pairs.where("p <> q and (a <> b or p < q)").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")


@query(_H + "SELECT a.vec_id FROM b a WHERE label <> 0 AND NOT EXISTS (SELECT 1 FROM b c WHERE c.label = 0 AND hamming(a.bits, c.bits) < 16)")
def phash_novel(spark, d):
    """Vectors near none of the known ones (label 0): the anti-join goes through candidate pairs, never over all pairs."""
    v = _bits(spark, d)
    known = similarity.hamming_matches(v.where("label <> 0"), v.where("label = 0"), 16).select(F.col("lh").alias("h")).distinct()
    return v.where("label <> 0").join(known, "h", "left_anti").select("vec_id")


@query(_H + "SELECT a.vec_id, arg_min(c.vec_id, row(hamming(a.bits, c.bits), c.vec_id)) AS nearest, CAST(min(hamming(a.bits, c.bits)) AS INT) AS distance FROM b a JOIN b c ON c.label = 0 AND a.label <> 0 AND hamming(a.bits, c.bits) < 16 GROUP BY 1")
def phash_nearest(spark, d):
    v = _bits(spark, d)
    near = similarity.hamming_matches(v.where("label <> 0"), v.where("label = 0"), 16)
    best = near.join(v.where("label = 0").select("vec_id", F.col("h").alias("rh")), "rh").groupBy("lh").agg(F.min(F.struct("distance", "vec_id")).alias("b"))
    return v.where("label <> 0").join(best, F.col("h") == F.col("lh")).select(v["vec_id"], F.col("b.vec_id").alias("nearest"), F.col("b.distance").alias("distance"))


@query("SELECT title || '@' || fingerprint AS vkey, session_id, min(id) AS id FROM lc_screens WHERE title IS NOT NULL GROUP BY ALL")
def visit_key_dedup(spark, d):
    s = table(spark, d, "lc_screens").where("title is not null").select(F.concat_ws("@", "title", "fingerprint").alias("vkey"), "session_id", "id")
    return ingest.first_of(s, ["vkey", "session_id"], "id")


# Graphs: sessions are scopes, fingerprints nodes.


def _nodes(spark, d):
    return graph.nodes(table(spark, d, "lc_screens"), "session_id", "fingerprint", "id", "title", "depth", "parent_fp")


_N = """WITH RECURSIVE n AS (SELECT * FROM lc_screens s WHERE id = (SELECT max(id) FROM lc_screens t WHERE t.session_id = s.session_id AND t.fingerprint = s.fingerprint)),
e AS (SELECT session_id, parent_fp AS src, fingerprint AS dst FROM n WHERE parent_fp <> '') """


@query(_N + "SELECT * FROM e WHERE EXISTS (SELECT 1 FROM n WHERE n.session_id = e.session_id AND n.fingerprint = e.src)")
def graph_edges(spark, d):
    n = _nodes(spark, d)
    return graph.inner_edges(graph.edges(n, "session_id", "fingerprint", "parent_fp"), n, "session_id", "fingerprint")


@query(_N + "SELECT session_id, fingerprint FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = n.session_id AND e.dst = n.fingerprint)")
def graph_roots(spark, d):
    n = _nodes(spark, d)
    return graph.roots(n, graph.edges(n, "session_id", "fingerprint", "parent_fp"), "session_id", "fingerprint").select("session_id", "fingerprint")


@query(_N + "SELECT session_id, arg_min(fingerprint, id) AS root FROM n WHERE parent_fp IS NULL GROUP BY 1")
def graph_first_root(spark, d):
    return graph.first_root(_nodes(spark, d), "session_id", "fingerprint", "parent_fp", "id")


def _placed(spark, d):
    return hierarchy.hierarchy(hierarchy.nodes(table(spark, d, "lc_screens").withColumn("_last", -F.col("id")), "session_id", "fingerprint", "parent_fp", "depth", "_last"))


_P = _N + """, t AS (SELECT session_id, fingerprint, fingerprint AS path, coalesce(title, '') AS chain, 0 AS d FROM n WHERE NOT EXISTS (SELECT 1 FROM n p WHERE p.session_id = n.session_id AND p.fingerprint = nullif(n.parent_fp, ''))
UNION ALL SELECT n.session_id, n.fingerprint, t.path || '/' || n.fingerprint, t.chain || '/' || coalesce(n.title, ''), t.d + 1 FROM t JOIN n ON n.session_id = t.session_id AND n.parent_fp = t.fingerprint) """


@query(_P + "SELECT session_id, fingerprint, path, chain FROM t")
def graph_paths(spark, d):
    placed = _placed(spark, d).select("scope", "node", "path")
    titles = _nodes(spark, d).select(F.col("session_id").alias("scope"), F.col("fingerprint").alias("node"), F.coalesce("title", F.lit("")).alias("title"))
    return placed.join(graph.title_chain(placed, titles), ["scope", "node"]).select(F.col("scope").alias("session_id"), F.col("node").alias("fingerprint"), F.array_join("path", "/").alias("path"), F.array_join("chain", "/").alias("chain"))


@query(_N + "SELECT e.session_id, e.src, string_agg(e.dst, ',' ORDER BY n.id) AS children FROM e JOIN n ON n.session_id = e.session_id AND n.fingerprint = e.dst GROUP BY ALL")
def graph_children(spark, d):
    n = _nodes(spark, d)
    c = graph.children(graph.edges(n, "session_id", "fingerprint", "parent_fp"), n, "session_id", "fingerprint", "id")
    return c.select("session_id", "src", F.array_join("children", ",").alias("children"))


def _with_items(spark, d):
    items = table(spark, d, "lc_tappable_items").groupBy(F.col("screen_id").alias("id")).agg(F.count("*").alias("n"))
    return table(spark, d, "lc_screens").join(items, "id", "left").withColumn("n_items", F.coalesce("n", F.lit(0))).drop("n")


_I = "WITH c AS (SELECT s.*, (SELECT count(*) FROM lc_tappable_items i WHERE i.screen_id = s.id) AS n_items FROM lc_screens s) "


@query(_I + "SELECT id, unnest(list_filter([CASE WHEN title = 'unknown' THEN 'unknown_screen' WHEN length(title) <= 1 OR trim(title) IN ('>', '›', '<', '‹', '7', 'L', 'Q', '…', '-', '_') THEN 'suspicious_title' END, CASE WHEN n_items = 0 THEN 'untapped_screen' END], lambda x: x IS NOT NULL)) AS gap FROM c")
def graph_gaps(spark, d):
    return _with_items(spark, d).select("id", F.explode(graph.gaps(F.col("title"), F.col("n_items"))).alias("gap"))


@query(_I + "SELECT id, depth, n_items FROM c WHERE depth >= 4 AND n_items > 0")
def graph_frontier(spark, d):
    return graph.frontier(_with_items(spark, d), "depth", "n_items", 5).select("id", "depth", "n_items")


@query(_N + ", r AS (SELECT session_id, fingerprint AS node, 0 AS level FROM n WHERE coalesce(parent_fp, '') = '' UNION SELECT e.session_id, e.dst, r.level + 1 FROM r JOIN e ON e.session_id = r.session_id AND e.src = r.node WHERE r.level < 4) SELECT session_id, node, min(level) AS level FROM r GROUP BY ALL")
def graph_reach(spark, d):
    n = _nodes(spark, d)
    starts = n.where("coalesce(parent_fp, '') = ''").select("session_id", F.col("fingerprint").alias("node"))
    return graph.reach(graph.edges(n, "session_id", "fingerprint", "parent_fp"), starts, "session_id", 4)


@query(_N + "SELECT session_id, src AS node, 'child' AS role, dst AS other FROM e UNION SELECT session_id, dst, 'parent', src FROM e")
def graph_neighbours(spark, d):
    return graph.neighbours(graph.edges(_nodes(spark, d), "session_id", "fingerprint", "parent_fp"), "session_id")


_T = ", taps AS (SELECT session_id, parent_fp, title, fingerprint, id FROM n WHERE parent_fp <> '' AND title IS NOT NULL) "


@query(_N + _T + "SELECT session_id, parent_fp, title, arg_max(fingerprint, id) AS child FROM taps GROUP BY ALL")
def graph_tap_map(spark, d):
    """A screen's title stands for the text that was tapped to reach it."""
    log = _nodes(spark, d).where("parent_fp <> ''").withColumnRenamed("fingerprint", "child")
    return graph.tap_map(log, "session_id", "parent_fp", "title", "child", "id").select("session_id", "parent_fp", "title", "child")


@query(_P + ", ok AS (SELECT n.session_id, n.fingerprint FROM n JOIN n p ON p.session_id = n.session_id AND p.fingerprint = n.parent_fp WHERE n.title IS NOT NULL AND n.depth <= 3), " + """
s AS (SELECT t.session_id, t.fingerprint, t.d, u.k, string_split(t.path, '/')[u.k] AS step FROM t, LATERAL (SELECT unnest(range(2, t.d + 2)) AS k) u WHERE t.d > 0)
SELECT s.session_id, s.fingerprint, coalesce(CASE WHEN count(ok.fingerprint) = max(s.d) THEN string_agg(n.title, '>' ORDER BY s.k) END, '-') AS recipe FROM s JOIN n ON n.session_id = s.session_id AND n.fingerprint = s.step LEFT JOIN ok ON ok.session_id = s.session_id AND ok.fingerprint = s.step GROUP BY ALL""")
def nav_recipe(spark, d):
    """Titles to tap from the root on; a title can be tapped where the child's stored depth is known to be 3 or less."""
    n = _nodes(spark, d)
    taps = n.where("parent_fp <> '' and title is not null").select(F.col("session_id").alias("scope"), F.col("parent_fp").alias("parent"), F.col("title").alias("text"), F.col("fingerprint").alias("child"), F.col("id").alias("seq"), "depth")
    items = taps.where("depth <= 3").select("scope", F.col("parent").alias("node"), F.concat_ws("|", "child", "text").alias("text"))
    r = graph.recipes(_placed(spark, d), taps.withColumn("text", F.concat_ws("|", "child", "text")), items)
    cut = F.transform("recipe", lambda x: F.substring_index(x, "|", -1) if False else F.regexp_replace(x, "^[^|]*[|]", ""))
    return r.select(F.col("scope").alias("session_id"), F.col("node").alias("fingerprint"), F.coalesce(F.array_join(cut, ">"), F.lit("-")).alias("recipe"))


_IT = "(SELECT n.*, (SELECT count(*) FROM lc_tappable_items i WHERE i.screen_id = n.id) AS c FROM n)"
_ITEMS = "c || CASE WHEN c = 1 THEN ' item' ELSE ' items' END"


@query(_N + f""", k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id, fingerprint) - 1 AS k FROM {_IT} x WHERE fingerprint IS NOT NULL),
l AS (SELECT DISTINCT session_id, 0 AS part, 0 AS a, 0 AS b, 'graph TD' AS line FROM k
UNION ALL SELECT session_id, 1, k, 0, '    n' || k || '["' || CASE WHEN title = 'unknown' THEN '❓unknown' ELSE coalesce(title, '') END || ' (d=' || coalesce(depth, 0) || ') | ' || {_ITEMS} || '"]' FROM k
UNION ALL SELECT y.session_id, 2, y.k, x.k, '    n' || x.k || ' --> n' || y.k FROM k y JOIN k x ON x.session_id = y.session_id AND x.fingerprint = y.parent_fp WHERE y.parent_fp <> ''
UNION ALL SELECT session_id, 3, k, 0, '    style n' || k || ' fill:#ffcccc' FROM k WHERE title = 'unknown')
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY part, a, b, line) AS line_no, line FROM l""")
def mermaid_lines(spark, d):
    n = graph.nodes(_with_items(spark, d), "session_id", "fingerprint", "id", "title", "depth", "parent_fp", "n_items").fillna({"title": "", "depth": 0})
    lines = graph.mermaid_lines(n, graph.edges(n, "session_id", "fingerprint", "parent_fp"), "session_id", "fingerprint", "id")
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


@query(_N + f""", w AS (SELECT * FROM {_IT} x), t AS (SELECT session_id, fingerprint, title, c, [id] AS key, 0 AS d FROM w WHERE fingerprint IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n p WHERE p.session_id = w.session_id AND p.fingerprint = nullif(w.parent_fp, ''))
UNION ALL SELECT w.session_id, w.fingerprint, w.title, w.c, list_append(t.key, w.id), t.d + 1 FROM t JOIN w ON w.session_id = t.session_id AND w.parent_fp = t.fingerprint)
SELECT session_id AS scope, row_number() OVER (PARTITION BY session_id ORDER BY key, fingerprint) AS line_no, repeat('  ', d) || CASE WHEN title = 'unknown' THEN '❓ unknown' ELSE coalesce(title, '') END || ' [depth=' || d || '] (' || {_ITEMS} || ')' || CASE WHEN title = 'unknown' THEN '  ← unknown' WHEN c <= 1 AND d > 0 THEN '  ⚠ few items' ELSE '' END AS line FROM t""")
def tree_lines(spark, d):
    n = graph.nodes(_with_items(spark, d), "session_id", "fingerprint", "id", "title", "n_items")
    shown = n.select(F.col("session_id").alias("scope"), F.col("fingerprint").alias("node"), F.col("id").alias("pos"), "title", "n_items")
    return graph.tree_lines(_placed(spark, d), shown).withColumn("line_no", F.col("line_no").cast("long"))


# Frames: events of a user in order.


def _frames(spark, d):
    return table(spark, d, "events").withColumnRenamed("event_id", "id")


_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_E = f"""WITH f AS (SELECT *, abs(value - lag(value) OVER {_W}) AS dist0, lag(event_type) OVER {_W} AS last_action, row_number() OVER {_W} AS n FROM events),
g AS (SELECT *, coalesce(dist0, 999) AS dist, coalesce(dist0, 999) >= 5 AS changed FROM f),
i AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER {_W} AS island, max(CASE WHEN changed THEN n END) OVER {_W} AS start, max(CASE WHEN changed THEN ts END) OVER {_W} AS since FROM g) """


def _islands(spark, d):
    f = _frames(spark, d)
    w = frames.order("user_id")
    f = f.withColumns({"dist": frames.distance_to_last(F.col("value"), w), "last_action": F.lag("event_type").over(w)})
    return frames.islands(f, F.col("dist") >= 5, w)


@query(_E + "SELECT event_id AS id, round(dist, 6) AS dist, coalesce(last_action = 'click' AND dist BETWEEN 5 AND 25, FALSE) AS rapid FROM g")
def frame_change(spark, d):
    f = _islands(spark, d)
    return f.select("id", F.round("dist", 6).alias("dist"), frames.rapid(F.col("dist"), F.col("last_action"), "click").alias("rapid"))


@query(_E + "SELECT event_id AS id, CAST(island AS BIGINT) AS island, n - start AS unchanged, since, n - start >= 3 AS forced FROM i")
def frame_islands(spark, d):
    f = _islands(spark, d)
    return f.select("id", "island", F.col("unchanged").cast("long").alias("unchanged"), "since", frames.forced(F.col("unchanged")).alias("forced"))


@query(f"""WITH f AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER {_W} AS t FROM events), g AS (SELECT *, t - coalesce(last_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER {_W}, 0) AS c FROM f)
SELECT event_id AS id, CAST(c AS BIGINT) AS count, CASE WHEN c >= 6 THEN 'hopeless' WHEN c >= 4 THEN 'swipe+long_press' WHEN c >= 2 THEN 'swipe' ELSE 'none' END AS level FROM g""")
def stuck_levels(spark, d):
    """Errors since the last purchase stand for dead ends since the last way out."""
    f = frames.running_count(_frames(spark, d), F.col("event_type") == "error", F.col("event_type") == "purchase", frames.order("user_id"))
    return f.select("id", "count", frames.stuck_level(F.col("count")).alias("level"))


@query(_E + "SELECT event_id AS id, CASE WHEN s >= 14400 THEN 'fatal' WHEN s >= 7200 THEN 'corner_action' ELSE 'ok' END AS stall, s >= 21600 AND NOT coalesce(last_action IN ('view'), FALSE) AS bites FROM (SELECT *, epoch(ts - since) AS s FROM i)")
def stall_watchdog(spark, d):
    f = _islands(spark, d).withColumn("s", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 1e6)
    return f.select("id", frames.stall_state(F.col("s"), 7200, 14400).alias("stall"), frames.watchdog(F.col("s"), F.col("last_action"), ["view"], 21600).alias("bites"))


@query(_E + "SELECT user_id, min(CASE WHEN n > 1 AND dist <= 5 AND ts <= first + INTERVAL 3 DAY THEN ts END) AS settled_at FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first FROM g) GROUP BY 1")
def settle_time(spark, d):
    f = _frames(spark, d)
    return frames.settled(f, frames.distance_to_last(F.col("value"), frames.order("user_id")), "user_id", 5, "3 DAYS")


@query(f"""WITH f AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), g AS (SELECT *, row_number() OVER {_W} AS n, coalesce(abs(k - lag(k) OVER {_W}) <= 30 AND abs(value - lag(value) OVER {_W}) <= 30, FALSE) AS near FROM f)
SELECT event_id AS id, n - max(CASE WHEN NOT near THEN n END) OVER {_W} + 1 AS run FROM g""")
def near_position_run(spark, d):
    f = _frames(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return frames.near_runs(f, "k", "value", frames.order("user_id"), 30).select("id", F.col("run").cast("long").alias("run"))


@query("SELECT user_id, event_type, event_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1) WHERE rank <= 3")
def mru_top(spark, d):
    return frames.most_recent(_frames(spark, d), "user_id", ["event_type"], 3).select("user_id", "event_type", "id", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT event_id AS id, n AS seq, n >= 8 AND (n - 8) % 8 IN (0, 4) AS phase FROM (SELECT *, row_number() OVER {_W} AS n FROM events) WHERE n % 3 = 0")
def sample_every_n(spark, d):
    f = frames.every_nth(_frames(spark, d), frames.order("user_id"), 3)
    return f.select("id", F.col("seq").cast("long").alias("seq"), frames.cycle_phase(F.col("seq")).alias("phase"))


@query(f"SELECT event_type, count(*) FILTER (abs(nx - value) >= 5) AS success_count, count(*) FILTER (abs(nx - value) < 5) AS failure_count, max(ts) AS last_seen FROM (SELECT *, lead(value) OVER {_W} AS nx FROM events) WHERE nx IS NOT NULL GROUP BY 1")
def verify_predictions(spark, d):
    return frames.verified(_frames(spark, d), "user_id", "event_type", "value")


@query(f"SELECT user_id, arg_min(event_id, n) AS id, min(n) AS attempt FROM (SELECT *, row_number() OVER {_W} AS n FROM events) WHERE n <= 5 AND event_type = 'click' GROUP BY 1")
def first_success(spark, d):
    f = frames.first_success(_frames(spark, d), "user_id", F.col("event_type") == "click", 5)
    return f.select("user_id", "id", F.col("attempt").cast("long").alias("attempt"))


@query("SELECT event_id AS id FROM events e JOIN (SELECT user_id, min(ts) AS s FROM events GROUP BY 1) USING (user_id) WHERE ts < s + INTERVAL 2 DAY")
def within_budget(spark, d):
    return frames.within_budget(_frames(spark, d), "user_id", "2 DAYS").select("id")


@query()
def event_sessions(spark, d):
    """Sessions of a user's events with gaps under 30 minutes (session_window)."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("t", "30 minutes").alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), F.col("s.end").cast("timestamp_ntz").alias("stop"), "n", F.round("total", 6).alias("total"))


ORACLES["event_sessions"] = """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, k"""


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def repeated_days(spark, d):
    w = Window.partitionBy("user_id", F.to_date("ts"))
    return table(spark, d, "events").withColumn("n", F.count("*").over(w)).where("n > 1").select("user_id", F.to_date("ts").alias("day"), "n").distinct()
