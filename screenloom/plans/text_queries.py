"""Text, box and rule functions over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import phash
from ..functions import text as tx
from ..operators import ingest, rules
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


def boxes(spark, d):
    """(screen_id, boxes): lines of an order as recognised texts of a screen; some are chevrons, action words or never titles."""
    x, y = (F.col("l_partkey") % 900).cast("int"), (F.col("l_suppkey") * 17 % 1800).cast("int")
    w, h = (20 + F.col("l_quantity") * 3).cast("int"), (10 + F.col("l_quantity") * 2).cast("int")
    points = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    kind = F.col("l_partkey") % 11
    text = F.when(kind == 0, ">").when(kind == 1, "OK").when(kind == 2, "戻る").otherwise(F.concat("l_returnflag", F.lit(" "), "l_linestatus", (F.col("l_partkey") % 5).cast("string")))
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), text.alias("text"), F.round(1 - F.col("l_discount") * 3, 2).alias("confidence"), points.alias("box"), geo.center(points).alias("center"))
    arr = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("screen_id")).agg(F.sort_array(F.collect_list(item)).alias("b"))
    return arr.select("screen_id", F.transform("b", lambda r: F.struct(r["text"].alias("text"), r["confidence"].alias("confidence"), r["box"].alias("box"), r["center"].alias("center"))).alias("boxes"))


_B = """WITH t AS (SELECT *, CASE l_partkey % 11 WHEN 0 THEN '>' WHEN 1 THEN 'OK' WHEN 2 THEN '戻る' ELSE l_returnflag || ' ' || l_linestatus || (l_partkey % 5) END AS text FROM lineitem),
l AS (SELECT l_orderkey AS screen_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, text, round(1 - l_discount * 3, 2), l_suppkey * 17 % 1800, l_quantity) AS n, text, round(1 - l_discount * 3, 2) AS conf,
 CAST(l_partkey % 900 AS INT) AS x, CAST(l_suppkey * 17 % 1800 AS INT) AS y, CAST(trunc(20 + l_quantity * 3) AS INT) AS w, CAST(trunc(10 + l_quantity * 2) AS INT) AS h FROM t),
b AS (SELECT *, CAST(trunc((4 * x + 2 * w) / 4) AS INT) AS cx, CAST(trunc((4 * y + 2 * h) / 4) AS INT) AS cy, CAST(trunc(max(y + h) OVER (PARTITION BY screen_id) * 1.05::DOUBLE) AS INT) AS sh, CAST(trunc(max(x + w) OVER (PARTITION BY screen_id) * 1.05::DOUBLE) AS INT) AS sw FROM l) """


@query(_B + "SELECT screen_id, left(md5(coalesce(string_agg(s, '|' ORDER BY s) FILTER (conf >= 0.75 AND cy >= sh * 0.05::DOUBLE AND length(s) > 1), '')), 16) AS fp FROM (SELECT *, trim(regexp_replace(text, '\\d+', '', 'g')) AS s FROM b) GROUP BY 1")
def fingerprint_v2(spark, d):
    return boxes(spark, d).select("screen_id", tx.fingerprint_v2(F.col("boxes")).alias("fp"))


@query(_B + "SELECT screen_id, left(md5(coalesce(string_agg(text, '|' ORDER BY text) FILTER (conf >= 0.75 AND cy >= 100 AND length(text) > 1), '')), 16) AS fp FROM b GROUP BY 1")
def fingerprint_v1(spark, d):
    return boxes(spark, d).select("screen_id", tx.fingerprint_v1(F.col("boxes")).alias("fp"))


@query("SELECT doc_id, left(md5(array_to_string(list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\\p{Nd}+', '', 'g'), '^[\\s\\x{00A0}\\x{3000}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{1680}\\x{85}]+|[\\s\\x{00A0}\\x{3000}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{1680}\\x{85}]+$', '', 'g')), lambda x: length(x) > 1)), '|')), 16) AS fp FROM documents WHERE text IS NOT NULL")
def fingerprint_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.fingerprint_of_lines(F.split("text", "\n")).alias("fp"))


@query(_B + """, base AS (SELECT * FROM b WHERE conf > 0.8 AND length(text) BETWEEN 2 AND 20 AND text <> '戻る' AND cy > sh * 0.05::DOUBLE),
lg AS (SELECT screen_id, arg_max(text, row(h, -n)) AS t FROM base WHERE cy < sh * 0.30::DOUBLE AND h >= sh * 0.03::DOUBLE GROUP BY 1),
nv AS (SELECT screen_id, arg_max(text, row(conf, -n)) AS t FROM base WHERE cy < sh * 0.20::DOUBLE AND cx >= sw * 0.20::DOUBLE AND cx <= sw * 0.80::DOUBLE GROUP BY 1)
SELECT s.screen_id, coalesce(lg.t, nv.t, 'unknown') AS title FROM (SELECT DISTINCT screen_id FROM b) s LEFT JOIN lg USING (screen_id) LEFT JOIN nv USING (screen_id)""")
def title_extract(spark, d):
    return boxes(spark, d).select("screen_id", tx.screen_title(F.col("boxes")).alias("title"))


@query(_B + """, v AS (SELECT screen_id, list(cy) AS ys FROM b WHERE text = '>' AND cx > sw * 0.85::DOUBLE GROUP BY 1),
p AS (SELECT screen_id, n, text, CASE WHEN conf < 0.8 OR cy < sh * 0.05::DOUBLE OR cx > sw * 0.85::DOUBLE OR text IN ('>', '戻る') THEN NULL WHEN text = 'OK' THEN 'action' WHEN cy > sh * 0.80::DOUBLE THEN 'footer'
 WHEN len(list_filter(coalesce(ys, []), lambda c: abs(cy - c) <= sh * 0.04::DOUBLE)) > 0 THEN CASE WHEN h < sh * 0.03::DOUBLE THEN 'row' END
 WHEN len(coalesce(ys, [])) < 5 AND cy >= sh * 0.15::DOUBLE AND cy <= sh * 0.80::DOUBLE AND cx < sw * 0.80::DOUBLE AND length(text) BETWEEN 2 AND 20 AND h < sh * 0.03::DOUBLE AND NOT (cx > sw * 0.40::DOUBLE AND length(text) > 12) THEN 'content' END AS path FROM b LEFT JOIN v USING (screen_id))
SELECT screen_id, text, arg_min(path, n) AS path FROM p WHERE path IS NOT NULL GROUP BY ALL""")
def tappable_paths(spark, d):
    return boxes(spark, d).select("screen_id", F.explode(tx.tappable_items(F.col("boxes"), 0.8)).alias("i")).select("screen_id", "i.text", "i.path")


@query(_B + "SELECT screen_id, cx, cy, x, y, w, h, CAST(trunc(cx / 2.5::DOUBLE) AS INT) AS px FROM b")
def bbox_center(spark, d):
    b = boxes(spark, d).select("screen_id", F.explode("boxes").alias("r")).select("screen_id", F.col("r.center").alias("c"), geo.bounds(F.col("r.box")).alias("b"))
    return b.select("screen_id", F.col("c")[0].alias("cx"), F.col("c")[1].alias("cy"), "b.x", "b.y", "b.w", "b.h", geo.scaled(F.col("c")[0], F.lit(2.5)).alias("px"))


@query("SELECT id, coalesce(nullif(trim(left(regexp_replace(title, '[\\\\/:*?\"<>|\\s\\x{00A0}\\x{3000}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{1680}\\x{85}]', '_', 'g'), 30), '_'), ''), 'unknown') AS slug, coalesce(nullif(left(regexp_replace(title, '[^\\p{L}\\p{N}_-]', '', 'g'), 10), ''), 'item') AS safe FROM lc_screens")
def slug_names(spark, d):
    return table(spark, d, "lc_screens").select("id", tx.slug(F.col("title")).alias("slug"), tx.safe_name(F.col("title")).alias("safe"))


@query("SELECT o_orderkey, CAST(floor(epoch(o_orderdate) % 86400 / 60 + o_totalprice / 60 + 0.5) AS BIGINT) AS minutes, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS dir FROM orders")
def duration_minutes(spark, d):
    o = table(spark, d, "orders")
    sec = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) % 86400
    return o.select("o_orderkey", tx.duration_minutes(sec + F.col("o_totalprice")).alias("minutes"), tx.session_dir(F.col("o_orderdate")).alias("dir"))


@query("SELECT doc_id, left(sha256(text), 32) AS hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", phash.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped, CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS short, trim(regexp_replace(text, '<[^>]*>', '', 'g')) AS clean FROM documents")
def display_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.html_escape(t).alias("escaped"), tx.shortened(t, 100).alias("short"), tx.sanitised(t).alias("clean"))


@query("""SELECT event_id, CASE WHEN k % 5 = 0 THEN 'skip' WHEN k % 5 = 1 THEN 'tap' WHEN k % 5 = 2 THEN 'swipe' WHEN k % 5 = 3 THEN 'wait' ELSE 'none' END AS kind, CASE WHEN k % 5 = 1 THEN k ELSE -1 END AS x, CASE WHEN k % 5 = 2 THEN user_id ELSE -1 END AS y2, CASE WHEN k % 5 = 2 THEN 300.0 WHEN k % 5 = 3 THEN k + 0.5 ELSE -1 END AS duration
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""")
def action_parser(spark, d):
    k = F.get_json_object("props", "$.k")
    n = k.cast("int")
    command = F.when(n % 5 == 0, "Skip").when(n % 5 == 1, F.concat(F.lit(" tap "), k, F.lit(","), "user_id", F.lit(", 50"))).when(n % 5 == 2, F.concat(k, F.lit(" 2,3,"), "user_id")).when(n % 5 == 3, F.concat(F.lit("WAIT "), k, F.lit(".5"))).otherwise(F.concat(F.lit("jump "), k))
    a = table(spark, d, "events").select("event_id", tx.action(command).alias("a"))
    one = F.get("a", F.lit(0))
    kind = F.when(F.col("a").isNull(), "none").when(F.size("a") == 0, "skip").otherwise(one["type"])
    return a.select("event_id", kind.alias("kind"), F.coalesce(one["x"], F.lit(-1)).alias("x"), F.coalesce(one["y2"], F.lit(-1)).alias("y2"), F.coalesce(one["duration"], F.lit(-1.0)).alias("duration"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '不明' ELSE event_type END AS screen_type, CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 3 = 1 THEN 1 ELSE 2 END AS n_buttons, CASE WHEN user_id % 3 = 2 THEN CAST(json_extract(props, '$.k') AS INT) WHEN user_id % 3 = 1 THEN 2 ELSE -1 END AS priority, user_id % 3 = 0 AS failed FROM events""")
def llm_json_parse(spark, d):
    k = F.get_json_object("props", "$.k")
    body = F.when(F.col("user_id") % 3 == 0, "not json").when(F.col("user_id") % 3 == 1, F.concat(F.lit('```json\n{"screen_type": "'), "event_type", F.lit('", "buttons": [{"name": "a"}, {"name": ""}, {"priority": 1}]}\n```'))).otherwise(F.concat(F.lit('{"screen_type": "'), "event_type", F.lit('", "confidence": 0.5, "buttons": [{"name": "b", "priority": '), k, F.lit('}, {"name": "c"}]}')))
    a = table(spark, d, "events").select("event_id", tx.analysis(body).alias("a"))
    return a.select("event_id", "a.screen_type", F.size("a.buttons").alias("n_buttons"), F.coalesce(F.get("a.buttons", F.lit(0))["priority"], F.lit(-1)).alias("priority"), "a.failed")


def _case(c: str, pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, '{k}') THEN '{v}'" for k, v in pairs) + f" ELSE '{default}' END"


_LONGEST = sorted(rules.PREDICTIONS.items(), key=lambda kv: -len(kv[0]))


@query(f"SELECT id, {_case('text', _LONGEST, 'UNKNOWN')} AS outcome, {_case('text', list(rules.CATEGORIES.items()), 'unknown')} AS category, {_case('text', list(rules.ROLES.items()), 'btn')} || '_' || {_case('text', list(rules.ELEMENTS.items()), 'unknown')} AS name FROM lc_tappable_items WHERE text IS NOT NULL")
def predict_outcome(spark, d):
    t = F.col("text")
    return table(spark, d, "lc_tappable_items").where("text is not null").select("id", rules.predicted(t).alias("outcome"), rules.category(t).alias("category"), rules.instruction_name(t).alias("name"))


_SCENE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(ocr_text, '{k}')" for k in ks) + f" THEN '{n}'" for n, ks in rules.SCENES)


@query(f"SELECT id, scene, CASE scene WHEN 'STORY' THEN 2.0 WHEN 'LOADING' THEN 5.0 ELSE 1.0 END AS wait FROM (SELECT id, {_SCENE} WHEN device = 'STORY_TAP' THEN 'STORY' WHEN len(list_filter(string_split(ocr_text, ' '), lambda t: length(t) >= 8 AND regexp_matches(t, '[\\x{{3041}}-\\x{{30FF}}]'))) >= 2 THEN 'STORY' ELSE 'UNKNOWN' END AS scene FROM (SELECT *, CASE WHEN depth % 7 = 0 THEN 'STORY_TAP' END AS device FROM lc_screens WHERE ocr_text IS NOT NULL))")
def scene_class(spark, d):
    s = table(spark, d, "lc_screens").where("ocr_text is not null")
    scene = rules.scene(F.split("ocr_text", " "), F.when(F.col("depth") % 7 == 0, "STORY_TAP"))
    return s.select("id", scene.alias("scene")).withColumn("wait", rules.interval(F.col("scene")))


@query("""SELECT id, CAST(contains(t, 'Confirm') AS INT) + CAST(contains(t, 'Rank') AS INT) + CAST(contains(t, 'ガイド') AS INT) AS present, t = '' OR ((contains(t, 'Rank') OR contains(t, 'Lv')) AND (contains(t, 'Cancel') OR contains(t, 'ード'))) AS passes FROM (SELECT id, coalesce(ocr_text, '') AS t FROM lc_screens)""")
def keyword_gates(spark, d):
    texts = F.filter(F.split(F.coalesce("ocr_text", F.lit("")), " "), lambda t: t != "")
    return table(spark, d, "lc_screens").select("id", rules.keywords_present(texts, ["Confirm", "Rank", "ガイド"]).alias("present"), rules.gate(texts, ["Rank", "Lv"], [["Cancel", "ード"]]).alias("passes"))


@query("""WITH m AS (SELECT screen_id, arg_max(text, row(confidence, -id)) FILTER (contains(text, 'Rank') AND confidence >= 0.7) AS a, arg_max(text, row(confidence, -id)) FILTER (contains(text, 'ード') AND confidence >= 0.7) AS b FROM lc_tappable_items WHERE text IS NOT NULL AND confidence IS NOT NULL GROUP BY 1) SELECT screen_id, coalesce(a, b, '-') AS best FROM m""")
def best_match(spark, d):
    items = table(spark, d, "lc_tappable_items").where("text is not null and confidence is not null")
    return rules.surest(items, "screen_id", ["Rank", "ード"], 0.7).withColumn("best", F.coalesce("best", F.lit("-")))


_RULES = [(1, ["設定", "Setting"]), (2, ["Rank", "ランク"]), (3, ["一覧", "確認"])]


@query("SELECT s.id, r.rule_id FROM lc_screens s JOIN (VALUES (1, '設定', 'Setting'), (2, 'Rank', 'ランク'), (3, '一覧', '確認')) r(rule_id, a, b) ON contains(s.title, r.a) OR contains(s.title, r.b)")
def rule_trigger(spark, d):
    listed = spark.createDataFrame(_RULES, "rule_id int, keywords array<string>")
    return rules.triggered(table(spark, d, "lc_screens").select("id", "title"), "title", listed).select("id", "rule_id")


@query("""SELECT id, CASE WHEN contains(t, 'Loading') OR contains(t, 'ダウンロード') THEN 'WAIT' WHEN (CAST(contains(t, 'クエスト') AS INT) + CAST(contains(t, 'ショップ') AS INT) + CAST(contains(t, 'ホーム') AS INT)) >= 2 THEN 'HOME' WHEN contains(t, 'スキップ') OR contains(t, 'Skip') THEN 'SKIP' WHEN contains(t, 'Confirm') OR contains(t, '確認') THEN 'CONFIRM' WHEN depth > 5 THEN 'BACK' ELSE 'WAIT_FOR_CHANGE' END AS action FROM (SELECT id, depth, coalesce(ocr_text, '') AS t FROM lc_screens)""")
def decision_list(spark, d):
    t = F.coalesce("ocr_text", F.lit(""))
    home = sum((F.when(t.contains(k), 1).otherwise(0) for k in ("クエスト", "ショップ", "ホーム")), F.lit(0)) >= 2
    listed = [("WAIT", tx.contains_any(t, ["Loading", "ダウンロード"])), ("HOME", home), ("SKIP", tx.contains_any(t, ["スキップ", "Skip"])), ("CONFIRM", tx.contains_any(t, ["Confirm", "確認"])), ("BACK", F.col("depth") > 5)]
    return table(spark, d, "lc_screens").select("id", rules.decision(listed, "WAIT_FOR_CHANGE").alias("action"))


@query("SELECT model, max(string_split(v, '.')[1]::INT * 10000 + string_split(v, '.')[2]::INT) AS newest FROM (SELECT p_brand AS model, (p_size % 19) || '.' || (p_partkey % 12) AS v FROM part) GROUP BY 1")
def version_sort(spark, d):
    runtime = F.concat(F.lit("com.x.iOS-"), (F.col("p_size") % 19).cast("string"), F.lit("-"), (F.col("p_partkey") % 12).cast("string"))
    v = table(spark, d, "part").select(F.col("p_brand").alias("model"), tx.version_key(tx.os_version(runtime)).alias("v"))
    best = v.groupBy("model").agg(F.max("v").alias("v"))
    return best.select("model", (F.col("v")[0] * 10000 + F.col("v")[1]).alias("newest"))


@query(_B + "SELECT a.screen_id, a.n AS na, b2.n AS nb, round(CASE WHEN a.w * a.h + b2.w * b2.h - i > 0 THEN i / (a.w * a.h + b2.w * b2.h - i) ELSE 0 END, 6) AS iou FROM (SELECT * FROM b) a JOIN b b2 ON a.screen_id = b2.screen_id AND a.n < b2.n, LATERAL (SELECT greatest(0, least(a.x + a.w, b2.x + b2.w) - greatest(a.x, b2.x)) * greatest(0, least(a.y + a.h, b2.y + b2.h) - greatest(a.y, b2.y)) AS i) WHERE i > 0")
def iou_pairs(spark, d):
    """Overlapping boxes of one screen; a screen's boxes are the lines of one order, seven at most."""
    b = _flat(spark, d)
    o = b.select("screen_id", *[F.col(c).alias(f"{c}2") for c in ("n", "x", "y", "w", "h")])
    v = geo.iou(*[F.col(c) for c in ("x", "y", "w", "h", "x2", "y2", "w2", "h2")])
    return b.join(o, "screen_id").where("n < n2").select("screen_id", F.col("n").alias("na"), F.col("n2").alias("nb"), F.round(v, 6).alias("iou")).where("iou > 0")


def _flat(spark, d):
    return boxes(spark, d).select("screen_id", F.posexplode("boxes").alias("n", "r")).select("screen_id", (F.col("n") + 1).cast("long").alias("n"), F.col("r.text").alias("text"), F.col("r.confidence").alias("score"), F.col("r.center").alias("c"), geo.bounds(F.col("r.box")).alias("b")).select("screen_id", "n", "text", "score", "c", "b.*")


@query(_B + """SELECT a.screen_id, a.n, count(o.n) AS n_inside, coalesce(string_agg(o.text, ' ' ORDER BY o.n), '') AS texts FROM b a LEFT JOIN b o ON o.screen_id = a.screen_id AND o.cx BETWEEN a.x AND a.x + a.w AND o.cy BETWEEN a.y AND a.y + a.h GROUP BY ALL""")
def containment_texts(spark, d):
    b = _flat(spark, d)
    o = b.select("screen_id", F.col("n").alias("n2"), F.col("text").alias("text2"), F.col("c").alias("c2"))
    hit = geo.inside(F.col("c2")[0], F.col("c2")[1], F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    found = b.join(o, "screen_id").where(hit).groupBy("screen_id", "n").agg(F.sort_array(F.collect_list(F.struct("n2", "text2"))).alias("t"))
    return b.select("screen_id", "n").join(found, ["screen_id", "n"], "left").select("screen_id", "n", F.when(F.col("t").isNull(), 0).otherwise(F.size("t")).cast("long").alias("n_inside"), F.coalesce(F.array_join(F.transform("t", lambda x: x["text2"]), " "), F.lit("")).alias("texts"))


@query(_B.replace("WITH t", "WITH RECURSIVE t", 1) + """, o AS (SELECT screen_id // 64 AS image, text, screen_id * 100 + n AS id, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, row_number() OVER (PARTITION BY screen_id // 64, text ORDER BY conf DESC, screen_id * 100 + n) AS k FROM b),
r AS (SELECT image, text, k, [{'x': x, 'y': y, 'w': w, 'h': h, 'id': id}] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.image, o.text, o.k, CASE WHEN len(list_filter(kept, lambda e: greatest(0, least(e.x + e.w, o.x + o.w) - greatest(e.x, o.x)) * greatest(0, least(e.y + e.h, o.y + o.h) - greatest(e.y, o.y)) >= 0.4 * (e.w * e.h + o.w * o.h - greatest(0, least(e.x + e.w, o.x + o.w) - greatest(e.x, o.x)) * greatest(0, least(e.y + e.h, o.y + o.h) - greatest(e.y, o.y))))) = 0 THEN list_append(kept, {'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h, 'id': o.id}) ELSE kept END FROM r JOIN o ON o.image = r.image AND o.text = r.text AND o.k = r.k + 1)
SELECT image, text, unnest(list_transform(kept, lambda e: e.id)) AS id FROM (SELECT image, text, arg_max(kept, k) AS kept FROM r GROUP BY ALL)""")
def nms_greedy(spark, d):
    """Images are a few screens each, so their number grows with the tables and not their boxes."""
    b = _flat(spark, d).withColumn("image", F.floor(F.col("screen_id") / 64))
    return ingest.nms(b.withColumn("id", F.col("screen_id") * 100 + F.col("n")), ["image", "text"])


@query(_B + "SELECT screen_id, n, CASE WHEN cx > 1050 THEN 'right' WHEN cx < 600 THEN 'left' ELSE 'center' END AS side, CASE WHEN abs(cx - 130) <= abs(cx - 310) AND abs(cx - 130) <= abs(cx - 490) THEN 130 WHEN abs(cx - 310) <= abs(cx - 490) THEN 310 ELSE 490 END AS card, w * h >= 1000 AND w * h <= sw * sh * 0.25 AND w >= 40 AND h >= 20 AND w / h BETWEEN 0.5 AND 12 AS button, abs(cy - 500) <= 60 OR abs(cy - 1200) <= 60 AS in_band FROM b")
def box_places(spark, d):
    b = boxes(spark, d)
    xs = lambda k: F.array_max(F.flatten(F.transform("boxes", lambda r: F.transform(r["box"], lambda p: p[k]))))
    sizes = b.select("screen_id", (xs(0) * F.lit(1.05)).cast("int").alias("sw"), (xs(1) * F.lit(1.05)).cast("int").alias("sh"))
    return _flat(spark, d).join(sizes, "screen_id").select("screen_id", "n", geo.side(F.col("c")[0]).alias("side"), geo.nearest(F.col("c")[0], [130, 310, 490]).alias("card"), geo.button_like(F.col("w"), F.col("h"), F.col("sw"), F.col("sh")).alias("button"), geo.in_band(F.col("c")[1], F.array(F.lit(500), F.lit(1200)), F.lit(60)).alias("in_band"))
