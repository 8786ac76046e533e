"""Search, ingest, graph and frame operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from screenloom.operators import frames, graph, hierarchy, ingest, rules, search

S = "id long, session_id string, fingerprint string, title string, depth int, parent_fp string, ocr_text string, discovered_at string, phash string"


def screens(spark, extra=()):
    rows = [(1, "c", "cal1", "カレンダー", 0, None, "a", "2026-01-01", "x"), (2, "c", "cal2", "イベント詳細", 1, "cal1", "タイトル Lv1", "2026-01-02", "x"), (3, "c", "cal3", "イベント追加", 1, "cal1", "タイトル", "2026-01-03", None), (4, "m", "map1", "マップ", 0, None, None, None, ""), (5, "m", "map2", "経路案内", 1, "map1", "lv1", "2026-01-05", "y")]
    return spark.createDataFrame([*rows, *extra], S)


def sessions(spark):
    return spark.createDataFrame([(1, "c", "カレンダー", "SIMULATOR"), (2, "m", None, None), (3, "c", "other", "MIRROR")], "id long, session_id string, game_title string, device_mode string")


def test_coverage_and_defaults(spark):
    s = search.with_sessions(screens(spark), search.first_sessions(sessions(spark)))
    got = {r.game_title: (r.unique_screens, r.max_depth, r.sessions) for r in search.coverage(s, "game_title").collect()}
    assert got == {"カレンダー": (3, 1, 1), "Unknown Game": (2, 1, 1)}
    assert tuple(search.coverage(s.limit(0)).first()) == (0, 0, 0)


def test_search(spark):
    ids = lambda **k: [r.id for r in search.search(screens(spark), search.first_sessions(sessions(spark)), **k).collect()]
    assert ids(keyword="タイトル") == [3, 2] and ids(keyword="LV1") == [5, 2] and ids(game="カレンダー", title="イベント") == [3, 2] and ids(session_id="m") == [5, 4] and ids(limit=1) == [5] and ids(keyword="none") == []
    with pytest.raises(ValueError):
        search.clamp(-1, 5)
    assert [r.id for r in search.ranked(screens(spark), "lv").collect()] == [5, 2]
    assert search.ranked(screens(spark), "  ").count() == 0 and search.ranked(screens(spark).limit(0), "x").count() == 0


def test_project_screens_and_parents(spark):
    df = screens(spark, [(6, "d", "cal1", "older", 0, None, "", "2025-01-01", None), (7, "d", "cal1", "deep", 5, None, "", None, None)])
    r = next(r for r in search.project_screens(df).collect() if r.fingerprint == "cal1")
    assert (r.first_id, r.min_depth, r.first_seen, r.title) == (1, 0, "2025-01-01", "older")
    assert {r.id: r.parent_id for r in search.parents_of(df).collect()} == {1: None, 2: 1, 3: 1, 4: None, 5: 4, 6: None, 7: None}


def test_upsert(spark):
    e = spark.createDataFrame([(1, "k", "", 5), (2, "k", "n1", 6), (3, "k", "n2", 7), (4, None, "z", 1)], "id long, key string, name string, ts int")
    one = ingest.fold_visits(e, ["key"], "name", "ts", "id")
    assert {r.key: (r.visited_count, r.name) for r in one.collect()} == {"k": (3, "n1"), None: (1, "z")}
    a, b = (ingest.fold_visits(e.where(c), ["key"], "name", "ts", "id") for c in ("ts < 6", "ts >= 6 and key is not null"))
    got = {r.key: r for r in ingest.upsert_visits(a.where("key is not null"), b, ["key"]).collect()}
    assert tuple(got["k"]) == ("k", 3, 5, 7, "n1")
    assert ingest.upsert_visits(a.limit(0), b, ["key"]).count() == 1


def test_inserts_are_idempotent(spark):
    t = "k string, pos int, v string"
    batch = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 1, "b")], t)
    new = ingest.insert_ignore(spark.createDataFrame([("b", 0, "old")], t), batch, ["k"], "pos")
    assert [tuple(r) for r in new.collect()] == [("a", 1, "first")]
    assert ingest.insert_ignore(batch, batch, ["k"], "pos").count() == 0
    ids = ingest.with_ids(spark.createDataFrame([(f"x{i:03}",) for i in range(200)], "name string"), spark.createDataFrame([(7,)], "id long"), "id", "name")
    assert {r.name: r.id for r in ids.collect()} == {f"x{i:03}": 8 + i for i in range(200)}


def test_state_changes(spark):
    s = spark.createDataFrame([("a", "x", 3), ("b", "y", None)], "k string, v string, hit_count int")
    assert {r.k: r.hit_count for r in ingest.add_hits(s, spark.createDataFrame([("a",), ("a",), ("z",)], "k string"), "k").collect()} == {"a": 5, "b": 0}
    new = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("c", "c", 1)], "k string, v string, ts int")
    assert {r.k: (r.v, r.hit_count) for r in ingest.replace_keeping(s, new, "k", "ts", "hit_count").collect()} == {"a": ("new", 3), "b": ("y", 0), "c": ("c", 0)}
    kids = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, fk string")
    gone = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted(r.id for r in ingest.without(kids, "fk", gone).collect()) == [2, 3]
    assert {r.id: r.fk for r in ingest.nulled(kids, "fk", gone).collect()} == {1: None, 2: "b", 3: None}
    m = ingest.migrate(spark.createDataFrame([("old", None)], "session_id string, game_title string"), {"game_title": ("string", "G"), "device_mode": ("string", "SIMULATOR"), "project_id": ("long", None)}).first()
    assert (m.game_title, m.device_mode, m.project_id) == ("G", "SIMULATOR", None)
    p = ingest.by_priority([spark.createDataFrame([("h", "root")], "hash string, s string"), spark.createDataFrame([("h", "human"), ("i", "human")], "hash string, s string")], "hash")
    assert sorted(map(tuple, p.collect())) == [("h", "root"), ("i", "human")]


def overlap(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    u = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / u if u else 0


def test_nms(spark):
    g = random.Random(1)
    rows = [("i", 1, 0.9, 0, 0, 16, 16), ("i", 2, 0.8, 2, 2, 16, 16), ("i", 3, 0.7, 40, 0, 16, 16)] + [("j", 10 + k, round(g.random(), 1), g.randrange(30), g.randrange(30), g.randrange(0, 20), g.randrange(0, 20)) for k in range(40)]
    got = {(r.k, r.id) for r in ingest.nms(spark.createDataFrame(rows, "k string, id int, score double, x int, y int, w int, h int"), ["k"]).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if all(q[0] != r[0] or overlap(q[3:], r[3:]) < 0.4 for q in kept):
            kept.append(r)
    assert got == {(r[0], r[1]) for r in kept} and ("i", 2) not in got


def test_graph(spark):
    rows = [(1, "s", "a", "Home", None, 3), (2, "s", "b", "Info", "a", 2), (3, "s", "c", "unknown", "a", 0), (4, "s", "x", "X", "y", 1), (5, "s", "y", ">", "x", 1), (6, "s", "d", "D", "gone", 1), (7, "s", "b", "Info2", "a", 2), (8, "s", "e", "E", "", 1)]
    df = spark.createDataFrame(rows, "id long, session_id string, fp string, title string, parent_fp string, n_items int").withColumn("depth", F.when(F.col("parent_fp").isNull(), 0).otherwise(1))
    n = graph.nodes(df, "session_id", "fp", "id", "title", "parent_fp", "depth", "n_items")
    assert {r.fp: r.title for r in n.collect()}["b"] == "Info2"
    e = graph.edges(n, "session_id", "fp", "parent_fp")
    inner = graph.inner_edges(e, n, "session_id", "fp")
    assert {(r.src, r.dst) for r in inner.collect()} == {("a", "b"), ("a", "c"), ("x", "y"), ("y", "x")}
    assert {r.fp for r in graph.roots(n, inner, "session_id", "fp").collect()} == {"a", "d", "e"}
    assert graph.first_root(n, "session_id", "fp", "parent_fp", "id").first().root == "a"
    gaps = {r.fp: r.g for r in n.select("fp", graph.gaps(F.col("title"), F.col("n_items")).alias("g")).collect()}
    assert gaps["c"] == ["unknown_screen", "untapped_screen"] and gaps["y"] == ["suspicious_title"] and gaps["a"] == []
    start = spark.createDataFrame([("s", "a"), ("s", "x")], "session_id string, node string")
    assert {r.node: r.level for r in graph.reach(inner, start, "session_id", 5).collect()} == {"a": 0, "x": 0, "b": 1, "c": 1, "y": 1}
    placed = hierarchy.hierarchy(hierarchy.nodes(df.withColumn("_o", -F.col("id")), "session_id", "fp", "parent_fp", "depth", "_o"))
    shown = n.select(F.col("session_id").alias("scope"), F.col("fp").alias("node"), F.col("id").alias("pos"), "title", "n_items")
    lines = [r.line for r in graph.tree_lines(placed, shown).orderBy("line_no").collect()]
    assert lines[:3] == ["Home [depth=0] (3 items)", "  ❓ unknown [depth=1] (0 items)  ← unknown", "  Info2 [depth=1] (2 items)"] and len(lines) == 5
    mermaid = [r.line for r in graph.mermaid_lines(n, inner, "session_id", "fp", "id").orderBy("line_no").collect()]
    assert mermaid[0] == "graph TD" and mermaid[1] == '    n0["Home (d=0) | 3 items"]' and "    n0 --> n1" in mermaid and mermaid[-1] == "    style n1 fill:#ffcccc"
    assert {r.node: r.chain for r in graph.title_chain(placed, shown).collect()}["b"] == ["Home", "Info2"]
    taps = spark.createDataFrame([("s", "a", "go", "b", 2), ("s", "a", "go2", "b", 1)], "scope string, parent string, text string, child string, seq int")
    items = spark.createDataFrame([("s", "a", "go2")], "scope string, node string, text string")
    assert {r.node: r.recipe for r in graph.recipes(placed, taps, items).collect()} == {"b": ["go2"], "c": None}
    assert graph.tree_lines(placed.limit(0), shown).count() == 0


FRAMES = "key string, id long, ts int, value double, action string"


def test_frames(spark):
    rows = [("k", i, i, v, a) for i, (v, a) in enumerate([(10.0, "x"), (12.0, "dead"), (12.0, "dead"), (17.0, "dead"), (18.0, "reset"), (18.0, "dead"), (18.0, "dead")])]
    df = spark.createDataFrame(rows, FRAMES)
    w = frames.order("key")
    got = frames.islands(df.withColumn("d", frames.distance_to_last(F.col("value"), w)), F.col("d") >= 5, w).orderBy("id").collect()
    assert [r.d for r in got] == [999, 2, 0, 5, 1, 0, 0] and [r.unchanged for r in got] == [0, 1, 2, 0, 1, 2, 3] and [r.since for r in got] == [0, 0, 0, 3, 3, 3, 3] and [r.island for r in got] == [1, 1, 1, 2, 2, 2, 2]
    c = frames.running_count(df, F.col("action") == "dead", F.col("action") == "reset", w).orderBy("id").collect()
    assert [r["count"] for r in c] == [0, 1, 2, 3, 0, 1, 2]
    levels = spark.range(1, 7).select(frames.stuck_level(F.col("id")).alias("l")).collect()
    assert [r.l for r in levels] == ["none", "swipe", "swipe", "swipe+long_press", "swipe+long_press", "hopeless"]
    assert [r[0] for r in spark.createDataFrame([(700, "LOADING"), (700, "x"), (700, None), (1, "x")], "s int, a string").select(frames.watchdog(F.col("s"), F.col("a"), ["LOADING"])).collect()] == [False, True, True, False]
    v = frames.verified(df, "key", "action", "value").collect()
    assert {r.action: (r.success_count, r.failure_count) for r in v} == {"x": (0, 1), "dead": (1, 3), "reset": (0, 1)}
    assert [(r.action, r["rank"]) for r in frames.most_recent(df, "key", ["action"], 2).orderBy("rank").collect()] == [("dead", 1), ("reset", 2)]
    assert frames.first_success(df, "key", F.col("action") == "dead", 3).first().attempt == 2
    assert [r.id for r in frames.every_nth(df, w, 3).collect()] == [2, 5]
    assert frames.islands(df.limit(0).withColumn("d", F.lit(1)), F.col("d") >= 5, w).count() == 0


def test_near_runs(spark):
    df = spark.createDataFrame([("k", i, i, x, 0) for i, x in enumerate([0, 40, 80, 200, 210, None, 210])], "key string, id int, ts int, x int, y int")
    assert [r.run for r in frames.near_runs(df, "x", "y", frames.order("key")).orderBy("id").collect()] == [1, 2, 3, 1, 2, 1, 1]


def test_rules_in_any_number_and_ties(spark):
    df = spark.createDataFrame([(1, "a7 b"), (2, None), (3, ""), (4, "c")], "id long, text string")
    listed = spark.createDataFrame([(i, [f"a{i} ", f"z{i}"]) for i in range(12)] + [(99, ["c"])], "rule_id int, keywords array<string>")
    assert {(r.id, r.rule_id) for r in rules.triggered(df, "text", listed, chunk=5).collect()} == {(1, 7), (4, 99)}
    assert rules.triggered(df, "text", listed.limit(0)).count() == 0
    scores = spark.createDataFrame([(1, 1, 0.9, 0.8, True), (1, 2, 0.9, 0.8, True), (1, 3, 0.99, 1.0, True), (2, 1, 0.9, 0.8, False), (3, 1, None, 0.1, True)], "image int, template_id int, score double, threshold double, open boolean")
    assert [tuple(r) for r in rules.best_template(scores, ["image"]).collect()] == [(1, 1, 0.9)]
    items = spark.createDataFrame([(1, 5, "Rank A", 0.8), (2, 5, "Rank B", 0.8), (3, 5, "Rank", None), (4, 6, None, 0.9), (5, 6, "", 0.9)], "id long, screen_id long, text string, confidence double")
    assert {tuple(r) for r in rules.surest(items, "screen_id", ["no", "Rank"], 0.7).collect()} == {(5, "Rank A"), (6, None)}


def test_dark_frames_break_islands_and_recoveries_end(spark):
    rows = [(1, 1, 50.0), (2, 2, 50.0), (3, 3, 1.0), (4, 4, 50.0), (5, 5, 50.0), (6, 6, None)]
    f = spark.createDataFrame([("k", ts, i, v) for i, ts, v in rows], "key string, ts int, id int, value double")
    got = frames.lit_islands(f, F.col("value"), 10, lambda w: frames.distance_to_last(F.col("value"), w) >= 5, frames.order("key"), "key")
    assert {r.id: r.unchanged for r in got.collect()} == {1: 0, 2: 1, 4: 0, 5: 1, 6: 0}
    b = spark.createDataFrame([("k", i, i, i % 2 == 0) for i in range(1, 12)] + [("n", 1, 1, None)], "key string, ts int, id int, bites boolean")
    got = frames.recoveries(b, F.col("bites"), frames.order("key"))
    assert {r.id: r.recovery for r in got.where("recovery is not null").collect()} == {2: 1, 4: 2, 6: 3}


def test_lookups_refuse_and_lists_end(spark):
    rows = spark.createDataFrame([(1, "Map_1", None), (2, None, "a MAP"), (3, "x", "")], "id long, name string, ocr_text string")
    assert [r.id for r in search.filtered(rows, "map", "0").collect()] == [1, 2] and search.filtered(rows, "", None).count() == 3
    assert [r.id for r in search.filtered(rows, "map", "_").collect()] == [1]
    assert search.by_id(rows, 2).count() == 1 and search.by_id(rows, 77).count() == 0
    with pytest.raises(ValueError):
        search.by_id(rows, 0)
