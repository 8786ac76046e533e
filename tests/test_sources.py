import json

import pytest
from pyspark.errors import PySparkException

from screenloom.sources import importer, readers, schemas, writers


def write(path, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(doc, ensure_ascii=False))


def summary(sid, game="Game", fps=("fp001", "fp002", "fp001")):
    return {"session_id": sid, "game_title": game, "extra": 1, "screens": [{"fingerprint": f, "title": "ホーム", "depth": i, "parent_fp": None, "tappable_items": [{"text": "設定", "confidence": 0.95}, {"text": "戻す"}], "phash": "abcd1234abcd1234", "discovered_at": f"2026-03-04T12:00:0{i}"} for i, f in enumerate(fps)]}


def test_import_twice(spark, tmp_path):
    write(tmp_path / "a/crawl_summary.json", summary("s1"))
    write(tmp_path / "b/crawl_summary.json", {"session_id": "s2"})
    (tmp_path / "c").mkdir()
    (tmp_path / "c/crawl_summary.json").write_text("{broken")
    docs = readers.summaries(spark, str(tmp_path))
    assert sorted(r.session_id for r in docs.collect()) == ["s1", "s2"]
    sessions, projects, stored = (spark.createDataFrame([], s) for s in (schemas.SESSIONS, "id long, game_title string", schemas.SCREENS))
    new = {r.session_id: r for r in importer.new_sessions(docs, sessions).collect()}
    assert (new["s1"].id, new["s1"].screens_found, new["s1"].started_at, new["s1"].device_mode) == (1, 3, "2026-03-04T12:00:00", "SIMULATOR")
    assert (new["s2"].screens_found, new["s2"].game_title) == (0, "Unknown Game")
    assert {r.game_title for r in importer.new_projects(docs, projects).collect()} == {"Game", "Unknown Game"}
    screens = readers.screens_of(docs)
    first = importer.new_screens(screens, stored)
    rows = first.orderBy("id").collect()
    assert [(r.id, r.fingerprint, r.ocr_text, r.depth) for r in rows] == [(1, "fp001", "設定 戻す", 0), (2, "fp002", "設定 戻す", 1)]
    assert [(r.screen_id, r.text, r.confidence) for r in importer.items_of(first).orderBy("screen_id", "pos").collect()] == [(1, "設定", 0.95), (1, "戻す", 0.0), (2, "設定", 0.95), (2, "戻す", 0.0)]
    assert importer.new_screens(screens, first.select("id", "session_id", "fingerprint")).count() == 0
    assert readers.latest(docs).first().session_id == "s2" and readers.latest(docs, "Game").first().session_id == "s1"


def test_trees_and_knowledge(spark, tmp_path):
    write(tmp_path / "t/discovery_tree.json", {"session_id": "s", "game_title": "g", "nodes": {"f1": {"title": "A", "depth": 0}, "f2": {"title": "B", "depth": 1}}, "edges": [{"from_fp": "f1", "to_fp": "f2", "via": "auto", "label": "x"}, {"from_fp": "f1", "to_fp": "f2", "via": "cache", "actions": [{"type": "back"}]}]})
    t = readers.trees(spark, str(tmp_path / "*/discovery_tree.json"))
    assert {(r.fingerprint, r.title) for r in readers.tree_nodes(t).collect()} == {("f1", "A"), ("f2", "B")}
    assert [(r.pos, r.via) for r in readers.tree_edges(t).orderBy("pos").collect()] == [(0, "auto"), (1, "cache")]
    write(tmp_path / "k/aa.json", {"title": "root"})
    write(tmp_path / "k/human_solved/aa.json", {"title": "human"})
    write(tmp_path / "k/human_solved/bb.json", {"title": "human"})
    assert {r.hash: r.title for r in readers.knowledge(spark, str(tmp_path / "k")).collect()} == {"aa": "root", "bb": "human"}
    assert readers.knowledge(spark, str(tmp_path / "none")).count() == 0


def test_fallback_tail_profiles(spark, tmp_path):
    bad = lambda: spark.table("no_such_table")
    assert readers.first_available(bad, lambda: readers.sample_screens(spark)).count() == 3
    with pytest.raises(PySparkException):
        readers.first_available(bad)
    (tmp_path / "log.txt").write_text("\n".join(f"l{i}" for i in range(10)))
    tail, total = readers.log_tail(spark, str(tmp_path / "log.txt"), 3)
    assert total == 10 and [r.line for r in tail.orderBy("line_no").collect()] == ["l7", "l8", "l9"]
    p = readers.with_profile(spark.createDataFrame([("g",), ("h",), (None,)], "game_title string"), spark.createDataFrame([("g", "pkg")], "title string, package string"))
    assert {r.game_title: r.profile_package for r in p.collect()} == {"g": "pkg", "h": None, None: None}
    d = readers.database_screens(spark.createDataFrame([(1, "h", "", "t", "p")], "id long, screen_hash string, name string, ocr_text string, screenshot_path string")).first()
    assert (d.title, d.depth, d.parent_fp) == ("unknown", 0, None)


def test_round_trip_through_summary(spark, tmp_path):
    screens = spark.createDataFrame([(1, "s", "f1", "A", 0, None, "aa", "p", "x", "t1"), (2, "s", "f2", "B", 1, "f1", None, "p", "y", "t2")], schemas.SCREENS)
    items = spark.createDataFrame([(5, 1, "one", 0.5), (4, 1, "zero", None), (6, 2, "two", 0.9)], schemas.ITEMS)
    sessions = spark.createDataFrame([("s", "g", "MIRROR")], "session_id string, game_title string, device_mode string")
    docs = writers.summary_documents(screens, items, sessions)
    writers.write_documents(docs, str(tmp_path / "out"))
    back = spark.read.schema(schemas.SUMMARY).json(str(tmp_path / "out")).first()
    assert (back.session_id, back.game_title, back.device_mode) == ("s", "g", "MIRROR")
    assert [(s.fingerprint, s.parent_fp, [i.text for i in s.tappable_items]) for s in back.screens] == [("f1", None, ["zero", "one"]), ("f2", "f1", ["two"])]
    assert json.loads(writers.api_answer(screens.select("id", "title"), [screens.id], 1).first().json) == {"screens": [{"id": 1, "title": "A"}], "count": 1}
    chain = spark.createDataFrame([("abcdef123456", ["Home", "a/b"])], "node string, chain array<string>")
    assert writers.tidy_paths(chain).first().dest_path == "Home/a_b/abcdef12_a_b.png"
    tree = writers.tree_documents(spark.createDataFrame([("s", "f", "A", 0, None, None)], "session_id string, fingerprint string, title string, depth int, phash string, discovered_at string"), spark.createDataFrame([], "session_id string, src string, dst string")).first()
    assert json.loads(tree.json) == {"session_id": "s", "nodes": {"f": {"title": "A", "depth": 0}}, "edges": []}


def test_anomaly_keeps_all_words(spark):
    text = " ".join(f"w{i}" for i in range(50))
    screens = spark.createDataFrame([(1, "t", None, text), (2, "t", "", None)], "id long, discovered_at string, title string, ocr_text string")
    got = {r.id: json.loads(r.json) for r in writers.anomalies(screens, "no text: check!").collect()}
    assert got[1]["ocr"] == text.split(" ") and got[2]["ocr"] == [""]


def test_broken_files_are_reported(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "crawl_summary.json").write_text('{"session_id": "s1", "screens": []}')
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "crawl_summary.json").write_text('{"session_id": "s2", ')
    from screenloom.sources import readers

    assert [r.session_id for r in readers.summaries(spark, str(tmp_path)).collect()] == ["s1"]
    assert [r.path.endswith("b/crawl_summary.json") for r in readers.broken(spark, f"{tmp_path}/*/crawl_summary.json").collect()] == [True]
