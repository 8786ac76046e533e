import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.functions import geometry as geo
from screenloom.functions import phash
from screenloom.functions import text as tx
from screenloom.operators import rules


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


def many(spark, values, kind, f):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}").select("i", f(F.col("c")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


BOXES = "array<struct<text:string,confidence:double,box:array<array<int>>,center:array<int>>>"


def box(text, conf, x, y, w=100, h=20):
    return (text, conf, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]], [x + w // 2, y + h // 2])


def md5(*texts):
    return hashlib.md5("|".join(sorted(texts)).encode()).hexdigest()[:16]


def test_fingerprints(spark):
    a = [box("12:34", 0.9, 0, 10), box("Lv12", 0.9, 0, 400), box("Home", 0.9, 0, 900), box("x", 0.9, 0, 500), box("low", 0.5, 0, 600)]
    b = [box("12:35", 0.9, 0, 10), box("Lv３４", 0.9, 0, 400), box("Home", 0.9, 0, 900)]
    v2 = many(spark, [a, b, [], None], BOXES, tx.fingerprint_v2)
    assert v2[0] == v2[1] == md5("Lv", "Home") and v2[2] == md5("") and v2[3] is None
    v1 = many(spark, [a, b], BOXES, tx.fingerprint_v1)
    assert v1 == [md5("Lv12", "Home"), md5("Lv３４", "Home")]


def test_title_and_tappables(spark):
    rows = [box("戻る", 0.99, 10, 120, 60, 70), box("General", 0.95, 300, 200, 200, 70), box("About", 0.9, 20, 500), box(">", 0.9, 950, 500, 20), box("About", 0.9, 20, 700), box("Reset now", 0.9, 300, 1950, 100, 20), box("Save", 0.9, 500, 1000), box("⚙", 0.9, 100, 800)]
    assert many(spark, [rows, [], None, [box("Nav", 0.9, 480, 150, 40, 20), box("z", 0.9, 0, 1900, 980, 20)]], BOXES, tx.screen_title) == ["General", "unknown", "unknown", "Nav"]
    got = [(r.text, r.path) for r in many(spark, [rows], BOXES, tx.tappable_items)[0]]
    assert got == [("About", "row"), ("Reset now", "footer"), ("Save", "action")]
    assert many(spark, [[], None], BOXES, tx.tappable_items) == [[], None]


@pytest.mark.parametrize(
    ("f", "kind", "values", "want"),
    [
        (tx.strip, "string", ["　a b\t", "", None], ["a b", "", None]),
        (tx.without_digits, "string", ["Lv１２3", None], ["Lv", None]),
        (tx.slug, "string", ["a/b c", "///", "", None, "x" * 99], ["a_b_c", "unknown", "unknown", "unknown", "x" * 30]),
        (tx.safe_name, "string", ["a b!c", "!!", None], ["abc", "item", "item"]),
        (tx.udid, "string", ["00008110aabbccddeeff0011", "00008110-00aa", None], ["00008110-AABBCCDDEEFF0011"[:8] + "-AABBCCDDEEFF0011", "00008110-00AA", None]),
        (tx.online_device, "string", ["List\nabc\toffline\nxyz\tdevice", "none", None], ["xyz", None, None]),
        (tx.os_version, "string", ["com.apple.iOS-17-2", "tvOS", None], ["17.2", None, None]),
        (tx.version_key, "string", ["17.2.1", "x", None], [[17, 2, 1], [0], None]),
        (tx.html_escape, "string", ["<a href=\"x\">&'", None], ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;", None]),
        (tx.sanitised, "string", [" <b>hi</b> ", None], ["hi", None]),
        (tx.item_label, "int", [0, 1, 2, None], ["0 items", "1 item", "2 items", None]),
        (lambda c: tx.shortened(c, 3), "string", ["abcd", "abc", None], ["abc…", "abc", None]),
        (tx.duration_minutes, "double", [29.0, 30.0, 90.0, None], [0, 1, 2, None]),
        (tx.element_type, "string", ["icon:gear", "menu", None], ["icon", "menu", "menu"]),
        (lambda c: tx.like_ascii(c, "A_c"), "string", ["xABC", "aＢC", "ac", None], [True, True, False, None]),
        (lambda c: tx.like_ascii(c, "A_c", literal=True), "string", ["xABC", "a_C"], [False, True]),
        (lambda c: tx.like_ascii(c, "a\\b"), "string", ["A\\B", "ab"], [True, False]),
        (rules.predicted, "string", ["ガシャを引く", "スキップ", "次へ進む", "OK", "出撃する", "AUTO", "通常攻撃", "必殺技を使う", "リザルト確認", "x", None], ["GACHA_DRAW", "SKIP_STORY", "SCENE_ADVANCE", "CONFIRM", "BATTLE_START", "AUTO_BATTLE", "NORMAL_ATTACK", "SPECIAL_ATTACK", "RESULT", "UNKNOWN", "UNKNOWN"]),
        (rules.category, "string", ["設定画面", "?", None], ["settings", "unknown", "unknown"]),
        (rules.instruction_name, "string", ["矢印はボタン", "スキップ タブ"], ["btn_arrow", "tab_skip"]),
    ],
)
def test_columns(spark, f, kind, values, want):
    assert many(spark, values, kind, f) == want


def test_actions(spark):
    texts = ["540,1200", "tap 540,1200,3000", "swipe 300,600,300,200", "300,600,300,200,500", "b", "wait 2.0", "SKIP", "jump", None, "tap 99999999999999,1"]
    got = many(spark, texts, "string", tx.action)
    assert [None if g is None else [r.type for r in g] for g in got] == [["tap"], ["tap"], ["swipe"], ["swipe"], ["back"], ["wait"], [], None, None, ["tap"]]
    assert (got[0][0].x, got[0][0].y, got[0][0].wait_ms) == (540, 1200, None) and got[1][0].wait_ms == 3000
    assert got[2][0].duration == 300 and got[3][0].duration == 500 and got[5][0].duration == 2.0 and got[9][0].x is None


def test_analysis(spark):
    texts = ['```json\n{"screen_type": "home", "buttons": [{"name": "a"}, {"name": ""}], "confidence": 0.5}\n```', "{}", "oops", None]
    got = many(spark, texts, "string", tx.analysis)
    assert (got[0].screen_type, got[0].confidence, got[0].failed) == ("home", 0.5, False) and [(b.name, b.priority) for b in got[0].buttons] == [("a", 2)]
    assert (got[1].screen_type, got[1].confidence) == ("不明", 1.0) and got[2].failed and got[2].buttons == [] and got[3].failed


def test_scene_gates_and_matches(spark):
    texts = [["Now Loading"], ["通常攻撃", "クエスト"], ["ホーム"], ["SKIP"], ["これは長い文章です", "もうひとつ長い文章です"], [], None]
    assert many(spark, texts, "array<string>", lambda c: rules.scene(c, F.lit(None).cast("string"))) == ["LOADING", "BATTLE", "MENU", "ADV", "STORY", "UNKNOWN", "UNKNOWN"]
    assert many(spark, [["x"]], "array<string>", lambda c: rules.scene(c, F.lit("STORY_TAP"))) == ["STORY"]
    assert many(spark, [["ab", "cd"], ["ab"], []], "array<string>", lambda c: rules.gate(c, ["a"], [["c", "z"]])) == [True, False, True]
    items = [[("OK now", 0.9), ("OK", 0.9), ("x", 1.0)], []]
    assert many(spark, items, "array<struct<text:string,confidence:double>>", lambda c: rules.first_match(c, ["none", "OK"], 0.5)) == ["OK now", None]
    assert one(spark, "LOADING", "string", rules.interval) == 5.0


def test_rules(spark):
    df = spark.createDataFrame([(1, "設定 Rank"), (2, None), (3, "")], "id int, title string")
    listed = spark.createDataFrame([(2, ["Rank"]), (1, ["設定", "x"])], "rule_id int, keywords array<string>")
    assert [(r.id, r.rule_id) for r in rules.triggered(df, "title", listed).collect()] == [(1, 1), (1, 2)]
    assert rules.triggered(df, "title", listed.limit(0)).count() == 0
    assert [r[0] for r in df.select(rules.decision([("a", F.col("id") == 2), ("b", F.col("id") > 1)], "c")).collect()] == ["c", "a", "b"]


def test_geometry(spark):
    assert one(spark, [[0, 0], [3, 1], [3, 2], [0, 1]], "array<array<int>>", geo.center) == [1, 1]
    assert tuple(one(spark, [[0, 5], [3, 5], [3, 9], [0, 9]], "array<array<int>>", geo.bounds)) == (0, 5, 3, 4)
    v = lambda *b: one(spark, 1, "int", lambda c: geo.iou(*[F.lit(x) for x in b]))
    assert v(0, 0, 10, 10, 0, 0, 10, 10) == 1.0 and v(0, 0, 10, 10, 20, 20, 5, 5) == 0.0 and v(0, 0, 0, 0, 0, 0, 0, 0) == 0.0
    assert abs(v(0, 0, 16, 16, 2, 2, 16, 16) - 196 / 316) < 1e-12
    assert one(spark, [1500, 300], "array<int>", lambda c: geo.upright(c, F.lit(720), F.lit(1600))) == [300, 1500]
    assert many(spark, [100, 220, 221, 900], "int", lambda c: geo.nearest(c, [130, 310, 490])) == [130, 130, 310, 490]
    assert many(spark, [(5, 100, 100), (90, 200, 200), (120, 10, 200), (0, 10, 10)], "struct<h:int,s:int,v:int>", lambda c: geo.colour(c["h"], c["s"], c["v"])) == ["red", "blue", "white", "gray"]
    assert tuple(one(spark, 800, "int", geo.crop)) == (28, 44) and tuple(one(spark, 100, "int", geo.crop)) == (0, 0)


def test_phash(spark):
    g = np.random.default_rng(1)
    images = [g.integers(0, 256, 1024).tolist(), None, [1.0, 2.0]]
    got = many(spark, images, "array<double>", lambda c: phash.phash_of_pixels(c)) if False else [r.r for r in spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in enumerate(images)], "i int, c array<double>").orderBy("i").select(phash.phash_of_pixels("c").alias("r")).collect()]
    m = phash.dct_matrix()
    low = (m @ np.array(images[0], float).reshape(32, 32) @ m.T)[:8, :8].ravel()
    assert got == [f"{int(''.join('1' if v > low.mean() else '0' for v in low), 2):016x}", None, None]
    assert np.allclose(m @ m.T, np.eye(32))
    bits = one(spark, low.tolist(), "array<double>", phash.bits_of_block)
    assert one(spark, bits, "string", phash.hex_of) == got[0]
    assert one(spark, ([1.0, 2.0], [2.0, 4.0]), "struct<a:array<double>,b:array<double>>", lambda c: phash.pixel_difference(c["a"], c["b"])) == 1.5
    assert one(spark, "x", "string", phash.content_hash) == hashlib.sha256(b"x").hexdigest()[:32]
