"""Ordered rule lists over texts: keyword gates, best and first matches, predictions, scenes, decision lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any

#: Keyword -> what a tap on it leads to.
PREDICTIONS = {
    "ガシャ": "GACHA_DRAW", "ガチャ": "GACHA_DRAW", "召喚": "GACHA_DRAW", "受け取る": "RECEIVE_ITEM", "獲得": "RECEIVE_ITEM", "次へ": "SCENE_ADVANCE", "スキップ": "SKIP_STORY", "SKIP": "SKIP_STORY", "進む": "SCENE_ADVANCE",
    "TAP TO": "SCENE_ADVANCE", "START": "GAME_START", "開始": "BATTLE_START", "出撃": "BATTLE_START", "戦闘": "BATTLE_START", "AUTO": "AUTO_BATTLE", "攻撃": "BATTLE_ATTACK", "通常攻撃": "NORMAL_ATTACK", "必殺技": "SPECIAL_ATTACK",
    "スキル": "SKILL_USE", "OK": "CONFIRM", "閉じる": "CLOSE_DIALOG", "確認": "CONFIRM", "完了": "COMPLETE", "決定": "CONFIRM", "了解": "CONFIRM", "わかった": "CONFIRM", "リザルト": "RESULT", "Result": "RESULT", "ホーム": "GO_HOME",
    "メニュー": "OPEN_MENU", "クエスト": "OPEN_QUEST", "ショップ": "OPEN_SHOP", "編成": "OPEN_FORMATION",
}
#: Keyword -> what is said of the tap.
DESCRIPTIONS = {
    "ガシャ": "召喚演出・アイテム獲得シーンが発生する", "ガチャ": "召喚演出・アイテム獲得シーンが発生する", "召喚": "召喚演出が発生する", "受け取る": "アイテム受け取り処理が実行される", "獲得": "アイテム獲得処理が実行される",
    "次へ": "シーンが遷移してストーリーが進む", "スキップ": "ストーリーシーンがスキップされる", "SKIP": "ストーリーシーンがスキップされる", "進む": "シーンが遷移する", "TAP TO": "シーンが進む", "START": "ゲームまたはバトルが開始する",
    "開始": "バトルまたはクエストが開始する", "出撃": "クエストが開始しバトル画面へ遷移する", "戦闘": "クエストが開始しバトル画面へ遷移する", "AUTO": "バトルがAUTOモードで自動進行する", "攻撃": "戦闘ターンが進行する", "通常攻撃": "通常攻撃が実行される",
    "必殺技": "必殺技演出が発生し大ダメージが入る", "スキル": "スキルが発動する", "OK": "確認ダイアログが閉じてメニューに戻る", "閉じる": "ダイアログが閉じる", "確認": "確認処理が実行される", "完了": "処理が完了してメニューに戻る",
    "決定": "選択が確定される", "了解": "確認ダイアログが閉じる", "わかった": "確認ダイアログが閉じる", "リザルト": "バトル結果画面が表示される", "Result": "バトル結果画面が表示される", "ホーム": "ホーム画面に戻る",
    "メニュー": "メニューが開く", "クエスト": "クエスト選択画面へ遷移する", "ショップ": "ショップ画面へ遷移する", "編成": "パーティ編成画面へ遷移する",
}
#: Keywords of scenes, in the order in which they are tried, and the wait in seconds for each scene.
SCENES = [
    ("LOADING", ["ダウンロード", "Loading", "Now Loading", "ロード中", "通信中"]),
    ("BATTLE", ["通常攻撃", "单体攻撃", "単体攻撃", "全体攻撃", "必殺技", "BREAK", "WAVE", "ENEMY TURN", "Turn"]),
    ("MENU", ["クエスト", "ショップ", "ガシャ", "ガチャ", "ホーム", "メニュー", "お知らせ", "編成", "光の間"]),
    ("ADV", ["スキップ", "SKIP"]),
]
INTERVALS = {"BATTLE": 1.0, "ADV": 1.0, "STORY": 2.0, "LOADING": 5.0, "MENU": 1.0, "UNKNOWN": 1.0}
STORY_ACTIONS = ["STORY_TAP", "ADV_RAPID_TAP", "STORY_TAP_HINT"]
#: Keyword -> category of a screen.
CATEGORIES = {"タイトル": "title", "ホーム": "home", "クエスト": "quest", "バトル": "battle", "ショップ": "shop", "ガチャ": "gacha", "ランキング": "ranking", "設定": "settings", "ログイン": "login", "イベント": "event"}
#: Words of an instruction -> role and element of the thing it names.
ROLES = {"ボタン": "btn", "アイコン": "icon", "タブ": "tab", "メニュー": "menu", "リスト": "list"}
ELEMENTS = {"矢印": "arrow", "矩形": "rect", "ボタン": "btn", "アイコン": "icon", "スキップ": "skip", "次へ": "next", "OK": "ok", "閉じる": "close", "ホーム": "home", "ガチャ": "gacha", "ガシャ": "gacha", "戦闘": "battle", "出撃": "deploy", "クエスト": "quest"}


def first_keyword(c: Column, table: dict[str, str], default: str) -> Column:
    """Value of the first keyword, in the table's order, that the text contains."""
    return F.coalesce(*[F.when(c.contains(k), F.lit(v)) for k, v in table.items()], F.lit(default))


def predicted(c: Column) -> Column:
    """What a tap leads to: the longest keyword decides, the first listed on ties."""
    return first_keyword(c, dict(sorted(PREDICTIONS.items(), key=lambda kv: -len(kv[0]))), "UNKNOWN")


def category(c: Column) -> Column:
    return first_keyword(c, CATEGORIES, "unknown")


def instruction_name(c: Column) -> Column:
    """role_element that an instruction names."""
    return F.concat_ws("_", first_keyword(c, ROLES, "btn"), first_keyword(c, ELEMENTS, "unknown"))


def scene(texts: Column, last_action: Column) -> Column:
    """Scene of a screen: keyword groups in order, then a story by its last action or by two long lines with kana."""
    joined = F.array_join(texts, " ")
    lines = F.size(F.filter(texts, lambda t: (F.length(t) >= 8) & t.rlike("[ぁ-ヿ]")))
    out = F.when(F.lit(False), "")
    for name, keywords in SCENES:
        out = out.when(contains_any(joined, keywords), name)
    return out.when(last_action.isin(STORY_ACTIONS), "STORY").when(lines >= 2, "STORY").otherwise("UNKNOWN")


def interval(scene_: Column) -> Column:
    """Wait before the next look at a scene."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in INTERVALS.items() for x in kv]), scene_)


def keywords_present(texts: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in any of the texts."""
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.exists(texts, lambda t: t.contains(k))))


def gate(texts: Column, any_of: list[str] = (), all_of: list[list[str]] = ()) -> Column:
    """Any of one list, and one at least of each of the others; empty texts pass."""
    one = lambda ks: F.exists(texts, lambda t: contains_any(t, list(ks)))
    ok = reduce(lambda a, b: a & b, [one(ks) for ks in all_of], F.lit(True))
    if any_of:
        ok &= one(any_of)
    return (F.size(texts) == 0) | ok


def best_match(items: Column, keyword: str, least: float) -> Column:
    """The surest item that contains a keyword, the first on ties (P13, P14). items: array of struct(text, confidence)."""
    hits = F.filter(F.transform(items, lambda r, i: F.struct(r["confidence"].alias("c"), (-i).alias("o"), r["text"].alias("text"))), lambda r: r["text"].contains(keyword) & (r["c"] >= least))
    return F.array_max(hits)["text"]


def first_match(items: Column, keywords: list[str], least: float) -> Column:
    """The best match of the first keyword that has one."""
    return F.coalesce(*[best_match(items, k, least) for k in keywords])


def decision(rules: list[tuple[str, Column]], default: str) -> Column:
    """One CASE of an ordered list: the name of the first rule whose condition holds."""
    out = F.when(F.lit(False), "")
    for name, condition in rules:
        out = out.when(condition, name)
    return out.otherwise(default)


def triggered(df: DataFrame, text: str, rules: DataFrame, chunk: int = 500) -> DataFrame:
    """Every rule (rule_id, keywords array) that a row's text triggers (P17, X1). Rules are a configuration; any number
    of them is compiled, `chunk` of them to a pass over the rows."""
    listed = [r.asDict() for r in rules.orderBy("rule_id").collect()]
    out = None
    for i in range(0, max(1, len(listed)), chunk):
        part = listed[i : i + chunk]
        fired = F.array(*[F.when(contains_any(F.col(text), list(r["keywords"])), F.lit(r["rule_id"])) for r in part]) if part else F.expr("cast(array() as array<int>)")
        rows = df.withColumn("rule_id", F.explode(F.filter(fired, lambda x: x.isNotNull())))
        out = rows if out is None else out.unionByName(rows)
    return out


def surest(items: DataFrame, key: str, keywords: list[str], least: float) -> DataFrame:
    """(key, best): the surest item of the first keyword that has one, the first by id on ties (P12-P15), over rows instead
    of arrays: a hot key costs one row per task. Items without text or of less confidence than `least` don't count."""
    ok = (F.col("text") != "") & (F.col("confidence") >= least)
    best = [F.max(F.when(ok & F.col("text").contains(k), F.struct("confidence", -F.col("id"), F.col("text").alias("t"))))["t"] for k in keywords]
    return items.groupBy(key).agg(F.coalesce(*best).alias("best"))


def confident(items: Column, least: float) -> Column:
    """Items with text and enough confidence (P12). items: array of struct(text, confidence)."""
    return F.filter(items, lambda r: (r["confidence"] >= least) & (r["text"] != ""))


def repeated(texts: Column, word: str, least: int) -> Column:
    """Whether a text occurs exactly, at least so many times."""
    return F.size(F.filter(texts, lambda t: t == word)) >= least


def best_template(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The template of the highest score among those that reach their own threshold and whose gate is open; the first by
    template_id on ties (D7, X2). scores: keys, template_id, score, threshold, open."""
    ok = scores.where((F.col("score") >= F.col("threshold")) & F.col("open"))
    return ok.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("template_id")).alias("o"))).alias("b")).select(*keys, (-F.col("b.o")).alias("template_id"), F.col("b.score").alias("score"))


def prediction(c: Column) -> Column:
    """struct(action, description) of what a tap leads to."""
    order = sorted(DESCRIPTIONS, key=lambda k: -len(k))
    words = F.coalesce(*[F.when(c.contains(k), F.lit(DESCRIPTIONS[k])) for k in order], F.lit("未知の操作が実行される"))
    return F.struct(predicted(c).alias("action"), words.alias("description"))


def other_than(c: Column, words: list[str], prefixes: list[str] = (), parts: list[str] = ()) -> Column:
    """Texts that are none of the words, begin with no prefix and contain no part."""
    bad = c.isin(list(words))
    for p in prefixes:
        bad = bad | c.startswith(p)
    for p in parts:
        bad = bad | c.contains(p)
    return ~bad
