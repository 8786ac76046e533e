"""Plain form against an independent conversion, character by character, with unicodedata."""

import random
import unicodedata

import pyarrow.parquet as pq

from screenloom.llm import plainform as pf
from screenloom.llm import plainform_queries

LAT, CYR, GRE = ({r[i]: r for r in zip(*[iter(pf.ALIKE.split())] * 3) if r[i] != "."} for i in range(3))


def name(c):
    return unicodedata.name(c, "?")


def brute(text):
    """Decompose by table, look-alikes by scanning words, NFC by unicodedata."""
    chars = list(unicodedata.normalize("NFD", "".join("" if pf.is_invisible(c) else " " if pf.is_blank(c) else (unicodedata.normalize("NFKC", c) if not unicodedata.decomposition(c).startswith(pf.DIFFERENT) and not (unicodedata.decomposition(c).startswith("<compat> 0020 ")) else c) for c in text)))
    base = [i for i, c in enumerate(chars) if not unicodedata.combining(c)]
    out, word = chars[:], []

    def close():
        if not word:
            return
        score = [0, 0, 0]
        of = [("LATIN", "CYRILLIC", "GREEK").index(name(chars[i]).split()[0]) for i in word]
        for k in range(3):
            for i, s in zip(word, of):
                row = LAT.get(chars[i]) or CYR.get(chars[i]) or GRE.get(chars[i])
                score[k] += 1 if s == k else 0 if row and row[k] in pf.EVERYDAY[k] else -1_000_000
            score[k] = score[k] if k in of else -(10**18)
        to = score.index(max(score))
        for i in word:
            row = LAT.get(chars[i]) or CYR.get(chars[i]) or GRE.get(chars[i])
            if row and row[to] in pf.EVERYDAY[to]:
                out[i] = row[to]
        word.clear()

    for i in base:
        if name(chars[i]).split()[0] in ("LATIN", "CYRILLIC", "GREEK") and unicodedata.category(chars[i])[0] == "L":
            word.append(i)
        else:
            close()
    close()
    kind = {i: "A" if chars[i] in pf.KANA_ALIKE or chars[i] in pf.STROKES else "K" if name(chars[i]).startswith(("KATAKANA LETTER", "KATAKANA-HIRAGANA PROLONGED")) else "H" if name(chars[i]).startswith("CJK UNIFIED") else "o" for i in base}
    for n, i in enumerate(base):
        if kind[i] == "A":
            left = next((kind[j] for j in reversed(base[:n]) if kind[j] != "A"), None)
            right = next((kind[j] for j in base[n + 1 :] if kind[j] != "A"), None)
            if chars[i] in pf.STROKES:
                out[i] = "ー" if left == right == "K" else chars[i]
            elif "K" in (left, right) and "H" not in (left, right) and (chars[i] != "一" or n and kind[base[n - 1]] in "KA"):
                out[i] = pf.KANA_ALIKE[chars[i]]
    return unicodedata.normalize("NFC", "".join(out))


CASES = {
    "Ｌｖ１２": "Lv12", "ｶﾞｲﾄﾞ": "ガイド", "Café": "Café", "a​b­c": "abc", "x y　z": "x y z", "Rеwіnd": "Rewind", "Caд": "Саd"[:0] + "Сад", "ΗΡ": "ΗΡ", "Nаһаѕ": "Nahas", "Лepy": "Леру", "ﬁle": "file", "Ⅲ": "III",
    "ペッ卜": "ペット", "一覧": "一覧", "アイテム一覧": "アイテム一覧", "メニュ一": "メニュー", "入口一覧": "入口一覧", "ガイ卜゙": "ガイド", "工房": "工房", "工リア": "エリア", "二人確認": "二人確認", "x²": "x²", "": "", "plain": "plain",
    "ӏove": "love", "ҮES": "YES", "pϳ": "pj", "ϲat": "cat", "Ϲat": "Cat", "hүper": "hyper", "loveж": "loveж", "ϲας": "ςας", "𝐚д": "ад", "12ｱ・Ｂ、ガ゙": "12ア・B、ガ゙",
    "q̣̇": "q̣̇", "q̣̇": "q̣̇", "한": "한", "́a": "́a", "ệ": "ệ", "´": "´", "й": "й", "😀ａ": "😀a", "á́": "á́", "Ångström": "Ångström",
}


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "row long, text string, key string, salt int")
    return {r.text: r.plain for r in pf.plain_texts(df, "text", "row").collect()}


def test_cases(spark):
    got = forms(spark, [*CASES, None])
    assert got == CASES | {None: None}


def test_tokens_that_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(pf, "BROADCAST_TOKENS", 0)
    assert forms(spark, [*CASES, None]) == CASES | {None: None}


def test_random_against_brute_force(spark):
    g = random.Random(3)
    pool = "aeopcxyABEHKMT аеорсухАВЕКМН ονΑΒ一二八力口工卜夕アカガトーのを覧方ｶﾞﾄﾟ１Ａ゙゚̣́̈​­　 ﬁⅡ12-"
    texts = ["".join(g.choices(pool, k=g.randrange(1, 25))) for _ in range(1500)]
    got = forms(spark, texts)
    assert {t: got[t] for t in texts} == {t: brute(t) for t in texts}


def test_found_on_whole_tables(spark, sf):
    expected = set()
    for t, fields in (("lc_screens", ("title", "ocr_text")), ("lc_tappable_items", ("text",))):
        rows = pq.read_table(f"{sf}/{t}.parquet").to_pylist()
        expected |= {(t, f, r["id"]) for r in rows for f in fields if r[f] is not None and brute(r[f]) != r[f]}
    assert {tuple(r) for r in plainform_queries.p1_found(spark, sf).collect()} == expected
    assert expected


def test_long_text_empty_table_and_repeats(spark):
    long = "ガ" * 20_000
    got = forms(spark, [long, "Ａ", "Ａ"])
    assert got[long] == "ガ" * 20_000 and got["Ａ"] == "A"
    assert pf.not_plain(spark.createDataFrame([], "id long, text string"), "text", ["id"]).count() == 0
