"""Winnowing against looking up every run of every item."""

import random
import unicodedata

import numpy as np

from screenloom.llm import leakage, leakage_queries


def words(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    return "".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in t).split()


def brute(docs, items):
    runs = {}
    for i, lang, t in items:
        if t is not None:
            w, n = ("".join(words(t)), 30) if lang == "ja" else (words(t), 12)
            for k in range(len(w) - n + 1):
                runs.setdefault((n, tuple(w[k : k + n])), set()).add(i)
    out = set()
    for d, t in docs:
        if t is not None:
            w = words(t)
            for n, seq in ((12, w), (30, "".join(w))):
                for k in range(len(seq) - n + 1):
                    out |= {(d, i) for i in runs.get((n, tuple(seq[k : k + n])), ())}
    return out


def test_whole_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.lang, r.text) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()]
    got = [tuple(r) for r in leakage_queries.p7_found(spark, sf).collect()]
    assert set(got) == brute(docs, items) and len(got) == len(set(got)) and got


def made(g):
    items, docs = [], []
    for i in range(30):
        ja = i % 3 == 0
        items.append((i, "ja" if ja else g.choice(["en", None]), "".join(g.choices("あいうアイ漢字ー1", k=60)) if ja else " ".join(g.choices(["red", "Blue", "grün", "x1", "Straße"], k=30))))
    for d in range(300):
        i, lang, t = g.choice(items)
        units = list(t) if lang == "ja" else t.split()
        n = g.choice([11, 12, 13, 29, 30, 31, 20])
        at = g.randrange(max(1, len(units) - n))
        piece = (g.choice(["", "、", "\n", "​"]) if lang == "ja" else g.choice([" ", "\n> ", ", ", " -- "])).join(units[at : at + n])
        piece = g.choice([piece, piece.upper(), piece.translate({c: c + 0xFEE0 for c in range(33, 127)})])
        docs.append((d, f"{g.choice(['', 'before it', 'ここ。', 'q ' * 40])} {piece} {g.choice(['', 'after', '。そこ', 'z'])}"))
    return docs + [(1000, None), (1001, ""), (1002, "\0"), (1003, "word " * 100_000)], items + [(500, "en", None), (501, "en", "too short"), (502, "ja", "")]


def test_made_cases_both_joins(spark, monkeypatch):
    docs, items = made(random.Random(11))
    a = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, item_text string, fp int")
    b = spark.createDataFrame(items, "item_id long, lang string, text string")
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(a, b).collect()} == want and want
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(a, b).collect()} == want
    assert leakage.leaks(a.limit(0), b).count() == 0 and leakage.leaks(a, b.limit(0)).count() == 0


def test_every_long_run_keeps_a_hash():
    g = random.Random(1)
    for unit, n in leakage.RUN.items():
        run = [g.choice("abcdefgh") * (g.randrange(1, 4) if unit == "w" else 1) for _ in range(n)]
        kept = []
        for _ in range(20):
            side = lambda: [g.choice("abcdefgh") for _ in range(g.randrange(40))]
            kept.append(set(leakage.winnow([" ".join([*side(), *run, *side()])], unit)[2].tolist()))
        assert all(x & y for x in kept for y in kept)


def test_batches_do_not_matter():
    texts = ["one two three " * 30, "", "four five " * 20, "six"]
    doc, at, h = leakage.winnow(texts, "w")
    for i, t in enumerate(texts):
        d, a, x = leakage.winnow([t], "w")
        assert set(zip(a, x)) <= set(zip(at[doc == i], h[doc == i])) or np.all(np.isin(x, h[doc == i]))
