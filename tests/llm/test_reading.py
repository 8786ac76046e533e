"""Held-out accuracy of the levels, and defined results for odd texts."""

import numpy as np
from pyspark.sql import functions as F

from screenloom.llm import reading


def test_sentences():
    assert reading.sentences("# Head\nOne (v1.2.3) two. Three!\nNo end\nhttps://x.y/z\n一つ。二つ」。「三。」四") == ["One (v1.2.3) two.", "Three!", "一つ。", "二つ」。", "「三。」"]
    assert reading.sentences("x" * 1_000_000) == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = reading.fit(docs, labels.where(~held))
    got = {r.doc_id: r.level for r in reading.levels(docs, model).collect()}
    truth = labels.where(held).groupBy("doc_id").agg(F.avg("level").alias("mean"), F.count("*").alias("n")).collect()
    sure = [r for r in truth if r.mean == int(r.mean)]
    assert len(sure) > 150
    assert sum(got[r.doc_id] == r.mean for r in sure) / len(sure) > 0.85
    assert sum((got[r.doc_id] >= 4) == (r.mean >= 4) for r in sure) / len(sure) > 0.95
    no_running = docs.where(F.lower(F.trim("source")).isin("ocr_dump", "session_log")).select("doc_id").collect()
    assert sum(got[r.doc_id] is not None for r in no_running) / len(no_running) < 0.005


def test_odd_texts_and_labels(spark):
    rows = [(i, f"The cat sees the {w}. The cat finds the {w}. The dog keeps the {w}.", "en") for i, w in enumerate(["box", "map", "key", "cup"] * 3)]
    rows += [(100 + i, f"Comprehensive {w} necessarily presupposes systematic deterioration, whereas {w} undermines conceptualisation. " * 4, "en") for i, w in enumerate(["interpretation", "equivalence", "recognition"] * 4)]
    odd = [(200, None, "en"), (201, "", None), (202, "The cat sees the box. " * 20_000, None), (203, "tap 1,2 -> x\nlabel", "en"), (204, "label\n" * 40 + "The cat sees the box.", "en"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows + odd], "doc_id long, text string, lang string, mean string, level int")
    labels = spark.createDataFrame([(i, 1) for i in range(12)] + [(100 + i, 5) for i in range(12)] + [(999, 3), (None, 2), (0, None), (1, 77)], "doc_id long, level int")
    model = reading.fit(docs, labels)
    got = {r.doc_id: (r.level, r.n_sentences) for r in reading.levels(docs, model).collect()}
    assert all(got[i][0] == 1 for i in range(12)) and all(got[100 + i][0] == 5 for i in range(12))
    assert got[200] == got[201] == got[203] == got[204] == (None, 0) and got[202] == (1, 20_000)
    assert reading.fit(docs, labels.limit(0)) is None and reading.fit(docs.limit(0), labels) is None
    assert {r.level for r in reading.levels(docs, None).collect()} == {None}


def test_long_leak_takes_no_level():
    assert reading.list_lines("label\n" * 40) == 40
    assert reading.list_lines("> If the weir floods at\n> past noon, name\n> the 3\n> boats. Who\n> asks\n\nHead\nOne two.") == 3
    m = reading.Model(["en"], [(0, w) for w in ("the", "cat", "sees", "box")], np.zeros((4, 5)), np.eye(5) + 0.1)
    prose = "The cat sees the box.\n" * 14
    wrapped = "Name the drowsy glazier who\n" + "repaired every lock gate ahead of\n" * 60
    joined = "Debe todavía 29 velas al campanario por prestadas plumas " * 40
    level, n = m.score([prose, prose + wrapped, prose + joined, "Label\n" * 29 + prose, wrapped, "Label\n" * 28 + prose])
    assert list(n) == [14, 14, 14, 0, 0, 14] and list(level > 0) == [True, True, True, False, False, True]


def test_word_difficulties_are_found_again():
    """Parameters fitted to expected counts of known words lie where they were; difficulties are on the scale of levels."""
    q = np.full((4, 5), 1e6)
    true = np.array([[-2.0, 1.0, 0.5, 0, 0], [-3.0, -2.0, 1.0, 0, 0], [-1.5, 0.0, 0.8, 0.3, 0], [-4.0, 1.5, 0.0, 0, 0]])
    got = reading.parameters(q / (1 + np.exp(-(true @ reading.DESIGN.T))), q)
    assert np.abs(got - true).max() < 0.1
    m = reading.Model(["en"], [(0, w) for w in "abcd"], got, np.eye(5))
    assert np.abs(m.difficulty() - [4, 2, 3, 6]).max() < 0.15
