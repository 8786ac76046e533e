"""Links and groups against brute force over all pairs."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from screenloom.llm import neardup, neardup_queries
from tests.llm.test_plainform import brute as plain


def jaccard_pairs(sets, percent):
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * percent}


def variants(g, n):
    vocabulary = [f"w{i}" for i in range(120)]
    sets = {}
    for i in range(n):
        s = set(g.sample(vocabulary, g.randrange(3, 30)))
        sets[len(sets)] = s
        for _ in range(g.randrange(3)):
            t = set(s)
            for w in g.sample(sorted(t), min(len(t) - 1, g.randrange(0, 5))):
                t.discard(w)
                if g.random() < 0.5:
                    t.add(g.choice(vocabulary))
            sets[len(sets)] = t
    distinct = {}
    for k, s in sets.items():
        distinct.setdefault(frozenset(s), k)
    return {k: set(s) for s, k in distinct.items()}


def test_similar_pairs_equal_brute_force(spark):
    for percent in (70, 80):
        sets = variants(random.Random(percent), 120)
        got = {tuple(r) for r in neardup.similar_pairs(spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "sid long, words array<string>"), percent).collect()}
        assert got == jaccard_pairs(sets, percent) and got


def groups(rows):
    """Group of each id by comparing every two rows."""
    valid = {i: int(h, 16) for i, h, _ in rows if h and re.fullmatch("[0-9a-fA-F]{16}", h)}
    words = {i: s for i, _, t in rows if t is not None and len(s := {w for w in re.sub(r"\d", "", plain(t)).split(" ") if w}) >= 10}
    up = {i: i for i, _, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for n, b in enumerate(ids):
        for a in ids[:n]:
            if a in valid and b in valid and (valid[a] ^ valid[b]).bit_count() < 8 or a in words and b in words and len(words[a] & words[b]) * 10 >= len(words[a] | words[b]) * 7:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_groups_of_whole_table(spark, sf):
    rows = [(r.id, r.phash, r.ocr_text) for r in spark.read.parquet(f"{sf}/lc_screens.parquet").collect()]
    want = groups(rows)
    got = {r.id: r.group_id for r in neardup_queries.p4_groups(spark, sf).collect()}
    assert got == want
    by = {}
    for i, g in want.items():
        by.setdefault(g, []).append(i)
    pairs = {(a, b) for m in by.values() for a in m for b in m if a < b}
    found = [tuple(r) for r in neardup_queries.p4_found(spark, sf).collect()]
    assert set(found) == pairs and len(found) == len(pairs) and pairs


def test_nulls_ties_long_texts_and_empty(spark):
    text = " ".join(f"label{chr(97 + i)}" for i in range(12))
    rows = [(1, None, None), (2, "", ""), (3, "none", text), (4, None, text + " 12 77"), (5, "00000000000000ff", text + " more"), (6, "00000000000000FE", "x " * 50_000), (7, None, "x"), (7, None, "x"), (8, "ffffffffffffffff", None), (9, "fffffffffffffff", None)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "id long, phash string, ocr_text string, words string, row int")
    assert {r.id: r.group_id for r in neardup.groups(df, "id", "phash", "ocr_text").collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 7: 7, 8: 8, 9: 9}
    assert neardup.groups(df.limit(0), "id", "phash", "ocr_text").count() == 0


@pytest.mark.parametrize(("rare", "most", "largest"), [(0, 1_000_000, 40), (3, 1_000_000, 40), (3, 20, 40), (0, 1_000_000, 14), (5, 30, 14), (3, 0, 40)])
def test_all_kinds_of_keys_lose_no_pair(spark, monkeypatch, rare, most, largest):
    """Rare and frequent tokens, more of them than all tasks know, triples, small and large sets."""
    monkeypatch.setattr(neardup, "RARE", rare)
    monkeypatch.setattr(neardup, "MOST_FREQUENT", most)
    monkeypatch.setattr(neardup, "LARGEST", largest)
    for percent in (50, 70, 90):
        g = random.Random(percent + rare)
        sets = variants(g, 100)
        sets |= {1000 + i: s for i, s in enumerate({frozenset(g.sample(["w1", "w2", "w3", "w4"], g.randrange(1, 5))) for _ in range(9)}) if s not in sets.values()}
        df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "sid long, words array<string>")
        got = [tuple(r) for r in neardup.similar_pairs(df, percent).collect()]
        assert set(got) == jaccard_pairs(sets, percent) and len(got) == len(set(got)) and got


def test_frequent_tokens_are_no_keys():
    """Single tokens of many sets are not asked for: candidates would grow as the square of the sets."""
    words = np.arange(100, 130)
    many = np.full(30, 10_000)
    _, owner, key, held = neardup.signed(np.array([1, 2]), np.array([12, 12]), np.concatenate([words[:12], np.r_[words[:11], 7]]), words, many, 70)
    assert not set(key.tolist()) & set(words.tolist()) and held.all()
    assert 7 in key[owner == 1].tolist() and set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_groups_leave_no_tables_and_shuffles(spark, sf):
    """What the steps wrote is gone when they have ended, whether or not the driver collects its garbage."""
    from pyspark.sql import functions as F

    from screenloom.session import checkpoint

    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    bytes_of = lambda: sum(p.stat().st_size for p in local.rglob("shuffle_*.data"))
    before = bytes_of()
    checkpoint(spark.range(200_000).groupBy(F.xxhash64("id").alias("k")).count())
    assert bytes_of() - before < 100_000
    before = bytes_of()
    assert neardup_queries.p4_groups(spark, sf).count()
    assert bytes_of() - before < 200_000
    assert not list(Path(spark.conf.get("spark.checkpoint.dir")).rglob("kept-*"))


def test_repeated_rows_are_one(spark):
    text = " ".join(f"label{chr(97 + i)}" for i in range(12))
    df = spark.createDataFrame([(1, "0000000000000001", text), (1, "0000000000000001", text), (2, None, text), (None, "0000000000000001", text)], "id long, phash string, ocr_text string")
    assert sorted(tuple(r) for r in neardup.groups(df, "id", "phash", "ocr_text").collect()) == [(1, 1, 0), (2, 1, 0)]
