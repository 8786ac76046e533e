"""Incremental linkage against comparing every two rows."""

import random
import re

import pytest

from screenloom.llm import history, history_queries


def brute(rows):
    """rows: id, batch, scope, phash."""
    case = [(i, b, s, int(h, 16)) for i, b, s, h in rows if s is not None and h and re.fullmatch("[0-9a-fA-F]{16}", h)]
    return {i for i, b, s, h in case if any(s == s2 and b2 < b and (h ^ h2).bit_count() < 8 for _, b2, s2, h2 in case)}, case


def test_found_on_whole_table(spark, sf):
    rows = [(r.id, r.batch, r.scope, r.phash) for r in history_queries.screens_of_games(spark, sf).collect()]
    got = [r.id for r in history_queries.p5_found(spark, sf).collect()]
    assert set(got) == brute(rows)[0] and len(got) == len(set(got)) and got


def made(seed=4, n=160):
    g = random.Random(seed)
    base = [g.getrandbits(64) for _ in range(25)]
    rows = []
    for i in range(n):
        h = g.choice(base)
        for b in g.sample(range(64), g.randrange(0, 9)):
            h ^= 1 << b
        rows.append((i, g.randrange(1, 7), g.choice(["x", "y", None]), g.choice([f"{h:016x}", f"{h:016X}", "none", None, f"{h:016x}"]), g.choice(["t", None, ""]), "f"))
    return rows


def clusters(rows, within):
    """Representatives by union-find over all records of (batch, scope, hash)."""
    case = brute([r[:4] for r in rows])[1]
    first = {}
    for i, b, s, h in sorted(case):
        first.setdefault((b, s, h), i)
    up = {n: n for n in first.values()}
    find = lambda x: x if up[x] == x else find(up[x])
    for (b, s, h), i in first.items():
        for (b2, s2, h2), i2 in first.items():
            if s == s2 and (b2 < b or within and b2 == b) and (h ^ h2).bit_count() < 8:
                x, y = sorted((find(i), find(i2)))
                up[y] = x
    return {n: find(n) for n in up}


ROWS = "id long, batch int, scope string, phash string, title string, fingerprint string"


@pytest.mark.parametrize("within", [False, True])
def test_batches_one_by_one(spark, monkeypatch, within):
    monkeypatch.setattr(history, "MERGED", 3)
    rows = made()
    found, case = brute([r[:4] for r in rows])
    key = {(b, s, h if h < 1 << 63 else h - (1 << 64)) for i, b, s, h in case if i in found}
    past = history_queries._replay(spark, spark.createDataFrame(rows + rows[:5], ROWS), within=within)
    got = past.matches().collect()
    assert {(r.batch, r.scope, r.h) for r in got} == key and len(got) == len(key) and all(r.score is not None for r in got)
    want = clusters(rows, within)
    assert {r.nid: r.rep for r in past.representatives().collect()} == want and {r.nid: r.rep for r in got} == {r.nid: want[r.nid] for r in got}
    assert len(past.runs) < 4
    past.drop()


def test_opened_again_and_broken_off(spark):
    """A new object goes on where the named history stands; a batch that broke off is accepted again."""
    rows = made(9, 120)
    new = history.records(spark.createDataFrame(rows, ROWS))
    history.History(spark, "again").accept(new.where("batch = 1"))
    half = history.History(spark, "again")
    half._save = lambda: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        half.accept(new.where("batch = 2"))
    for b in range(2, 7):
        history.History(spark, "again").accept(new.where(f"batch = {b}"))
    past = history.History(spark, "again")
    assert past.n == 6 and past.weights and {r.nid: r.rep for r in past.representatives().collect()} == clusters(rows, False)
    past.drop()


def test_a_batch_reads_what_it_asks_for(spark, monkeypatch):
    """Blocks read and mapping rows written follow the batch, not the history."""
    monkeypatch.setattr(history, "BUCKETS", 400)
    g = random.Random(1)
    old = [(i, 1, "x", f"{g.getrandbits(64):016x}", "t", "f") for i in range(3000)]
    new = [(10_000, 2, "x", old[7][3], "t", "f")]
    past = history.History(spark, "small")
    past.accept(history.records(spark.createDataFrame(old, ROWS)))
    batch = history.records(spark.createDataFrame(new, ROWS))
    assert past.blocks_asked(batch).count() < 0.25 * 4 * len(old)
    past.accept(batch)
    assert [tuple(r) for r in spark.read.parquet(f"{past.path}/members-1").collect()] == [(10_000, 7)] and spark.read.parquet(f"{past.path}/moves-1").count() == 0
    past.drop()


def test_weights_rise_with_agreement():
    w = history.learn({"0==": 50, "1==": 40, "2=x": 9, "3xx": 200, "3=x": 20, "2xx": 2})
    assert w["0=="] > w["2=x"] > w["3xx"] and history.learn({}) == {}


def test_empty(spark):
    past = history_queries._replay(spark, spark.createDataFrame([], ROWS))
    assert past.matches().count() == 0 and past.representatives().count() == 0
