"""Peeling whole scopes, peeling by joins and a walk up from every node must agree."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.operators import hierarchy

ROWS = "id long, session_id string, fingerprint string, parent_fp string, depth int, path string, status int"


def walk(rows):
    """The same result by walking up from each node."""
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        if r[1] is not None and r[2] is not None:
            first.setdefault((r[1], r[2]), r)
    up = {k: (k[0], r[3]) if r[3] and (k[0], r[3]) in first else None for k, r in first.items()}
    out = {}
    for k in first:
        seen, at = [k], up[k]
        while at is not None and at not in seen:
            seen.append(at)
            at = up[at]
        out[k] = ("tree", seen[-1][1], len(seen) - 1, [x[1] for x in reversed(seen)]) if at is None else ("cycle" if at == k else "below_cycle", None, None, None)
    return out


def trees(seed, scopes=5, n=40):
    g = random.Random(seed)
    rows, i = [], 0
    for s in range(scopes):
        for k in range(n):
            i += 1
            rows.append((i, f"s{s}", f"n{k}", g.choice([None, "", "nowhere", f"n{g.randrange(n)}", f"n{max(0, k - 1)}", f"n{k // 2}"]), g.randrange(5), "x", 0))
    rows += [(1000 + i, *r[1:3], "n0", 9, "x", 0) for i, r in enumerate(rows[:10])]
    rows += [(2000, None, "a", "b", 0, "x", 0), (2001, "s0", None, "b", 0, "x", 0)]
    g.shuffle(rows)
    return rows


def run(spark, rows, **k):
    t = hierarchy.nodes(spark.createDataFrame(rows, ROWS), "session_id", "fingerprint", "parent_fp", "depth", "id")
    return hierarchy.hierarchy(t, **k).collect()


@pytest.mark.parametrize("local", [200_000, 20])
def test_against_walk(spark, local):
    rows = trees(1)
    got = run(spark, rows, local_nodes=local)
    assert {(r.scope, r.node): (r.status, r.root, r.depth, r.path) for r in got} == walk(rows)


def test_both_ways_agree_in_all_columns(spark):
    rows = trees(7, scopes=2, n=60)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, run(spark, rows)), key=key) == sorted(map(tuple, run(spark, rows, local_nodes=40)), key=key)


def test_chain_and_star(spark):
    rows = [(i, "c", f"n{i}", f"n{i - 1}" if i else None, i, "x", 0) for i in range(600)] + [(1000 + i, "star", f"m{i}", "m0" if i else None, 0, "x", 0) for i in range(50)]
    got = {(r.scope, r.node): r for r in run(spark, rows)}
    assert got["c", "n599"].depth == 599 and got["c", "n0"].n_descendants == 599 and got["star", "m0"].n_descendants == 49


def test_descendants(spark):
    rows = [(1, "s", "a", None, 0, "", 0), (2, "s", "b", "a", 0, "", 0), (3, "s", "c", "b", 0, "", 0), (4, "s", "x", "x", 0, "", 0)]
    t = hierarchy.nodes(spark.createDataFrame(rows, ROWS), "session_id", "fingerprint", "parent_fp", "depth", "id")
    assert {tuple(r) for r in hierarchy.descendants(hierarchy.hierarchy(t)).collect()} == {("s", "a", "b", 1), ("s", "a", "c", 2), ("s", "b", "c", 1)}


def odd_graph():
    """Keys with any characters, a long chain, a star, and long loops with nodes hanging on them."""
    rows = [(1, "a/b", None), (2, "c", "a/b"), (3, "d", "c"), (4, "a", None), (5, "b", "a"), (6, "", None)]
    rows += [(100 + i, f"k{i}", f"k{i - 1}" if i else "") for i in range(120)]
    rows += [(1000 + i, f"s{i}", "s0" if i else None) for i in range(150)]
    rows += [(2000 + i, f"z{i}", f"z{(i + 1) % 37}") for i in range(37)] + [(2200 + i, f"y{i}", f"y{i - 1}" if i else "z5") for i in range(40)]
    rows += [(2400, "x", "x"), (2401, "w", "x"), (2402, "v1", "v2"), (2403, "v2", "v1")]
    return [(i, "one", k, p, 0, "x", 0) for i, k, p in rows]


@pytest.mark.parametrize("local", [10_000, 40])
def test_odd_graph(spark, local):
    rows = odd_graph()
    got = run(spark, rows, local_nodes=local)
    want = walk(rows)
    assert {(r.scope, r.node): (r.status, r.root, r.depth, r.path) for r in got} == want
    below = {}
    for status, _, _, path in want.values():
        for k in (path or [])[:-1]:
            below[k] = below.get(k, 0) + 1
    assert all(r.n_descendants == (below.get(r.node, 0) if r.status == "tree" else None) for r in got)
    assert {r.node: r.root_linked for r in got if r.node in ("d", "s4")} == {"d": False, "s4": False}


def test_long_chain_in_one_scope(spark):
    """Rounds grow with the logarithm of a chain's length."""
    n = 20_000
    rows = spark.range(n).select("id", F.lit("s").alias("session_id"), F.col("id").cast("string").alias("fingerprint"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_fp"), F.lit(0).alias("depth"))
    placed = hierarchy.hierarchy(hierarchy.nodes(rows, "session_id", "fingerprint", "parent_fp", "depth", "id"), local_nodes=6_000, with_paths=False)
    wrong = placed.where((F.col("depth") != F.col("node").cast("int")) | (F.col("n_descendants") != n - 1 - F.col("depth")) | (F.col("root") != "0"))
    assert placed.count() == n and wrong.count() == 0


def test_paths_in_small_batches(spark, monkeypatch):
    rows = trees(3)
    monkeypatch.setattr(hierarchy, "NAMES", 7)
    t = hierarchy.nodes(spark.createDataFrame(rows, ROWS), "session_id", "fingerprint", "parent_fp", "depth", "id")
    table = hierarchy._linked(t).orderBy("scope").toArrow()
    got = [r for b in hierarchy._peeled(table, True) for r in b.to_pylist()]
    assert {(r["scope"], r["node"]): (r["status"], r["root"], r["depth"], r["path"]) for r in got} == walk(rows)


def test_empty_and_peel_order(spark):
    assert run(spark, []) == []
    levels, size, peeled = hierarchy.peel(np.array([-1, 0, 1, 4, 3, 3]))
    assert [list(x) for x in levels] == [[2, 5], [1], [0]] and list(size[:3]) == [3, 2, 1] and list(peeled) == [True, True, True, False, False, True]
