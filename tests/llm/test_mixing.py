import numpy as np
import pytest

from screenloom.llm import mixing, mixing_queries


def test_quotas():
    q = mixing.quotas(np.array([0.5, 0.3, 0.2]), np.array([100, 1000, 1000]), 1000)
    assert list(q) == [100, 540, 360]
    assert list(mixing.quotas(np.array([0.5, 0.5]), np.array([0, 10]), 100)) == [0, 10]
    assert list(mixing.quotas(np.array([1.0, 0.0]), np.array([7, 10]), 100)) == [7, 0]
    assert mixing.quotas(np.array([1 / 3] * 3), np.array([99] * 3), 100).sum() == 100


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    a, b = (mixing.permuted(np.arange(n), n, k) for k in (1, 2))
    assert sorted(a) == list(range(n)) and (n < 17 or list(a) != list(b))


def test_mixture_of_test_tables(spark, sf):
    docs, targets = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet")
    mixed, report = mixing.mixture(docs, targets, block_tokens=64, shard_slots=50)
    rows, rep = mixed.collect(), {r.source: r for r in report.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    repeat = {r.source: r.max_repeat for r in targets.collect()}
    assert {(r.shard, r.slot) for r in rows} == {(r.shard, r.slot) for r in rows} and len({(r.shard, r.slot) for r in rows}) == len(rows)
    used = {}
    for r in rows:
        assert r.n_tokens == sum(s.stop - s.first for s in r.spans) <= 64
        used[r.source, r.block] = used.get((r.source, r.block), 0) + 1
    assert all(n <= repeat[s] for (s, _), n in used.items())
    # shares: those of the quotas, by tokens counted independently
    tokens, blocks = {}, {}
    for d in docs.collect():
        s = (d.source or "").strip().lower()
        tokens[s] = tokens.get(s, 0) + len(mixing.encode(d.text or ""))
    for s, n in tokens.items():
        assert rep[s].n_tokens == n
        if s in repeat:
            blocks[s] = -(-n // 64)
            assert rep[s].n_blocks == blocks[s]
    names = sorted(repeat)
    want = mixing.quotas(np.array([rep[s].target_share for s in names]), np.array([blocks.get(s, 0) * repeat[s] for s in names]), -(-sum(tokens.get(s, 0) for s in names) // 64))
    got = [sum(n for (t, _), n in used.items() if t == s) for s in names]
    assert got == list(want)
    assert abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-4
    # the blocks' token ids are those of the documents
    for r in mixing.tokens_of(mixed.where("shard = 0"), docs).collect()[:50]:
        x = next(y for y in rows if (y.shard, y.slot) == (r.shard, r.slot))
        assert r.tokens == [t for s in x.spans for t in mixing.encode(text[s.doc_id])[s.first : s.stop]]
    again = {tuple(map(str, r)) for r in mixing.mixture(docs, targets, block_tokens=64, shard_slots=50)[0].collect()}
    assert again == {tuple(map(str, r)) for r in rows}


def test_nulls_long_texts_and_empty(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000, " A "), (2, None, "a"), (3, "", "a"), (4, "x y z", None), (5, "b b b", "B"), (5, "b b b", "b")], "doc_id long, text string, source string").selectExpr("*", "1 as block", "2 as n_tokens")
    targets = spark.createDataFrame([("A", 0.5, 1), ("b", 0.3, 3), ("none", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeat int")
    mixed, report = mixing.mixture(docs, targets, total_tokens=10**6)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"a", "b", "none", ""} and rep["none"].used_tokens == 0 and rep[""].n_docs == 1 and rep["b"].most_used <= 3
    assert rep["a"].n_tokens == len(mixing.encode("word " * 60_000)) == rep["a"].used_tokens
    empty, report = mixing.mixture(docs.limit(0), targets)
    assert empty.count() == 0 and report.count() == 3 and mixing.mixture(docs, targets.limit(0))[0].count() == 0
