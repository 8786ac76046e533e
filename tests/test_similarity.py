import random

import pytest

from screenloom.operators import components, similarity

SIGNED = lambda x: x - (1 << 64) if x >> 63 else x


def near_hashes(g, n):
    base = [g.getrandbits(64) for _ in range(n)]
    out = set(base)
    for b in base:
        for _ in range(3):
            x = b
            for i in g.sample(range(64), g.randrange(0, 11)):
                x ^= 1 << i
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("below", "bands"), [(1, None), (5, 2), (8, None), (8, 3), (8, 4), (8, 5), (8, 7), (10, None), (16, None), (16, 6)])
def test_pairs_equal_brute_force(spark, below, bands):
    hs = near_hashes(random.Random(below), 60)
    want = {(min(SIGNED(a), SIGNED(b)), max(SIGNED(a), SIGNED(b))) for i, a in enumerate(hs) for b in hs[:i] if (a ^ b).bit_count() < below}
    df = spark.createDataFrame([(SIGNED(h), 1, 2) for h in hs] * 2 + [(None, 1, 2)], "h long, a int, key int")
    assert {(r.a, r.b) for r in similarity.hamming_pairs(df, below, bands).collect()} == want


def test_bits_of(spark):
    df = spark.createDataFrame([("ffffFFFFffffFFFF",), ("0000000000000001",), ("xyz",), ("",), (None,), ("00000000000000010",)], "p string")
    assert [r[0] for r in df.select(similarity.bits_of("p")).collect()] == [-1, 1, None, None, None, None]


def test_hot_bucket_is_split(spark, monkeypatch):
    from screenloom import session

    g = random.Random(5)
    hs = [g.getrandbits(48) for _ in range(300)] + [x ^ 3 for x in range(50)]
    monkeypatch.setattr(similarity, "split_join", lambda a, b, k: session.split_join(a, b, k, per_task=20))
    want = {(min(a, b), max(a, b)) for i, a in enumerate(set(hs)) for b in list(set(hs))[:i] if (a ^ b).bit_count() < 8}
    got = similarity.hamming_pairs(spark.createDataFrame([(h,) for h in hs], "h long"), 8)
    assert {(r.a, r.b) for r in got.collect()} == want


@pytest.mark.parametrize(("below", "bands", "piece"), [(1, None, 9), (4, None, 10**6), (8, None, 10**6), (8, 8, 10**6), (8, 9, 7), (8, 10, 10**6), (8, 11, 30), (8, None, 1)])
def test_near_pairs_equal_brute_force(spark, monkeypatch, below, bands, piece):
    """Each pair once, whatever the bands, and with cells cut in pieces."""
    monkeypatch.setattr(similarity, "PIECE", piece)
    g = random.Random(below)
    hs = sorted({*near_hashes(g, 40), *(x ^ 5 for x in range(40)), (1 << 64) - 1, 1 << 63})
    want = {(min(SIGNED(a), SIGNED(b)), max(SIGNED(a), SIGNED(b))) for i, a in enumerate(hs) for b in hs[:i] if (a ^ b).bit_count() < below}
    got = [tuple(r) for r in similarity.near_pairs(spark.createDataFrame([(SIGNED(h),) for h in hs] + [(None,)], "h long"), below, bands).collect()]
    assert set(got) == want and len(got) == len(want)


def test_hash_is_moved_a_few_times(spark):
    """Rows of the exchange to the cells: one for each band that can be the first in common, not one for each question."""
    assert max(similarity.shared_bands_for(n, 8) for n in (100, 10**5, 10**7, 10**9)) <= 13
    assert similarity.near_pairs(spark.createDataFrame([], "h long"), 8).count() == 0


def test_bands_follow_the_number_of_hashes():
    assert [similarity.bands_for(n, 8) for n in (100, 2_000, 200_000, 10**7, 10**10)] == [8, 5, 4, 3, 2]


def brute(edges):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("few", [components.FEW, 100, 0])
def test_components(spark, monkeypatch, few):
    """In one task at once, after some rounds, and by rounds alone."""
    monkeypatch.setattr(components, "FEW", few)
    g = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, 500 + i) for i in range(1, 60)] + [(g.randrange(1000, 1200), g.randrange(1000, 1200)) for _ in range(90)] + [(7, 7), (9, 8), (8, 9)]
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long")
    assert {r.node: r.component for r in components.components(df).collect()} == brute(edges)


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert similarity.hamming_pairs(spark.createDataFrame([], "h long"), 8).count() == 0
