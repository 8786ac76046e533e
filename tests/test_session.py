"""Joins that split hot keys give what plain joins give."""

import pytest

from screenloom import session


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join(spark, monkeypatch, how):
    monkeypatch.setattr(session, "HOT_ROWS", 20)
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 9}" if i % 3 else None, i) for i in range(200)] + [("lost", i) for i in range(50)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(5))], "k string, w int")
    assert rows(session.hot_join(left, right, ["k"], how)) == rows(left.join(right, "k", how))
    assert rows(session.hot_join(left, right, ["k"], how, counted=left.select("k"))) == rows(left.join(right, "k", how))
    assert rows(session.hot_join(left.limit(0), right, ["k"], how)) == []
    monkeypatch.setattr(session, "MOST_HOT", 3)  # then only keys of over a third of the rows are hot
    assert rows(session.hot_join(left, right, ["k"], how)) == rows(left.join(right, "k", how))


def test_split_join(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 9}", i) for i in range(200)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(90)] + [("big", i) for i in range(40)], "k string, w int")
    assert rows(session.split_join(left, right, ["k"], per_task=7)) == rows(left.join(right, "k"))
    assert session.split_join(left.limit(0), right, ["k"], per_task=7).count() == 0


def test_shared_dir_is_the_sessions(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.shared_path(spark, "x") != session.shared_path(spark, "x")


def test_small_files(spark):
    at = session.shared_path(spark, "note")
    assert session.read_text(spark, at) is None
    for text in ("one", "zwei ü 三"):
        session.write_text(spark, at, text)
        assert session.read_text(spark, at) == text
    session.remove(spark, at)
    assert session.read_text(spark, at) is None
