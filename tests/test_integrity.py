from screenloom.operators import integrity

KIDS = "id long, fk string, import_batch int, t_p int, n_rows int"


def run(spark, kids, targets, **k):
    a = spark.createDataFrame([(*r, 0, 0) for r in kids], KIDS)
    b = spark.createDataFrame(targets, "pk string, import_batch int")
    args = (a, "id", ["fk"], "import_batch", b, ["pk"], "import_batch")
    found = sorted(((r.id, r.import_batch) for r in integrity.orphans(*args, **k).collect()), key=str)
    report = sorted(((-1 if r.import_batch is None else r.import_batch, r.n_refs, r.n_orphans, r.n_orphan_keys) for r in integrity.orphan_report(*args, **k).collect()), key=str)
    return found, report


def test_missing_late_null_and_blank(spark):
    kids = [(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, None, 1), (5, "", 1), (6, "b", 1), (7, "a", None), (8, "b", None), (6, "b", 1)]
    found, report = run(spark, kids, [("a", 2), ("a", 3), (None, 1)], blank_is_null=("fk",))
    assert found == sorted([(1, 1), (3, 1), (6, 1), (6, 1), (8, None)], key=str)
    assert report == [(-1, 2, 1, 1), (1, 4, 4, 2), (2, 1, 0, 0)]


def test_blank_key_counts_unless_named(spark):
    assert run(spark, [(5, "", 1)], [])[0] == [(5, 1)]


def test_empty_tables_and_hot_key(spark):
    assert run(spark, [], []) == ([], [])
    found, report = run(spark, [(i, "hot", 1) for i in range(3000)], [("x", 1)])
    assert len(found) == 3000 and report == [(1, 3000, 3000, 1)]


def test_deleted_targets(spark):
    t = spark.createDataFrame([(1,), (2,)], "id long")
    d = spark.createDataFrame([("t", "1"), ("u", "2"), ("t", None)], "table_name string, row_key string")
    assert [r.id for r in integrity.live(t, "id", d, "t").collect()] == [2]
