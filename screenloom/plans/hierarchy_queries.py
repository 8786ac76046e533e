"""Queries and SQL of problem 3 over lc_screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy
from ..session import table


def _placed(spark: SparkSession, sf_dir: str, with_paths: bool = True) -> DataFrame:
    screens = table(spark, sf_dir, "lc_screens")
    return hierarchy.hierarchy(hierarchy.nodes(screens, "session_id", "fingerprint", "parent_fp", "depth", "id"), with_paths=with_paths)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir, with_paths=False)
    wrong = (F.col("status") == hierarchy.TREE) & ~F.col("root_linked") & (F.col("stored_depth") != F.col("depth"))
    finding = F.when(F.col("status") != hierarchy.TREE, F.col("status")).when(wrong, F.lit("wrong_depth"))
    return placed.select(F.col("scope").alias("session_id"), F.col("node").alias("fingerprint"), finding.alias("finding")).where("finding is not null")


def p3_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select(F.col("scope").alias("session_id"), F.col("node").alias("fingerprint"), "status", F.col("root").alias("root_fp"), F.coalesce(F.col("depth").cast("long"), F.lit(-1)).alias("tree_depth"), F.array_join("path", "/").alias("path"), F.coalesce("n_descendants", F.lit(-1)).alias("n_descendants"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_placed(spark, sf_dir)).select(F.col("scope").alias("session_id"), F.col("node").alias("fingerprint"), "descendant", F.col("distance").cast("long").alias("distance"))


QUERIES = {"p3_found": p3_found, "p3_tree": p3_tree, "p3_descendants": p3_descendants}

_TREES = """
WITH RECURSIVE n AS (SELECT session_id, fingerprint, min(id) AS id FROM lc_screens WHERE session_id IS NOT NULL AND fingerprint IS NOT NULL GROUP BY ALL),
f AS (SELECT n.session_id, n.fingerprint, nullif(s.parent_fp, '') AS link, s.depth AS stored FROM n JOIN lc_screens s USING (id)),
e AS (SELECT f.session_id, f.fingerprint, f.link, f.stored, p.fingerprint AS parent FROM f LEFT JOIN f p ON p.session_id = f.session_id AND p.fingerprint = f.link),
t AS (SELECT session_id, fingerprint, fingerprint AS root_fp, link IS NOT NULL AS root_linked, CAST(0 AS BIGINT) AS d, stored, fingerprint AS path FROM e WHERE parent IS NULL
  UNION ALL SELECT e.session_id, e.fingerprint, t.root_fp, t.root_linked, t.d + 1, e.stored, t.path || '/' || e.fingerprint FROM t JOIN e ON e.session_id = t.session_id AND e.parent = t.fingerprint),
r AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.session_id = e.session_id AND t.fingerprint = e.fingerprint)),
w AS (SELECT session_id, fingerprint AS origin, parent AS cur, 1 AS k FROM r
  UNION SELECT w.session_id, w.origin, r.parent, w.k + 1 FROM w JOIN r ON r.session_id = w.session_id AND r.fingerprint = w.cur WHERE w.k < (SELECT count(*) FROM r x WHERE x.session_id = w.session_id) AND w.cur <> w.origin),
c AS (SELECT DISTINCT session_id, origin AS fingerprint FROM w WHERE cur = origin)
"""

ORACLES = {
    "p3_found": _TREES + """SELECT session_id, fingerprint, 'wrong_depth' AS finding FROM t WHERE NOT root_linked AND stored <> d
UNION ALL SELECT r.session_id, r.fingerprint, CASE WHEN c.fingerprint IS NULL THEN 'below_cycle' ELSE 'cycle' END FROM r LEFT JOIN c USING (session_id, fingerprint)""",
    "p3_tree": _TREES + """, a AS (SELECT session_id, unnest(string_split(path, '/')[:-2]) AS fingerprint FROM t),
z AS (SELECT session_id, fingerprint, count(*) AS n FROM a GROUP BY ALL)
SELECT t.session_id, t.fingerprint, 'tree' AS status, root_fp, d AS tree_depth, path, coalesce(z.n, 0) AS n_descendants FROM t LEFT JOIN z USING (session_id, fingerprint)
UNION ALL SELECT r.session_id, r.fingerprint, CASE WHEN c.fingerprint IS NULL THEN 'below_cycle' ELSE 'cycle' END, NULL, -1, NULL, -1 FROM r LEFT JOIN c USING (session_id, fingerprint)""",
    "p3_descendants": _TREES + """, a AS (SELECT session_id, fingerprint AS descendant, d, unnest(string_split(path, '/')) AS fingerprint, unnest(range(d + 1)) AS lv FROM t)
SELECT session_id, fingerprint, descendant, d - lv AS distance FROM a WHERE lv < d""",
}
