"""References to records that do not exist: orphans of a foreign key, per table and period.

Null keys refer to nothing and are never orphans; '' does neither in the columns named in blank_is_null. A null period of a child stands for the end of time (any target has
arrived by then); a target with a null period arrives only at the end of time. Repeated child rows are each reported,
repeated target rows count once, with their earliest period. Empty inputs give empty results. Columns other than those
named are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import hot_join

#: Stands for a period that is not known.
END_OF_TIME = 2**62


def _period(batch: str) -> Column:
    return F.coalesce(F.col(batch).cast("long"), F.lit(END_OF_TIME))


def live(targets: DataFrame, key: str, deletions: DataFrame, table_name: str) -> DataFrame:
    """Rows of targets whose key, as text, the deletion log doesn't list for that table."""
    gone = deletions.where(F.col("table_name") == table_name).select(F.col("row_key").alias("_gone")).where("_gone is not null").distinct()
    return targets.join(gone, targets[key].cast("string") == gone["_gone"], "left_anti")


def _keys(children: DataFrame, fk: list[str], blank_is_null: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    names = [f"_k{i}" for i in range(len(fk))]
    refers = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in fk))
    for k in blank_is_null:
        refers &= F.col(k) != ""
    return children.where(refers).select(*[F.col(k).alias(n) for k, n in zip(fk, names)], _period("_batch").alias("_p"), "_id", "_batch"), names


def _orphan_keys(refs: DataFrame, names: list[str], targets: DataFrame, pk: list[str], target_batch: str) -> DataFrame:
    """(key, period, rows): keys are made distinct before any join, so that a hot key is one row per period."""
    distinct = refs.groupBy(*names, "_p").agg(F.count("*").alias("n_rows"))
    first = targets.select(*[F.col(k).alias(f"t{n}") for k, n in zip(pk, names)], _period(target_batch).alias("t_p")).groupBy(*[f"t{n}" for n in names]).agg(F.min("t_p").alias("t_p"))
    same = reduce(lambda a, b: a & b, (distinct[n] == first[f"t{n}"] for n in names))
    return distinct.join(first, same & (first["t_p"] <= distinct["_p"]), "left_anti")


def orphans(children: DataFrame, row_id: str, fk: list[str], batch: str, targets: DataFrame, pk: list[str], target_batch: str, *, blank_is_null: tuple[str, ...] = ()) -> DataFrame:
    """(id, import_batch) of the child rows whose key no target has that arrived in or before the row's own period.

    Distinct keys are anti-joined with the targets' distinct keys; the orphan keys are joined back to the rows, those of
    a hot key in pieces by its counted size.
    """
    refs, names = _keys(children.withColumns({"_batch": F.col(batch), "_id": F.col(row_id)}), fk, blank_is_null)
    keys = _orphan_keys(refs, names, targets, pk, target_batch).drop("n_rows")
    return hot_join(refs, keys, [*names, "_p"], "left_semi").select(F.col("_id").alias("id"), F.col("_batch").cast("long").alias("import_batch"))


def orphan_report(children: DataFrame, row_id: str, fk: list[str], batch: str, targets: DataFrame, pk: list[str], target_batch: str, *, blank_is_null: tuple[str, ...] = ()) -> DataFrame:
    """(import_batch, n_refs, n_orphans, n_orphan_keys) per period, from the pre-aggregated keys alone."""
    refs, names = _keys(children.withColumns({"_batch": F.col(batch), "_id": F.col(row_id)}), fk, blank_is_null)
    bad = _orphan_keys(refs, names, targets, pk, target_batch).groupBy("_p").agg(F.sum("n_rows").alias("n_orphans"), F.count("*").alias("n_orphan_keys"))
    total = refs.groupBy("_p").agg(F.count("*").alias("n_refs"))
    joined = total.join(bad, "_p", "left")
    return joined.select(F.when(F.col("_p") < END_OF_TIME, F.col("_p")).alias("import_batch"), "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_orphan_keys", F.lit(0)).alias("n_orphan_keys"))
