"""Upserts, conditional inserts, migrations, counters and cascades as joins of state and batch (A12, J18, M1-M11, U1-U2, U5-U6, X3 of the inventory).

State and batch are DataFrames; each function returns the new state or the rows to append. Tables may be empty; null
keys are never equal to anything and are appended as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def fold_visits(events: DataFrame, keys: list[str], name: str, ts: str, row: str) -> DataFrame:
    """State of an upsert log: visits, first and last time, first name that isn't empty."""
    filled = F.nullif(F.col(name), F.lit(""))
    return events.groupBy(*keys).agg(F.count("*").alias("visited_count"), F.min(ts).alias("first_seen_at"), F.max(ts).alias("last_seen_at"), F.min(F.when(filled.isNotNull(), F.struct(ts, row, filled.alias("v")))).alias("_n")).withColumn("name", F.col("_n.v")).drop("_n")


def upsert_visits(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """State and a folded batch become one: visits add up, the first name stays (M1)."""
    new = batch.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("visited_count", "first_seen_at", "last_seen_at", "name")])
    both = state.join(new, keys, "full")
    return both.select(*keys, (F.coalesce("visited_count", F.lit(0)) + F.coalesce("_visited_count", F.lit(0))).alias("visited_count"), F.least("first_seen_at", "_first_seen_at").alias("first_seen_at"), F.greatest("last_seen_at", "_last_seen_at").alias("last_seen_at"), F.coalesce(F.nullif("name", F.lit("")), "_name").alias("name"))


def first_of(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row of each key by position (W6, D8). Partial aggregation, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys and c != pos]
    return df.groupBy(*keys).agg(F.min_by(F.struct(F.col(pos), *rest), pos).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of all sources; of a key that several have, only the first source's."""
    tagged = [s.withColumn("_from", F.lit(i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    best = union.groupBy(key).agg(F.min("_from").alias("_from"))
    return union.join(best, [key, "_from"], "left_semi").drop("_from")


def insert_ignore(state: DataFrame, batch: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Rows of the batch to append: the first of each key that the state lacks (M3, M4, M5)."""
    return first_of(batch, keys, pos).join(state.select(*keys).distinct(), keys, "left_anti")


def with_ids(new: DataFrame, state: DataFrame, row_id: str, order: str) -> DataFrame:
    """new with ids that go on from the state's greatest, in the given order (M3). Numbers come from range partitions
    and their sizes, not from one task."""
    start = state.agg(F.coalesce(F.max(row_id), F.lit(0)).alias("m")).first()["m"]
    # written down, so that the sizes and the numbers come from the same division into ranges
    parts = checkpoint(new.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_c"))
    begin = counts.withColumn("_b", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).drop("_c")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("_l", local).join(F.broadcast(begin), "_part").withColumn(row_id, F.lit(start) + F.col("_b") + F.col("_l")).drop("_part", "_l", "_b")


def migrate(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """df with every named column: missing ones are added, null ones filled with the default (M7). columns: name -> (type, default)."""
    for c, (kind, default) in columns.items():
        value = F.lit(default).cast(kind)
        df = df.withColumn(c, F.coalesce(F.col(c), value) if c in df.columns and default is not None else value if c not in df.columns else F.col(c))
    return df


def without(children: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Children of records that are gone, taken out (M8)."""
    return children.join(gone.select(F.col(gone.columns[0]).alias(key)).distinct(), key, "left_anti")


def nulled(children: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Children whose key is gone keep their row and lose the key (M8)."""
    lost = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
    return children.join(lost, children[key] == lost["_gone"], "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def add_hits(state: DataFrame, hits: DataFrame, key: str, counter: str = "hit_count") -> DataFrame:
    """Counters with a batch of hits added; unknown keys are ignored (M9)."""
    n = hits.groupBy(key).agg(F.count("*").alias("_n"))
    return state.join(n, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def replace_keeping(state: DataFrame, batch: DataFrame, key: str, ts: str, kept: str) -> DataFrame:
    """Latest row of each key from the batch, else the state's; `kept` stays as the state has it."""
    cols = [c for c in state.columns if c not in (key, kept)]
    latest = batch.groupBy(key).agg(F.max_by(F.struct(*cols), ts).alias("_r"))
    both = state.join(latest, key, "full")
    return both.select(key, *[F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) for c in cols], F.coalesce(kept, F.lit(0)).alias(kept))


def set_status(state: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Sessions whose end is known become completed (M6). done: key, screens_found, ended_at."""
    d = done.select(key, F.col("screens_found").alias("_n"), F.col("ended_at").alias("_e"))
    return state.join(d, key, "left").withColumns({"status": F.when(F.col("_e").isNotNull(), "completed").otherwise(F.col("status")), "screens_found": F.coalesce("_n", "screens_found"), "ended_at": F.coalesce("_e", "ended_at")}).drop("_n", "_e")


def known(df: DataFrame, keys: list[str], seen: DataFrame, out: str = "known") -> DataFrame:
    """df with a flag for the rows whose key was seen before (U6). Null keys weren't."""
    s = seen.select(*keys).dropna().distinct().withColumn(out, F.lit(True))
    return df.join(s, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def teach(state: DataFrame, taught: DataFrame, key: str, ts: str, source: str = "human_solved") -> DataFrame:
    """State with taught actions: of each key the latest, in place of what was there, marked with its source; counters
    start anew (X3). taught: the columns of state but source."""
    cols = [c for c in state.columns if c not in (key, "source")]
    latest = taught.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(ts, *cols)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols], F.lit(source).alias("source"))
    return state.join(latest.select(key), key, "left_anti").unionByName(latest)


def owned_window(windows: DataFrame, key: str, candidates: list[str]) -> DataFrame:
    """(key, id, by): of each key's windows the one whose owner is a candidate, the first candidate first, else the first
    whose owner and title contain one, whatever their case; ties by id (J18)."""
    owner, both = F.lower(F.coalesce("owner", F.lit(""))), F.lower(F.concat_ws(" ", F.coalesce("owner", F.lit("")), F.coalesce("title", F.lit(""))))
    rank = F.coalesce(*[F.when(owner == c.lower(), F.lit(i)) for i, c in enumerate(candidates)])
    part = F.when(reduce(lambda a, b: a | b, (both.contains(c.lower()) for c in candidates)), F.lit(len(candidates)))
    best = F.min(F.struct(F.coalesce(rank, part).alias("r"), "id")).alias("b")
    return windows.where(F.coalesce(rank, part).isNotNull()).groupBy(key).agg(best).select(key, F.col("b.id").alias("id"), F.when(F.col("b.r") < len(candidates), "owner").otherwise("title").alias("by"))


def several_joined(texts: Column, sep: str = " / ") -> Column:
    """Texts of over one character, joined."""
    return F.array_join(F.filter(texts, lambda t: F.length(t) > 1), sep)


def joined_texts(items: DataFrame, key: str, text: str, pos: str, sep: str = " ") -> DataFrame:
    """Texts of a key in order, joined (A12). The result is one cell per key, so a key's texts meet in one task."""
    return items.where(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, text))), lambda x: x[text]), sep).alias("joined"))


def nms(boxes: DataFrame, keys: list[str], limit: float = 0.4) -> DataFrame:
    """Greedy non-maximum suppression per group (D5): by score, then id, a box is kept if its overlap with every box kept
    before is below the limit. boxes: keys, id, score, x, y, w, h.

    The choice runs through a group in order, so a group is one task's; groups are boxes of one image and template.
    """
    from ..functions.geometry import iou

    box = F.struct((-F.col("score")).alias("s"), "id", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    arr = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(box)).alias("b"))
    empty = F.filter("b", lambda _: F.lit(False))
    apart = lambda kept, x: ~F.exists(kept, lambda k: iou(k["x"], k["y"], k["w"], k["h"], x["x"], x["y"], x["w"], x["h"]) >= limit)
    kept = F.aggregate("b", empty, lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return arr.select(*keys, F.explode(kept).alias("_kept")).select(*keys, F.col("_kept.id").alias("id"))


def nth_rows(df: DataFrame, key: Column, n: int) -> DataFrame:
    """A repeatable sample of one row in n by key."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(n)) == 0)
