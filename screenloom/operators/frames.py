"""Sequences of frames per key: change, islands of no change, stuck, stalled and watched states, settling.

Batch forms, as windows over (key; ts, id). A null signal counts as no reading: the change to it is unknown and so a
change. Ties of ts are ordered by id. One task sorts a key's frames, on disk if need
be: a state that runs through all of them can't be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Distance of a frame without predecessor.
NO_FRAME = 999


def order(key: str, ts: str = "ts", row: str = "id") -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts, row)


def distance_to_last(value: Column, w: WindowSpec) -> Column:
    """Absolute difference to the frame before; NO_FRAME for the first."""
    return F.coalesce(F.abs(value - F.lag(value).over(w)), F.lit(NO_FRAME))


def islands(df: DataFrame, changed: Column, w: WindowSpec) -> DataFrame:
    """df with island (number of changes so far), unchanged (frames since the last change, W2), since (its ts, W3)."""
    island = F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"island": island, "_changed": changed, "since": F.last(F.when(changed, F.col("ts")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.max(F.when(F.col("_changed"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_n", F.row_number().over(w)).withColumn("unchanged", F.col("_n") - F.coalesce(start, F.lit(1))).drop("_changed", "_n")


def stuck_level(count: Column, threshold: int = 2) -> Column:
    """What a count of dead ends calls for."""
    return F.when(count >= 3 * threshold, "hopeless").when(count >= 2 * threshold, "swipe+long_press").when(count >= threshold, "swipe").otherwise("none")


def running_count(df: DataFrame, event: Column, reset: Column, w: WindowSpec, out: str = "count") -> DataFrame:
    """df with the number of events since the last reset, the present row included."""
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_total", F.sum(F.when(event, 1).otherwise(0)).over(up_to)).withColumn("_at", F.when(reset, F.col("_total")))
    return df.withColumn(out, F.col("_total") - F.coalesce(F.last("_at", ignorenulls=True).over(up_to), F.lit(0))).drop("_total", "_at")


def forced(unchanged: Column, after: int = 3) -> Column:
    """A look is forced after so many frames without change."""
    return unchanged >= after


def stall_state(seconds: Column, warn: int = 20, fatal: int = 40) -> Column:
    """State of a stall by its length (T4)."""
    return F.when(seconds >= fatal, "fatal").when(seconds >= warn, "corner_action").otherwise("ok")


def watchdog(seconds: Column, last_action: Column, exempt: list[str], limit: int = 600) -> Column:
    """Whether the watchdog bites: too long without change and no exempt action (T5)."""
    return (seconds >= limit) & ~F.coalesce(last_action.isin(exempt), F.lit(False))


def recoveries(df: DataFrame, bites: Column, w: WindowSpec, most: int = 3) -> DataFrame:
    """df with recovery: the number of the attempt that a bite calls for, null where none is made, as after `most` attempts
    the watchdog gives up (T5). An attempt is made where a bite begins."""
    begins = bites & ~F.coalesce(F.lag(bites).over(w), F.lit(False))
    df = df.withColumn("_begins", begins)
    n = F.sum(F.when(F.col("_begins"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("recovery", F.when(F.col("_begins") & (n <= most), n)).drop("_begins")


def lit_islands(df: DataFrame, brightness: Column, dark: float, changed, w: WindowSpec, partition: str) -> DataFrame:
    """Islands of no change among the frames that aren't dark; dark frames are skipped and break them (T6). changed(w): the
    condition of a change within a window; a frame after a dark one has no predecessor. A null brightness is not dark."""
    is_dark = F.coalesce(brightness <= dark, F.lit(False))
    df = df.withColumn("_dark", is_dark).withColumn("lit", F.sum(F.when(F.col("_dark"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(partition, "lit").orderBy("ts", "id")
    return islands(df.where("not _dark").drop("_dark"), changed(inner), inner)


def found_within(df: DataFrame, key: str, hit: Column, y: Column, low: float, high: float, tries: int = 5) -> DataFrame:
    """(key, attempt): the first of the first tries of each key at which a keyword is seen within a band of y, its lower
    edge included; null if at none (T12)."""
    n = df.withColumn("attempt", F.row_number().over(order(key)))
    ok = hit & (y >= low) & (y < high) & (F.col("attempt") <= tries)
    return n.groupBy(key).agg(F.min(F.when(ok, F.col("attempt"))).alias("attempt"))


def least_distance(distances: Column, none: int = NO_FRAME) -> Column:
    """Least of an array of distances; NO_FRAME for none."""
    return F.coalesce(F.array_min(distances), F.lit(none))


def near_runs(df: DataFrame, x: str, y: str, w: WindowSpec, radius: int = 50) -> DataFrame:
    """df with run: how many frames in a row lie within radius of the one before."""
    near = (F.abs(F.col(x) - F.lag(x).over(w)) <= radius) & (F.abs(F.col(y) - F.lag(y).over(w)) <= radius)
    df = df.withColumn("_far", ~F.coalesce(near, F.lit(False))).withColumn("_n", F.row_number().over(w))
    start = F.max(F.when(F.col("_far"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("run", F.col("_n") - start + 1).drop("_far", "_n")


def settled(df: DataFrame, distance: Column, key: str, limit: float, timeout: str) -> DataFrame:
    """(key, settled_at): of each key the first frame at most `limit` from the one before, within the timeout of the
    first frame; null if none (T1, T12)."""
    w = order(key)
    seen = df.withColumn("_d", distance).withColumn("_start", F.min("ts").over(Window.partitionBy(key))).withColumn("_lag", F.lag("ts").over(w))
    hit = F.col("_lag").isNotNull() & (F.col("_d") <= limit) & (F.col("ts") <= F.col("_start") + F.expr(f"INTERVAL {timeout}"))
    return seen.groupBy(key).agg(F.min(F.when(hit, F.col("ts"))).alias("settled_at"))


def most_recent(df: DataFrame, key: str, place: list[str], n: int = 5) -> DataFrame:
    """The n most recent distinct places of each key, the latest row of each (W8, W9). rank is 1 for the newest."""
    latest = df.groupBy(key, *place).agg(F.max(F.struct("ts", "id")).alias("l"))
    return latest.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("l.ts"), F.desc("l.id")))).where(F.col("rank") <= n).select(key, *place, F.col("l.ts").alias("ts"), F.col("l.id").alias("id"), "rank")


def every_nth(df: DataFrame, w: WindowSpec, n: int) -> DataFrame:
    """Each n-th row."""
    return df.withColumn("seq", F.row_number().over(w)).where(F.col("seq") % n == 0)


def cycle_phase(n: Column) -> Column:
    """Whether a wait of n rounds calls for an action: every fourth from the eighth on."""
    return (n >= 8) & F.pmod(n - 8, F.lit(8)).isin(0, 4)


def rapid(distance: Column, last_action: Column, tap: str = "STORY_TAP") -> Column:
    """Fast lane of a dialogue: a tap before and a middling change."""
    return F.coalesce((last_action == tap) & distance.between(5, 25), F.lit(False))


def verified(df: DataFrame, key: str, action: str, signal: str, least: float = 5) -> DataFrame:
    """(action, success_count, failure_count, last_seen): did the next frame change (T8, A15)? Last frames don't count."""
    w = order(key)
    after = df.withColumn("_next", F.lead(signal).over(w)).where("_next is not null")
    moved = F.abs(F.col("_next") - F.col(signal)) >= least
    return after.groupBy(action).agg(F.count_if(moved).alias("success_count"), F.count_if(~moved).alias("failure_count"), F.max("ts").alias("last_seen"))


def fallback_due(no_change: Column, every: int = 6) -> Column:
    """Counter that starts again after `every`."""
    return F.pmod(no_change, F.lit(every)) == 0


def first_success(df: DataFrame, key: str, ok: Column, tries: int) -> DataFrame:
    """(key, attempt, id): the first success among the first tries of each key."""
    return df.withColumn("attempt", F.row_number().over(order(key))).where((F.col("attempt") <= tries) & ok).groupBy(key).agg(F.min(F.struct("attempt", "id")).alias("m")).select(key, F.col("m.attempt").alias("attempt"), F.col("m.id").alias("id"))


def within_budget(df: DataFrame, key: str, budget: str) -> DataFrame:
    """Frames before a time budget from each key's first frame is used up."""
    start = df.groupBy(key).agg(F.min("ts").alias("_start"))
    return df.join(start, key).where(F.col("ts") < F.col("_start") + F.expr(f"INTERVAL {budget}")).drop("_start")
