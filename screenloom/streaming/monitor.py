"""Structured Streaming forms of the frame operators (T1-T6): a keyed state machine and windowed counts.

monitor() is the state machine: for each frame of a key, in order of (ts, id), the distance to the last frame, the number
of frames without change, dead ends since the last reset, and the stall and watchdog states. One frame is the state.
Frames later than the watermark are dropped; a key that is silent for `idle` gives an 'idle' row and is forgotten.
Batch forms in operators/frames.py give the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key long, id long, ts timestamp, dist double, unchanged int, dead_ends int, stall string"
STATE = "value double, seen boolean, unchanged int, dead_ends int, since long, last long"


def machine(change: float = 5.0, warn: int = 7200, fatal: int = 14400, dead: str = "error", reset: str = "purchase", idle_ms: int | None = None):
    """The function that applyInPandasWithState runs per key and batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "id": [-1], "ts": [pd.Timestamp(last[5], unit="us")], "dist": [0.0], "unchanged": [last[2]], "dead_ends": [last[3]], "stall": ["idle"]})
            return
        value, seen, unchanged, dead_ends, since, last_us = state.get if state.exists else (0.0, False, 0, 0, 0, 0)
        new = pd.concat(list(frames)).sort_values(["ts", "id"])
        out = []
        for r in new.itertuples(index=False):
            us = r.ts.value // 1000
            dist = abs(r.value - value) if seen else 999.0
            if dist >= change:
                unchanged, since = 0, us
            else:
                unchanged += 1
            if r.action == reset:
                dead_ends = 0
            dead_ends += r.action == dead
            stalled = (us - since) / 1e6
            out.append((key[0], r.id, r.ts, dist, unchanged, dead_ends, "fatal" if stalled >= fatal else "corner_action" if stalled >= warn else "ok"))
            value, seen, last_us = r.value, True, us
        state.update((float(value), True, int(unchanged), int(dead_ends), int(since), int(last_us)))
        if idle_ms:
            state.setTimeoutTimestamp(max(last_us // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["key", "id", "ts", "dist", "unchanged", "dead_ends", "stall"])

    return step


def monitor(frames: DataFrame, watermark: str = "1 hour", idle_ms: int | None = None, **rules) -> DataFrame:
    """Stream of states. frames: stream of key long, id long, ts timestamp, value double, action string."""
    timeout = GroupStateTimeout.EventTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return frames.withWatermark("ts", watermark).groupBy("key").applyInPandasWithState(machine(idle_ms=idle_ms, **rules), OUT, STATE, "append", timeout)


def action_counts(frames: DataFrame, size: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Frames and distinct-free sums per action and time window; late frames within the watermark still count."""
    return frames.withWatermark("ts", watermark).groupBy(F.window("ts", size), "action").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(frames: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions of a key by gaps (an extension)."""
    return frames.withWatermark("ts", watermark).groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def first_sightings(screens: DataFrame, watermark: str = "7 days") -> DataFrame:
    """The first row of each (session_id, fingerprint) of a stream (D8), known for the time of the watermark."""
    return screens.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "fingerprint"])


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """foreachBatch sink that appends only keys the table at path lacks, so that a batch run again adds nothing (M5)."""
    new = batch.dropDuplicates(keys)
    try:
        known = batch.sparkSession.read.parquet(path).select(*keys)
        new = new.join(known, keys, "left_anti")
    except Exception as e:  # the table isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)
