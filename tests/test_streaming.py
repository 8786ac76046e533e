"""A stream in several files gives what the batch gives; state survives between batches."""

import datetime as dt

from pyspark.sql import functions as F

from screenloom.operators import frames
from screenloom.streaming import monitor

SCHEMA = "key long, id long, ts timestamp, value double, action string"


def rows():
    t = dt.datetime(2026, 1, 1)
    values = [10.0, 11.0, 30.0, 31.0, 31.0, 60.0, 61.0, 61.0]
    acts = ["x", "error", "error", "purchase", "error", "x", "error", "error"]
    return [(k, 100 * k + i, t + dt.timedelta(minutes=50 * i), v + k, a) for k in (1, 2) for i, (v, a) in enumerate(zip(values, acts))]


def run(spark, stream, path, mode="append"):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def test_stream_equals_batch(spark, tmp_path):
    data = rows()
    for n in range(4):  # four files of two frames a key, in order of time
        part = [r for r in data if (r[1] % 100) // 2 == n]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    got = {r.id: (r.dist, r.unchanged, r.dead_ends, r.stall) for r in run(spark, monitor.monitor(src, "30 days"), tmp_path / "m").collect()}
    df = spark.createDataFrame(data, SCHEMA)
    w = frames.order("key")
    b = frames.islands(df.withColumn("dist", frames.distance_to_last(F.col("value"), w).cast("double")), F.col("dist") >= 5, w)
    b = frames.running_count(b, F.col("action") == "error", F.col("action") == "purchase", w, "dead_ends")
    b = b.withColumn("stall", frames.stall_state(F.unix_seconds("ts") - F.unix_seconds("since"), 7200, 14400))
    assert got == {r.id: (r.dist, r.unchanged, r.dead_ends, r.stall) for r in b.collect()} and len(got) == 16


def test_first_sightings_and_append(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    s = "session_id string, fingerprint string, ts timestamp"
    spark.createDataFrame([("a", "f", t), ("a", "f", t), ("a", "g", t)], s).write.parquet(f"{tmp_path}/in")
    stream = monitor.first_sightings(spark.readStream.schema(s).parquet(f"{tmp_path}/in"))
    assert run(spark, stream, tmp_path / "f").count() == 2
    batch = spark.createDataFrame([("a", "f"), ("a", "g"), ("a", "g")], "session_id string, fingerprint string")
    for _ in range(2):
        monitor.append_new(batch, f"{tmp_path}/table", ["session_id", "fingerprint"])
    assert spark.read.parquet(f"{tmp_path}/table").count() == 2
