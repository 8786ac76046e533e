"""What depends on the running session: shared folder, checkpoints, table loading, salted joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode without that setting, a temporary folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    known = sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="screenloom-")
    sc.setCheckpointDir(where)
    return where


#: Setting under which a query's shuffle files go when it has ended, not when the driver happens to collect its garbage.
SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is planned in here leaves no shuffle files behind: for jobs whose result is written or collected."""
    before = spark.conf.get(SHORT_SHUFFLES, "false")
    spark.conf.set(SHORT_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHORT_SHUFFLES, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage; survives the loss of executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    with short_shuffles(spark):
        return df.select("*").checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Kept:
    """Tables between the steps of one job, in the shared folder: they cut the lineage as checkpoints do, but are
    compressed and go as soon as the job drops them, at its end at the latest. Nothing lazy may outlive them."""

    #: Keys hardly repeat, so dictionaries only take memory, and so do large pages.
    SMALL_PAGES = {"parquet.enable.dictionary": "false", "parquet.page.size": str(128 << 10), "parquet.block.size": str(32 << 20)}

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Kept:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, "kept")
        self.paths.append((df, path))  # what a broken write leaves goes, too
        with short_shuffles(self.spark):
            df.write.options(**self.SMALL_PAGES).parquet(path, compression="zstd")
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[-1] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df, path in self.paths:
            if any(df is t for t in tables):
                remove(self.spark, path)
        self.paths = [x for x in self.paths if not any(x[0] is t for t in tables)]

    def __exit__(self, *_: object) -> None:
        self.drop(*[df for df, _ in self.paths])


#: Rows of one key that a task takes without more ado, and keys that can be hot at once (see _hot).
HOT_ROWS, MOST_HOT = 100_000, 10_000


def _hot(sides: list[DataFrame], keys: list[str], per_task: int) -> DataFrame | None:
    """(keys, _p0, _p1...): into how many pieces each side cuts its rows of a hot key; None if no key is hot.

    Hot are all keys of more than per_task rows of a side, or more than one MOST_HOT-th of its rows if that is more: a
    share of which there can't be more than MOST_HOT, so the table is of bounded size however large the sides are.
    """
    counts = [df.groupBy(*keys).agg(F.count("*").alias("_n")) for df in sides]
    with short_shuffles(sides[0].sparkSession):
        sums = None
        for i, c in enumerate(counts):
            one = c.agg(F.lit(i).alias("i"), F.max("_n").alias("most"), F.sum("_n").alias("total"))
            sums = one if sums is None else sums.unionByName(one)
        seen = {r.i: (r.most or 0, r.total or 0) for r in sums.select("*").collect()}
    if all(most <= per_task for most, _ in seen.values()):
        return None
    out = None
    for i, c in enumerate(counts):
        least = max(per_task, seen[i][1] // MOST_HOT)
        part = c.where(F.col("_n") > least).select(*keys, F.ceil(F.col("_n") / per_task).cast("int").alias(f"_p{i}"))
        out = part if out is None else out.join(part, keys, "full")
    with short_shuffles(sides[0].sparkSession):
        found = out.dropna(subset=keys).collect()  # at most MOST_HOT a side
    return F.broadcast(sides[0].sparkSession.createDataFrame(found, out.schema)) if found else None


def _pieces(n: str) -> Column:
    return F.coalesce(F.col(n), F.lit(1))


def _here(df: DataFrame, n: Column) -> Column:
    """A piece for each row, the same when a task is run again. Maps can't be hashed and don't take part."""
    return F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if f.dataType.typeName() != "map"]), n).cast("int")


def _everywhere(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """left joined with right, whose keys are unique, without gathering a hot key's rows of left in one task: they are
    cut in pieces, and the row of right goes to each piece.

    counted: a frame with the keys and as many rows as left that is cheaper to count. how: inner, left, left_semi or
    left_anti. Rows of left with a null key meet nothing; where they are hot, they are spread, too.
    """
    hot = _hot([counted if counted is not None else left], keys, HOT_ROWS)
    if hot is None:
        return left.join(right, keys, how)
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    a = left.join(hot, keys, "left").select(*left.columns, _here(left, F.when(none, 1000).otherwise(_pieces("_p0"))).alias("_salt"))
    b = right.join(hot, keys, "left").select(*right.columns, _everywhere(_pieces("_p0")).alias("_salt"))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], per_task: int = 5_000) -> DataFrame:
    """Inner join of two sides that may both have hot keys. The rows of a hot key are laid out as a grid: each side is
    cut in pieces of about per_task rows, and every pair of pieces meets in a task of its own."""
    hot = _hot([left.select(*keys), right.select(*keys)], keys, per_task)
    if hot is None:
        return left.join(right, keys)
    one = _pieces("_p0"), _pieces("_p1")
    a = left.join(hot, keys, "left").select(*left.columns, _here(left, one[0]).alias("_sl"), _everywhere(one[1]).alias("_sr"))
    b = right.join(hot, keys, "left").select(*right.columns, _here(right, one[1]).alias("_sr"), _everywhere(one[0]).alias("_sl"))
    return a.join(b, [*keys, "_sl", "_sr"]).drop("_sl", "_sr")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder of the shared folder, deleted with all in it."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there whole or not at all."""
    fs, where = _file_system(spark, path)
    half = spark._jvm.org.apache.hadoop.fs.Path(path + ".half")
    out = fs.create(half, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(half, where):
        raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is no such file."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return None
    file = fs.open(where)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    file.close()
    return text
