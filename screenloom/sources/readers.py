"""Sources (S1-S12): session summaries, discovery trees, knowledge bases, profiles, logs, JDBC tables, fallbacks.

JSON documents are read with fixed schemas; unknown keys are ignored, missing ones null. A document that can't be
parsed gives a row of nulls, which the functions here leave out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import by_priority
from . import schemas


def _documents(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("path", F.col("_metadata.file_path"))


def summaries(spark: SparkSession, evidence: str) -> DataFrame:
    """One row per session summary under evidence/*/ (S1), with its path. A file that can't be parsed is no session; see
    broken()."""
    return _documents(spark, f"{evidence}/*/crawl_summary.json", schemas.SUMMARY).where("session_id is not null")


def broken(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, document): files that hold no JSON, for a report beside what could be read."""
    files = spark.read.option("wholetext", True).text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    return files.where(F.get_json_object("document", "$").isNull())


def screens_of(summaries_: DataFrame) -> DataFrame:
    """(session_id, pos, path, screen fields) of every screen of the summaries, in document order."""
    return summaries_.select("session_id", "path", "game_title", "device_mode", F.posexplode(F.coalesce("screens", F.expr(f"cast(array() as array<struct<{_ddl(schemas.SCREEN)}>>)"))).alias("pos", "s")).select("session_id", "path", "game_title", "device_mode", "pos", "s.*")


def _ddl(fields: str) -> str:
    """Column list as fields of a struct type."""
    out, depth = [], 0
    part = ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return ", ".join(":".join(x.split(" ", 1)) for x in [*out, part.strip()])


def latest(documents: DataFrame, game_title: str | None = None) -> DataFrame:
    """The document of the greatest path, of one game if given."""
    own = documents if game_title is None else documents.where(F.col("game_title") == game_title)
    return own.orderBy(F.desc("path")).limit(1)


def trees(spark: SparkSession, pattern: str) -> DataFrame:
    """Discovery trees with their paths."""
    return _documents(spark, pattern, schemas.TREE).where("nodes is not null")


def tree_nodes(trees_: DataFrame) -> DataFrame:
    """(session_id, game_title, fingerprint, node fields): what a resumed session knows."""
    return trees_.select("session_id", "game_title", F.explode("nodes").alias("fingerprint", "n")).select("session_id", "game_title", "fingerprint", "n.*")


def tree_edges(trees_: DataFrame) -> DataFrame:
    """(session_id, pos, edge fields) of the transition logs."""
    return trees_.select("session_id", F.posexplode("edges").alias("pos", "e")).select("session_id", "pos", "e.*")


def knowledge(spark: SparkSession, folder: str, solved: str = "human_solved") -> DataFrame:
    """Solutions by hash (the file's name); those of the subfolder only where the folder has none."""
    parts = []
    for pattern in (f"{folder}/*.json", f"{folder}/{solved}/*.json"):
        try:
            df = _documents(spark, pattern, schemas.SOLUTION)
        except PySparkException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            df = spark.createDataFrame([], schemas.SOLUTION + ", path string")
        parts.append(df.withColumn("hash", F.coalesce("hash", F.regexp_extract("path", r"([^/]+)\.json$", 1))))
    return by_priority(parts, "hash")


def with_profile(df: DataFrame, profiles: DataFrame, title: str = "game_title") -> DataFrame:
    """df with the columns of the profile of its title; nulls if there is none."""
    p = profiles.dropDuplicates(["title"]).withColumnRenamed("title", "_title")
    return df.join(p.select("_title", *[F.col(c).alias(f"profile_{c}") for c in p.columns if c != "_title"]), df[title] == F.col("_title"), "left").drop("_title")


def log_tail(spark: SparkSession, path: str, n: int) -> tuple[DataFrame, int]:
    """The last n lines of the text files at path, in order of file and place, with their numbers, and how many there
    are (S12). Lines are numbered within the parts of files that tasks read, from the number of lines before each part."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("o"), F.col("value").alias("line"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("c"), F.min("o").alias("first")).orderBy("file", "block").collect()  # a row per part
    total, before = 0, []
    for r in sizes:
        before.append((r["file"], r["block"], r["first"], total))
        total += r["c"]
    begin = F.broadcast(spark.createDataFrame(before, "file string, block long, first long, before long"))
    numbered = lines.join(begin, ["file", "block"]).select((F.col("o") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")
    return numbered.where(F.col("line_no") > total - n), total


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a query on a database (S4); options as of Spark's JDBC source. One connection reads a query; with
    partitionColumn, lowerBound, upperBound and numPartitions the query's rows are read by ranges, in parallel."""
    source = {"dbtable": f"({query}) AS q"} if "partitionColumn" in options else {"query": query}
    return spark.read.format("jdbc").options(url=url, **source, **options).load()


def database_screens(rows: DataFrame) -> DataFrame:
    """Rows of the relational screens table in the shape of session screens."""
    return rows.select("id", F.col("screen_hash").alias("fingerprint"), F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown")).alias("title"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_fp"), "ocr_text", "screenshot_path")


def first_available(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be opened (S6); the last one's error if none can."""
    for i, source in enumerate(sources):
        try:
            df = source()
            df.schema  # noqa: B018  (analysed now, so that a missing table shows)
            return df
        except (PySparkException, OSError):
            if i == len(sources) - 1:
                raise
    raise ValueError("no source given")


def sample_screens(spark: SparkSession) -> DataFrame:
    """Rows that stand in where there is no data."""
    rows = [(1, "sample", "fp_title", "Title", 0, None, "TAP TO START"), (2, "sample", "fp_home", "Home", 1, "fp_title", "Shop Menu"), (3, "sample", "fp_shop", "Shop", 2, "fp_home", "Buy Back")]
    return spark.createDataFrame(rows, "id long, session_id string, fingerprint string, title string, depth int, parent_fp string, ocr_text string")
