"""Queries of problem 5 over lc_screens and lc_sessions. SQL compares every two hashes of a game, for
p5_found; scores and clusters are tested on small tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import similarity
from ..session import checkpoint, hot_join, shared_dir, table
from . import history


def screens_of_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, batch, scope, phash, title, fingerprint): screens with the game of their session; of a session delivered
    again the smallest id counts."""
    sessions = table(spark, sf_dir, "lc_sessions").where("session_id is not null").groupBy("session_id").agg(F.min_by(F.struct("game_title"), "id").alias("g")).select("session_id", F.coalesce("g.game_title", F.lit("Unknown Game")).alias("scope"))
    screens = table(spark, sf_dir, "lc_screens").select("id", "session_id", F.col("import_batch").alias("batch"), "phash", "title", "fingerprint")
    return screens.join(sessions, "session_id").drop("session_id")


def _replay(spark: SparkSession, rows: DataFrame, within: bool = False) -> history.History:
    """Accept all batches, in order, into a new history. Its caller drops it."""
    name = f"history-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}/records"
    history.records(rows).repartition("batch", F.pmod(F.xxhash64("h"), F.lit(4))).write.partitionBy("batch").parquet(path)
    new = spark.read.schema("scope string, h long, nid long, title string, fp string, batch int").parquet(path)
    past = history.History(spark, name)
    for r in new.select("batch").distinct().orderBy("batch").collect():  # one row per delivery
        past.accept(new.where(F.col("batch") == r.batch), within=within)
    return past


def _kept(past: history.History, result: DataFrame) -> DataFrame:
    """The result, written down, without the history that it came from."""
    out = checkpoint(result)
    past.drop()
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(screens_of_games(spark, sf_dir))
    past = _replay(spark, rows)
    # a record is known if it has a match and a place in the mapping; matches are candidates below BELOW_BITS, exactly
    hits = past.matches().where("rep is not null and old is not null").select("batch", "scope", "h")
    return _kept(past, hot_join(rows.withColumn("h", similarity.bits_of("phash")), hits, ["batch", "scope", "h"], "left_semi").select("id"))


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record of a batch that was known: its best match by score, then distance, then age."""
    past = _replay(spark, checkpoint(screens_of_games(spark, sf_dir)))
    return _kept(past, past.matches().select("batch", F.col("scope").alias("game_title"), F.col("nid").alias("id"), F.col("old").alias("known_id"), "distance", F.round("score", 6).alias("score"), "n_links"))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster_id) of every screen with a game and a valid hash, after all batches one by one; links inside a batch
    count, too."""
    rows = checkpoint(screens_of_games(spark, sf_dir).withColumn("h", similarity.bits_of("phash")).where("h is not null and batch is not null"))
    past = _replay(spark, rows, within=True)
    record = rows.groupBy("batch", "scope", "h").agg(F.min("id").alias("nid"))
    of = hot_join(rows.select("id", "batch", "scope", "h"), record, ["batch", "scope", "h"])
    return _kept(past, hot_join(of.select("id", "nid"), past.representatives(), ["nid"]).select("id", F.col("rep").alias("cluster_id")))


QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches, "p5_clusters": p5_clusters}
_GAMES = """WITH g AS (SELECT session_id, coalesce(game_title, 'Unknown Game') AS game FROM lc_sessions x WHERE session_id IS NOT NULL AND id = (SELECT min(id) FROM lc_sessions y WHERE y.session_id = x.session_id)),
r AS (SELECT id, import_batch AS batch, game, CAST('0x' || phash AS UBIGINT) AS h FROM lc_screens JOIN g USING (session_id) WHERE regexp_full_match(phash, '[0-9a-fA-F]{16}')) """
ORACLES: dict[str, str] = {
    "p5_found": _GAMES + "SELECT DISTINCT a.id FROM r a JOIN r b ON a.game = b.game AND b.batch < a.batch AND bit_count(CAST(xor(a.h, b.h) AS HUGEINT)) < 8",
}
