"""Deduplicating new batches against all history (problem 5), by incremental record linkage.

What was accepted lives in tables under a named folder in the shared folder, which any later process can open again:
blocking keys (scope and a 16-bit band of the hash, see operators/similarity.py) with the records stored under them,
links, and the union-find mapping of records to the representatives of their clusters. state.json names the finished
deliveries, the counts of comparison patterns and the learned weights; what a delivery wrote before it broke off is
written anew when it is accepted again.

A new batch probes the blocking keys: blocks lie in folders by a hash of scope and key, and only the folders that the
batch asks for are read. Runs of blocks of like size are merged, so that there are few of them however many batches came
(each record is rewritten as often as the logarithm of the number of batches). Each candidate pair is compared field by
field and scored with weights learned by expectation maximisation over the counts of all comparison patterns so far
(patterns are few, so only their counts reach the driver). A record's match is its best-scored candidate at a distance
below BELOW_BITS; the record joins the cluster of that match's representative, and clusters that a record links to one
another are merged: only mapping rows of records that arrive and of representatives that are absorbed are written.

Records are the distinct (scope, hash) of a batch. Null scopes and hashes that aren't 16 hex digits are no case. A
repeated row is one record. An empty batch changes nothing. Batches are accepted in rising order.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, similarity
from ..session import checkpoint, read_text, remove, shared_dir, split_join, write_text

BELOW_BITS = 8
#: Candidates are kept and scored up to this distance, so that the weights see pairs that don't match, too.
COMPARED_BITS = 12
#: Folders of blocks; runs of one size before they are merged.
BUCKETS, MERGED = 16, 8
_BLOCKS = "key long, scope string, h long, nid long, title string, fp string, rep long, run int, bucket int"
_LINKS = "batch int, scope string, h long, nid long, old long, rep long, distance int, pattern string"
_MEMBERS, _MOVES = "nid long, rep long", "rep long, to long"


def records(rows: DataFrame) -> DataFrame:
    """(batch, scope, h, nid, title, fp) of rows (id, batch, scope, phash, title, fingerprint): one per batch, scope and
    hash, with the fields of its smallest id."""
    h = rows.withColumn("h", similarity.bits_of("phash")).where("h is not null and scope is not null and batch is not null and id is not null")
    return h.groupBy(F.col("batch").cast("int").alias("batch"), "scope", "h").agg(F.min(F.struct("id", "title", "fingerprint")).alias("r")).select("batch", "scope", "h", F.col("r.id").cast("long").alias("nid"), F.col("r.title").alias("title"), F.col("r.fingerprint").alias("fp"))


def _agrees(a: str, b: str) -> Column:
    return F.when(F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == "") | (F.col(b) == ""), "?").when(F.col(a) == F.col(b), "=").otherwise("x")


def learn(counts: dict[str, int], rounds: int = 30) -> dict[str, float]:
    """Weight, in bits, of each comparison pattern: the sum over its fields of log2(m / u), where m and u are the
    chances of the field's value among matches and others, fitted by expectation maximisation over the counts."""
    if not counts:
        return {}
    fields = len(next(iter(counts)))
    values = [sorted({p[i] for p in counts}) for i in range(fields)]
    start = {"0": 0.99, "1": 0.9, "2": 0.7, "3": 0.1}
    post = {p: start[p[0]] for p in counts}
    m: list[dict[str, float]] = []
    u: list[dict[str, float]] = []
    for _ in range(rounds):
        total_m = sum(post[p] * n for p, n in counts.items())
        total_u = sum((1 - post[p]) * n for p, n in counts.items())
        m = [{v: (sum(post[p] * n for p, n in counts.items() if p[i] == v) + 0.5) / (total_m + 0.5 * len(values[i])) for v in values[i]} for i in range(fields)]
        u = [{v: (sum((1 - post[p]) * n for p, n in counts.items() if p[i] == v) + 0.5) / (total_u + 0.5 * len(values[i])) for v in values[i]} for i in range(fields)]
        share = (total_m + 1) / (total_m + total_u + 2)
        for p in counts:
            a = share * math.prod(m[i][p[i]] for i in range(fields))
            b = (1 - share) * math.prod(u[i][p[i]] for i in range(fields))
            post[p] = a / (a + b)
    return {p: sum(math.log2(m[i][p[i]] / u[i][p[i]]) for i in range(fields)) for p in counts}


def _bucket() -> Column:
    return F.pmod(F.xxhash64("scope", "key"), F.lit(BUCKETS)).cast("int").alias("bucket")


class History:
    """Accepted records, kept under a name in the session's shared folder; opened again if they are there."""

    def __init__(self, spark: SparkSession, name: str, below: int = BELOW_BITS) -> None:
        self.spark, self.below = spark, below
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}"
        state = json.loads(read_text(spark, f"{self.path}/state.json") or "{}")
        self.n: int = state.get("n", 0)
        #: Finished runs of blocks: [size class, number].
        self.runs: list[list] = state.get("runs", [])
        self.counts: dict[str, int] = state.get("counts", {})
        self.weights: dict[str, float] = state.get("weights", {})
        self.n_runs: int = state.get("n_runs", 0)

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/state.json", json.dumps({"n": self.n, "runs": self.runs, "counts": self.counts, "weights": self.weights, "n_runs": self.n_runs}))

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _each(self, kind: str) -> list[str]:
        return [f"{self.path}/{kind}-{i}" for i in range(self.n)]

    def _weight(self) -> Column:
        known = F.create_map(*[F.lit(x) for kv in self.weights.items() for x in kv]) if self.weights else F.expr("cast(map() as map<string,double>)")
        return F.element_at(known, F.col("pattern"))

    def _run(self, r: int) -> str:
        return f"{self.path}/blocks/run={r}"

    def _stored(self, runs: list[int]) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).option("basePath", f"{self.path}/blocks").parquet(*map(self._run, runs))

    def _store(self, blocks: DataFrame, size: int) -> None:
        """Blocks as a new run; a run of that number that broke off is written over."""
        r = self.n_runs
        blocks.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._run(r))
        self.runs.append([size, r])
        self.n_runs += 1

    def blocks_asked(self, new: DataFrame) -> DataFrame:
        """The stored blocks of the folders that a batch asks for."""
        past = self._stored([r for _, r in self.runs])
        asked = [r[0] for r in new.select(F.explode(similarity.asked_keys("h", self.below)).alias("key"), "scope").select(_bucket()).distinct().collect()]  # BUCKETS rows at most
        return past.where(F.col("bucket").isin(asked)) if len(asked) < BUCKETS else past

    def accept(self, new: DataFrame, within: bool = False) -> None:
        """Link a batch with what came in earlier ones and store it. within: clusters also grow by links inside the batch,
        which are kept apart from the others."""
        at = f"{self.path}/links-{self.n}"
        own = new.select(F.explode(similarity.stored_keys("h")).alias("key"), "scope", "h", "nid", "title", "fp")
        asked = new.select(F.explode(similarity.asked_keys("h", self.below)).alias("key"), "batch", "scope", "h", "nid", "title", "fp")
        distance = similarity.hamming("h", "other")
        if self.runs:
            held = self.blocks_asked(new).select("key", "scope", F.col("h").alias("other"), F.col("nid").alias("old"), F.col("title").alias("title2"), F.col("fp").alias("fp2"), "rep")
            near = split_join(asked, held, ["key", "scope"]).where(distance < COMPARED_BITS).withColumn("distance", distance)
            level = F.when(F.col("distance") == 0, "0").when(F.col("distance") < 4, "1").when(F.col("distance") < self.below, "2").otherwise("3")
            near.select("batch", "scope", "h", "nid", "old", "rep", "distance", F.concat(level, _agrees("title", "title2"), _agrees("fp", "fp2")).alias("pattern")).dropDuplicates(["scope", "h", "old"]).write.mode("overwrite").parquet(at)
        else:
            self.spark.createDataFrame([], _LINKS).write.mode("overwrite").parquet(at)
        links = self._read(_LINKS, [at])
        for r in links.groupBy("pattern").agg(F.count("*").alias("n")).collect():  # at most 36 patterns
            self.counts[r.pattern] = self.counts.get(r.pattern, 0) + r.n
        self.weights = learn(self.counts)
        match = links.where(F.col("distance") < self.below).select("nid", "rep")
        inside = None
        if within:
            mates = own.select("key", "scope", F.col("h").alias("other"), F.col("nid").alias("old"))
            both = split_join(asked.select("key", "scope", "h", "nid"), mates, ["key", "scope"])
            inside = both.where((F.col("h") < F.col("other")) & (distance < self.below)).select("nid", "old").distinct()
        reps = self._merge(new, match, inside)
        # a hash that was known before is stored already, and its record is the one that came first
        known = links.where("distance = 0").select("scope", "h").distinct()
        fresh = own.join(known, ["scope", "h"], "left_anti").join(reps, "nid")
        self._store(fresh.select(*[c.split()[0] for c in _BLOCKS.split(", ")[:-2]], _bucket()), 0)
        self.n += 1
        self._compact()
        self._save()

    def _compact(self) -> None:
        """Merge the MERGED runs of one size class into one of the next."""
        while len(same := [r for r in self.runs if r[0] == self.runs[-1][0]]) >= MERGED:
            self.runs = [r for r in self.runs if r not in same]
            self._store(self._stored([r for _, r in same]).drop("run"), same[0][0] + 1)
            self._save()  # before the old runs go
            for _, r in same:
                remove(self.spark, self._run(r))

    def _merge(self, new: DataFrame, match: DataFrame, inside: DataFrame | None) -> DataFrame:
        """Union-find over what this batch touches: its records and the representatives of what they link to. match: nid,
        rep (of the other record when it came); inside: nid, old. Written are the batch's members and the representatives
        that are absorbed, nothing else. Returns the batch's members."""
        roots = self._roots(match.select("rep"))
        edges = match.join(roots, "rep").select(F.col("nid").alias("src"), F.col("root").alias("dst"))
        if inside is not None:
            edges = edges.unionByName(inside.select(F.col("nid").alias("src"), F.col("old").alias("dst")))
        found = checkpoint(components.components(edges))
        own = new.select("nid")
        members, moves = f"{self.path}/members-{self.n}", f"{self.path}/moves-{self.n}"
        own.join(found, own["nid"] == found["node"], "left").select("nid", F.coalesce("component", "nid").alias("rep")).write.mode("overwrite").parquet(members)
        found.where("node <> component").join(own, found["node"] == own["nid"], "left_anti").select(F.col("node").alias("rep"), F.col("component").alias("to")).write.mode("overwrite").parquet(moves)
        return self._read(_MEMBERS, [members])

    def _roots(self, reps: DataFrame) -> DataFrame:
        """(rep, root): representatives of any time and those that have absorbed them, step by step. A representative is
        absorbed once, so it has one move at most."""
        now = reps.select("rep").distinct().withColumn("root", F.col("rep"))
        moves = self._read(_MOVES, self._each("moves"))
        while self.n:
            for _ in range(3):
                now = now.join(moves.select(F.col("rep").alias("root"), "to"), "root", "left").select("rep", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved"))
            now = checkpoint(now)
            if now.where("moved").isEmpty():
                break
        return now.select("rep", "root")

    def representatives(self) -> DataFrame:
        """(nid, rep) of every record: its cluster's representative now."""
        members = self._read(_MEMBERS, self._each("members"))
        return members.join(self._roots(members), "rep").select("nid", F.col("root").alias("rep"))

    def links(self) -> DataFrame:
        """All links so far, up to COMPARED_BITS, with their score under the weights learned so far."""
        return self._read(_LINKS, self._each("links")).withColumn("score", self._weight())

    def matches(self) -> DataFrame:
        """(batch, scope, h, nid, old, rep, distance, score, n_links): of each record with a candidate below BELOW_BITS the
        best-scored one, then the nearest, then the oldest, and the representative that the mapping gives the record."""
        best = F.min(F.struct((-F.col("score")).alias("s"), "distance", "old")).alias("b")
        found = self.links().where(F.col("distance") < self.below).groupBy("batch", "scope", "h", "nid").agg(best, F.count("*").alias("n_links"))
        found = found.select("batch", "scope", "h", "nid", F.col("b.old").alias("old"), F.col("b.distance").alias("distance"), (-F.col("b.s")).alias("score"), "n_links")
        return found.join(self.representatives(), "nid")

    def drop(self) -> None:
        remove(self.spark, self.path)
