"""Near-duplicate records (problem 4): set-similarity join with a token-group matrix, and groups of linked records.

Each distinct set of tokens takes part once, its tokens ordered from rare to frequent. Similar sets are partitioned
into groups (by their smallest token hash, in chunks): of each group the union of its tokens, its sizes and its
members' keys are stored: that is the token-group matrix. A set asks the groups that hold one of its own keys, bounds
its overlap with all of a group's members by its overlap with the group's union, and opens only groups whose bound
reaches the threshold; pairs from opened groups are verified exactly.

Keys: the first token that two sets of Jaccard similarity t or more have in common lies in the prefixes of both, and
their first three in prefixes two tokens longer. If the first one is rare it is a key itself. If it isn't, all that
they have in common are frequent, and three of these make a key: single frequent tokens, which too many sets share,
are no keys. So no pair is lost, and what is asked grows with the rows. Sets too small or too large for triples of
tokens have their frequent tokens as keys, too (see signatures). Only the frequent tokens, of bounded number, are known
to all tasks; no member overlaps more than the union does.

Null sets and sets under the least size are in no pair; equal sets are one set. Tables may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import components, similarity
from ..session import Kept, checkpoint, hot_join, short_shuffles, split_join
from . import plainform

#: Sets in a group of the matrix, about.
GROUP = 16
#: Tokens of more sets than RARE are frequent; if there are over MOST_FREQUENT of them, those of the most sets.
RARE, MOST_FREQUENT = 8, 1_000_000
#: Tokens of a key of frequent tokens, and the largest set that has such keys.
TOGETHER, LARGEST = 3, 64
#: Sets whose keys a task makes at once.
AT_ONCE = 1_000
#: Links of problem 4: bits that differ, distinct words, words in common in percent.
BELOW_BITS, LEAST_WORDS, PERCENT = 8, 10, 70


def frequent_tokens(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens of sets (toks), in order, and how many sets have each: at most MOST_FREQUENT."""
    with short_shuffles(sets.sparkSession):
        counts = sets.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") > RARE)
        by_n = {r.n: r.tokens for r in counts.groupBy("n").agg(F.count("*").alias("tokens")).collect()}
        least, held = 1 << 62, 0
        for n in sorted(by_n, reverse=True):
            if (held := held + by_n[n]) > MOST_FREQUENT:
                break
            least = n
        found = counts.where(F.col("n") >= least).toArrow()
    t, n = (np.asarray(found.column(c).to_numpy(), np.int64) for c in ("t", "n"))
    order = np.argsort(t)
    return t[order], n[order]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signed(sid: np.ndarray, size: np.ndarray, tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gid of each set; set number, key and whether it is held of each key) of sets given by their sizes and all their
    tokens, one set after the other. frequent, counts: see frequent_tokens."""
    of = np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    at = np.searchsorted(frequent, tokens)
    at[at == len(frequent)] = 0
    n = np.where(frequent[at] == tokens, counts[at], 0) if len(frequent) else np.zeros(len(tokens), np.int64)
    # groups: by the smallest hash, those of a frequent token in chunks
    mixed = _mixed(tokens.view(np.uint64))
    by_hash = np.lexsort((mixed, of))[start]
    chunks = (n[by_hash] // (20 * GROUP) + 1).astype(np.uint64)
    gid = _mixed(mixed[by_hash] + _mixed(sid.view(np.uint64)) % chunks).view(np.int64)

    order = np.lexsort((tokens, n, of))
    t, often = tokens[order].view(np.uint64), n[order] > 0
    place = np.arange(len(of)) - start[of]
    overlap = -(-size * percent // 100)
    prefix = (size - overlap + 1)[of]
    small, large, largish = overlap < TOGETHER, size > LARGEST, size * 100 >= LARGEST * percent
    # rare tokens, for all
    rows = [np.flatnonzero(~often & (place < prefix))]
    owners, keys, held = [of[rows[0]]], [t[rows[0]]], [np.ones(len(rows[0]), bool)]
    # frequent tokens: small and large sets have them, those that can be similar to a large one ask for them
    single = np.flatnonzero(often & (place < prefix) & (small | largish)[of])
    owners.append(of[single])
    keys.append(t[single])
    held.append((small | large)[of[single]])
    # three frequent tokens; those of a set follow one another
    some = np.flatnonzero(often & (place < prefix + TOGETHER - 1) & ~large[of])
    many = np.bincount(of[some], minlength=len(size))
    first = np.cumsum(many) - many
    for f in np.unique(many[many >= TOGETHER]):
        own = np.flatnonzero(many == f)
        block = t[some[first[own][:, None] + np.arange(f)]]
        for c in combinations(range(f), TOGETHER):
            key = np.zeros(len(own), np.uint64)
            for i in c:
                key = _mixed(key + block[:, i])
            owners.append(own)
            keys.append(key)
            held.append(np.ones(len(own), bool))
    return gid, np.concatenate(owners), np.concatenate(keys).view(np.int64), np.concatenate(held)


def signatures(sets: DataFrame, percent: int) -> DataFrame:
    """(sid, gid, z, held, keys, toks) of sets (sid, toks): group, size, keys, of which the first `held` are in the
    matrix, and tokens.

    Pairs of sets of up to LARGEST tokens meet by rare tokens or triples. A larger set and one that can be similar to it
    meet by rare or frequent tokens, under which only the larger one is held. Sets that may have but two tokens in
    common meet by rare or frequent tokens.
    """
    frequent, counts = frequent_tokens(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            sid, toks = b.column(0).to_numpy(), b.column(1)
            size = np.diff(toks.offsets.to_numpy()).astype(np.int64)  # of a slice these don't begin with 0
            gid, owner, key, held = signed(sid, size, toks.flatten().to_numpy(), frequent, counts, percent)
            order = np.lexsort((~held, owner))
            n_keys, n_held = (np.bincount(x, minlength=len(sid)) for x in (owner, owner[held]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_keys)]), pa.int32()), pa.array(key[order]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gid), pa.array(size.astype(np.int32)), pa.array(n_held.astype(np.int32)), lists, toks], names=["sid", "gid", "z", "held", "keys", "toks"])

    return sets.select("sid", "toks").where(F.size("toks") > 0).mapInArrow(run, "sid long, gid long, z int, held int, keys array<long>, toks array<long>")


def _alike(sets: DataFrame, percent: int, kept: Kept) -> DataFrame:
    """(a, b), a < b, as similar_pairs, of sets (sid, toks)."""
    members = kept.keep(signatures(sets, percent))
    asked = members.select("sid", "z", F.explode("keys").alias("key"))
    held = members.select("gid", "z", "sid", F.explode(F.slice("keys", F.lit(1), F.col("held"))).alias("key"))
    held = held.groupBy("key", "gid").agg(F.min("z").alias("least"), F.max("z").alias("most"), F.max("sid").alias("last"))
    # sizes of similar sets differ by no more than the threshold lets them; each pair is met from its smaller id, or from
    # the set that a larger one doesn't ask for
    asks = (F.col("sid") < F.col("last")) | ((F.col("z") <= LARGEST) & (F.col("most") > LARGEST))
    fits = asks & (F.col("least") * percent <= F.col("z") * 100) & (F.col("most") * 100 >= F.col("z") * percent)
    candidates = kept.keep(split_join(asked, held, ["key"]).where(fits).select("sid", "gid").distinct())
    toks = members.select("sid", F.col("toks").alias("q"))
    queries = hot_join(candidates, toks, ["sid"])
    matrix = members.groupBy("gid").agg(F.collect_list(F.struct(F.col("sid").alias("b"), F.col("toks").alias("s"))).alias("sets"))
    matrix = matrix.select("gid", "sets", F.array_distinct(F.flatten("sets.s")).alias("union"))
    # a group that many sets ask for is met in several tasks
    bound = hot_join(queries, matrix, ["gid"], counted=candidates).where(F.size(F.array_intersect("q", "union")) * 100 >= F.size("q") * percent)
    opened = bound.select(F.col("sid").alias("a"), "q", F.inline("sets")).where("a < b or (a > b and size(q) <= %d and size(s) > %d)" % (LARGEST, LARGEST))
    common = F.size(F.array_intersect("q", "s"))
    found = opened.where((F.size("q") * percent <= F.size("s") * 100) & (F.size("s") * percent <= F.size("q") * 100)).withColumn("n", common).where(F.col("n") * 100 >= (F.size("q") + F.size("s") - F.col("n")) * percent)
    found = kept.keep(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kept.drop(members, candidates)
    return found


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def similar_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: sids of distinct sets (sid, words) whose Jaccard similarity is at least percent/100."""
    with Kept(sets.sparkSession) as kept:
        return checkpoint(_alike(kept.keep(sets.select("sid", _hashes("words").alias("toks"))), percent, kept))


def word_sets(df: DataFrame, text: str, row: str) -> DataFrame:
    """df with words: the distinct words of the text's plain form without decimal digits, sorted; null unless there are
    LEAST_WORDS of them. row: a column that is unique."""
    plain = plainform.plain_texts(df, text, row)
    words = F.array_remove(F.array_distinct(F.split(F.regexp_replace("plain", r"\p{Nd}+", ""), " ")), "")
    return plain.withColumn("words", words).withColumn("words", F.when(F.size("words") >= LEAST_WORDS, F.sort_array("words"))).drop("plain")


def _represented(rows: DataFrame, key: str, rep: str, kept: Kept) -> DataFrame:
    """rows with rep: the smallest row of each key that isn't null."""
    known = rows.where(F.col(key).isNotNull())
    reps = known.groupBy(key).agg(F.min("row").alias(rep))
    return kept.keep(hot_join(known, reps, [key], counted=known.select(key)).unionByName(rows.where(F.col(key).isNull()).withColumn(rep, F.lit(None).cast("long"))))


def groups(df: DataFrame, row: str, phash: str, text: str) -> DataFrame:
    """(id, group_id, n_links): the group of every row, named by its smallest id, and the number of other distinct
    hashes and word sets that the row's own are linked to. A row linked to none is a group of its own.
    """
    base = df.select(F.col(row).cast("long").alias("row"), similarity.bits_of(phash).alias("h"), F.col(text).alias("text")).where("row is not null")
    with short_shuffles(df.sparkSession):
        repeated = base.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if repeated:  # else the texts needn't be moved
        base = base.dropDuplicates(["row"])
    with Kept(df.sparkSession) as kept:
        words = word_sets(base, "text", "row")
        rows = kept.keep(words.select("row", "h", F.unhex(F.md5(F.array_join("words", " "))).alias("wkey"), _hashes("words").alias("toks")))
        # the representative of all rows of one hash, or of one word set, is the smallest row
        named = _represented(rows, "wkey", "rep_w", kept)
        kept.drop(rows)
        sets = kept.keep(named.where("row = rep_w").select(F.col("row").alias("sid"), "toks"))
        rows = _represented(named.select("row", "h", "rep_w"), "h", "rep_h", kept)
        kept.drop(named)
        alike = _alike(sets, PERCENT, kept).toDF("src", "dst")
        kept.drop(sets)
        ends = rows.where("row = rep_h").select("h", "rep_h")
        near = kept.keep(similarity.near_pairs(ends, BELOW_BITS))
        near = near.join(ends.toDF("a", "src"), "a").join(ends.toDF("b", "dst"), "b").select("src", "dst")
        links = kept.keep(near.withColumn("kind", F.lit("h")).unionByName(alike.withColumn("kind", F.lit("w"))))
        rows = rows.select("row", "rep_h", "rep_w", F.coalesce("rep_h", "rep_w", "row").alias("node"))
        both = rows.where("rep_h <> rep_w").select(F.col("rep_h").alias("src"), F.col("rep_w").alias("dst"))
        found = kept.keep(components.components(links.select("src", "dst").unionByName(both)))
        degree = kept.keep(links.select("kind", F.explode(F.array("src", "dst")).alias("rep")).groupBy("kind", "rep").agg(F.count("*").alias("n")))
        out = hot_join(rows, found, ["node"], "left").withColumn("group_id", F.coalesce("component", "node"))
        for k, rep in (("h", "rep_h"), ("w", "rep_w")):
            out = hot_join(out, degree.where(F.col("kind") == k).select(F.col("rep").alias(rep), F.col("n").alias(f"n_{k}")), [rep], "left", counted=rows)
        return checkpoint(out.select(F.col("row").alias("id"), "group_id", (F.coalesce("n_h", F.lit(0)) + F.coalesce("n_w", F.lit(0))).alias("n_links")))


def pairs_within(grouped: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all pairs of one group; the pairs of a large group are laid out over many tasks.
    grouped is read more than once."""
    g = grouped.select("id", "group_id")
    several = g.join(g.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id"), "group_id", "left_semi")
    return split_join(several.select("group_id", F.col("id").alias("id_a")), several.select("group_id", F.col("id").alias("id_b")), ["group_id"]).where("id_a < id_b").select("id_a", "id_b")
