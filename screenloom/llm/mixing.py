"""Mixing sources to target weights (problem 8).

Every document's tokens are counted with a public tokenizer. A source's documents, in a pseudorandom order, form one
stream of tokens that is cut in blocks of fixed length (the last of a source may be shorter). Quotas of blocks come
from the target shares and the caps on repeats: a source that can't reach its share, repeats included, gives all it
has, and the others share the rest in proportion to their targets. Each output shard draws multinomial counts per
source; draws beyond a source's quota go to sources still below theirs. A source's n-th slot takes block
permutation(n mod blocks) of pass n div blocks, a new pseudorandom permutation for each pass, and slots are joined with
blocks by index.

Source names are compared without case and outer blanks. Documents without source, without target or without tokens are
not used but reported; targets without documents reach 0. Nulls, empty and very long texts and empty tables are fine.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

BLOCK_TOKENS = 1024
SHARD_SLOTS = 1000
SEED = 17
#: Documents of one source are put in order within hash ranges of about so many documents, so that no task holds a whole source.
RANGE_DOCUMENTS = 50_000
#: Sources a target table may name; per-source figures are handled by the driver.
MOST_SOURCES = 10_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest piece handed to the tokenizer at once; pieces end at line ends or blanks where there are any.
PIECE = 100_000


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Token ids of a whole text. A text over PIECE characters is encoded in pieces, always the same ones."""
    enc = encoder(path)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = max(text.rfind("\n", at, end), text.rfind(" ", at, end))
            end = cut if cut > at else end
        out += enc.encode_ordinary(text[at:end])
        at = end
    return out


def source_name(c: Column) -> Column:
    """A source's name without case and outer blanks; '' for none."""
    return F.coalesce(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens); null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(encode(t, vocabulary)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, source string, n_tokens long")


def packed(counts: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(source, block, n_tokens, spans): the blocks of each source; spans: doc_id and first and last token + 1 of each
    part. Offsets are running sums in two steps, over hash ranges and within them."""
    ranges = max(1, -(-counts.count() // RANGE_DOCUMENTS))
    docs = counts.where("n_tokens > 0").withColumn("o", F.xxhash64(F.lit(seed), "doc_id")).withColumn("range", F.pmod(F.shiftrightunsigned("o", 20), F.lit(ranges)).cast("int"))
    sums = docs.groupBy("source", "range").agg(F.sum("n_tokens").alias("s"))
    before = sums.withColumn("base", F.sum("s").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("source", "range", F.coalesce("base", F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "range").orderBy("o", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a row per range
    placed = docs.withColumn("run", inside).join(before, ["source", "range"]).withColumn("start", F.col("base") + F.col("run") - F.col("n_tokens"))
    first, last = F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("n_tokens") - 1) / block_tokens)
    parts = placed.select("source", "doc_id", "start", "n_tokens", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest("start", F.col("block") * block_tokens)
    hi = F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * block_tokens)
    span = F.struct(lo.alias("at"), "doc_id", (lo - F.col("start")).alias("first"), (hi - F.col("start")).alias("stop"))
    return parts.groupBy("source", "block").agg(F.sum(hi - lo).alias("n_tokens"), F.sort_array(F.collect_list(span)).alias("spans"))


def quotas(share: np.ndarray, capacity: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers near share * total, none above its capacity; what a full source can't take goes to the others in
    proportion to their shares. Their sum is total, or all capacity with a share."""
    share = np.where(capacity > 0, share, 0.0)
    out, free, left = np.zeros(len(share)), share > 0, float(min(total, capacity[share > 0].sum()))
    while free.any() and left > 1e-9:
        want = left * share / share[free].sum()
        full = free & (want >= capacity - 1e-9)
        if not full.any():
            out[free] = want[free]
            break
        out[full] = capacity[full]
        left -= capacity[full].sum()
        free &= ~full
    whole = np.floor(out + 1e-9).astype(np.int64)
    missing = int(round(min(total, capacity[share > 0].sum()))) - int(whole.sum())
    order = np.argsort(-(out - whole), kind="stable")
    for i in order:
        if missing <= 0:
            break
        if whole[i] < capacity[i] and share[i] > 0:
            whole[i] += 1
            missing -= 1
    return whole


def permuted(n: np.ndarray, size: int, key: int) -> np.ndarray:
    """Place of each n in a pseudorandom permutation of range(size): a Feistel network with cycle walking."""
    half = max(1, (max(2, size) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    x = n.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for i in range(4):
            f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + i * 0xBF58476D1CE4E5B9) % 2**64)) * np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(32)) & mask
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= size
    return x.astype(np.int64)


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Mixture: (shard, slot, source, block, pass, n_tokens, spans), one row per block used. Report: (source, n_docs,
    n_tokens, target_share, max_repeat, n_blocks, used_tokens, reached_share, most_used). total_tokens: size aimed at,
    by default that of all documents of targeted sources.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    wanted = checkpoint(wanted)
    if wanted.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counts = checkpoint(token_counts(documents, vocabulary))
    blocks = checkpoint(packed(counts.join(F.broadcast(wanted.select("source")), "source", "left_semi"), block_tokens, seed))
    sums = counts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    have = blocks.groupBy("source").agg(F.count("*").alias("n_blocks"))
    plan = wanted.join(sums, "source", "left").join(have, "source", "left").fillna(0, ["n_docs", "n_tokens", "n_blocks", "target_share", "max_repeat"]).orderBy("source").toPandas()
    size = int(plan.n_tokens.sum()) if total_tokens is None else total_tokens
    slots = -(-size // block_tokens)
    n_blocks, share = plan.n_blocks.to_numpy(np.int64), plan.target_share.to_numpy(float)
    quota = quotas(share, n_blocks * plan.max_repeat.to_numpy(np.int64), slots)
    slots = int(quota.sum())
    chance = quota / slots if slots else share
    names = plan.source.tolist()
    shards = -(-slots // shard_slots) if slots else 0
    chunk = max(1, -(-shards // 10_000))

    def draws(shard: int) -> np.ndarray:
        n = min(shard_slots, slots - shard * shard_slots)
        return np.random.default_rng([seed, shard]).multinomial(n, chance)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g in pdf["id"]:
                drawn = sum((draws(s) for s in range(g * chunk, min(shards, (g + 1) * chunk))), np.zeros(len(names), np.int64))
                yield pd.DataFrame({"g": g, "drawn": [drawn.tolist()]})

    # counts drawn by groups of shards, of which there are 10,000 at most: where each group's slots of a source begin
    n_groups = -(-shards // chunk)
    groups = spark.range(0, n_groups, 1, max(1, min(n_groups, 200))).mapInPandas(tally, "g long, drawn array<long>").orderBy("g").collect() if shards else []
    drawn = np.array([r.drawn for r in groups], np.int64).reshape(len(groups), len(names))
    begin = np.cumsum(drawn, 0) - drawn
    surplus = np.maximum(drawn.sum(0) - quota, 0) if shards else np.zeros(len(names), np.int64)
    lack = np.maximum(quota - drawn.sum(0), 0) if shards else surplus
    lack_end = np.cumsum(lack)
    surplus_begin = np.cumsum(surplus) - surplus
    got = np.minimum(drawn.sum(0), quota) if shards else surplus
    sent = spark.sparkContext.broadcast(begin)  # groups of shards, 10,000 at most, by sources

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g in pdf["id"]:
                at = sent.value[g].copy()
                for shard in range(g * chunk, min(shards, (g + 1) * chunk)):
                    n = draws(shard)
                    src = np.repeat(np.arange(len(names)), n)
                    nth = np.concatenate([np.arange(a, a + k) for a, k in zip(at, n)]) if len(src) else np.zeros(0, np.int64)
                    at += n
                    over = nth >= quota[src]
                    # the r-th surplus slot overall goes to the source whose lack covers r
                    r = surplus_begin[src[over]] + nth[over] - quota[src[over]]
                    to = np.searchsorted(lack_end, r, "right")
                    nth[over] = got[to] + r - (lack_end[to] - lack[to])
                    src[over] = to
                    block, turn = np.zeros(len(src), np.int64), nth // np.maximum(n_blocks[src], 1)
                    for s in np.unique(src):
                        for p in np.unique(turn[src == s]):
                            m = (src == s) & (turn == p)
                            block[m] = permuted(nth[m] % n_blocks[s], int(n_blocks[s]), hash((seed, int(s), int(p))) % 2**61)
                    order = np.random.default_rng([seed, 1, shard]).permutation(len(src))
                    yield pd.DataFrame({"shard": shard, "slot": np.arange(len(src)), "source": [names[s] for s in src[order]], "block": block[order], "pass": turn[order]})

    schema = "shard long, slot long, source string, block long, pass long"
    laid = spark.range(0, n_groups, 1, max(1, min(n_groups, 2000))).mapInPandas(lay, schema) if shards else spark.createDataFrame([], schema)
    # the planner takes the slots for as few as the shard groups they come from; neither side may be broadcast for that
    mixed = laid.hint("merge").join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "pass", "n_tokens", F.transform("spans", lambda s: F.struct(s["doc_id"].alias("doc_id"), s["first"].alias("first"), s["stop"].alias("stop"))).alias("spans"))
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), (F.max("pass") + 1).alias("most_used"))
    total = Window.partitionBy(F.lit(0))
    report = sums.join(wanted, "source", "full").join(have, "source", "left").join(used, "source", "left").fillna(0, ["n_docs", "n_tokens", "n_blocks", "used_tokens", "most_used", "target_share", "max_repeat"])
    report = report.withColumn("reached_share", F.round(F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(total)), F.lit(0.0)), 6))
    return mixed, report.select("source", "n_docs", "n_tokens", "target_share", "max_repeat", "n_blocks", "used_tokens", "reached_share", "most_used")


def tokens_of(mixed: DataFrame, documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(shard, slot, tokens): the token ids of each block of a mixture. Documents are encoded where they are used."""
    parts = mixed.select("shard", "slot", F.posexplode("spans").alias("at", "s")).select("shard", "slot", "at", F.col("s.doc_id").alias("doc_id"), F.col("s.first").alias("first"), F.col("s.stop").alias("stop"))
    # a document's parts are cut from one encoding of it
    by_doc = parts.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "slot", "at", "first", "stop")).alias("p")).join(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                out = []
                for r in pdf[at : at + 500].itertuples(index=False):
                    ids = np.array(encode(r.text, vocabulary), np.int32)
                    out += [(p["shard"], p["slot"], p["at"], ids[p["first"] : p["stop"]]) for p in r.p]
                yield pd.DataFrame(out, columns=["shard", "slot", "at", "ids"])

    cut = by_doc.select("text", "p").mapInPandas(run, "shard long, slot long, at int, ids array<int>")
    return cut.groupBy("shard", "slot").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("x")).select("shard", "slot", F.flatten(F.transform("x", lambda x: x["ids"])).alias("tokens"))
