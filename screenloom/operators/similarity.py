"""64-bit perceptual hashes: exact joins by Hamming distance.

Distance below t: the 64 bits are cut in m bands of about 64/m bits, and each band i gets a radius r_i so that the
r_i + 1 sum up to t. Were every band to differ in more than r_i bits, there would be t differing bits or more; so some
band lies within its radius. One side is stored under each band's value, the other asks for each value within the
radius. More bands mean fewer questions but fuller buckets, so the number of bands is chosen by the expected rows for
the number of hashes; any choice is exact. Rows of a hot key are split over tasks (split_join).

Such questions are rows, hundreds a hash where hashes are many. near_pairs, for small distances, moves each hash a few
times only: of m bands, two hashes of distance below t have k = m - t + 1 in common. A hash goes to a task for each band
that can be the first of those, and the task finds the other k - 1 by sorting. Each pair is told from its first k equal
bands alone, so none comes twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import split_join

#: Bands used where keys are kept (they must not change with the size).
BANDS = 4
#: Questions a hash, at most.
MOST_MASKS = 50_000


def bits_of(phash: str | Column) -> Column:
    """The 64 bits of a hash of 16 hex digits of either case as a BIGINT; null if it isn't one."""
    h = F.col(phash) if isinstance(phash, str) else phash
    return F.when(h.rlike("^[0-9a-fA-F]{16}$"), F.conv(h, 16, -10).cast("long"))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Number of differing bits of two BIGINTs."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def _cuts(bands: int) -> list[tuple[int, int]]:
    """First bit and width of each band."""
    at = [64 * i // bands for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _radii(bands: int, below: int) -> list[int]:
    """Radius of each band, -1 where a band needn't be asked: the radii + 1 sum up to `below`."""
    return [below // bands + (i < below % bands) - 1 for i in range(bands)]


def _key(h: Column, i: int, bands: int) -> Column:
    """Band number and value in one number."""
    at, width = _cuts(bands)[i]
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(i << width).cast("long")


def _masks(width: int, radius: int) -> list[int]:
    """Differences of a band within the radius."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def bands_for(n: int, below: int) -> int:
    """The number of bands of fewest expected rows, questions and candidates, for n hashes a side. Numbers whose
    questions would make a plan of over MOST_MASKS constants aren't taken."""

    def rows(bands: int) -> float:
        asked = [sum(math.comb(w, k) for k in range(r + 1)) for (_, w), r in zip(_cuts(bands), _radii(bands, below))]
        return n * sum(asked) + n * n * sum(a / 2.0**w for a, (_, w) in zip(asked, _cuts(bands))) + (0 if sum(asked) <= MOST_MASKS else 1e300)

    return min(range(2, 17), key=rows)


def stored_keys(h: str, bands: int = BANDS) -> Column:
    """Keys under which a hash is stored: one per band."""
    return F.array(*[_key(F.col(h), i, bands) for i in range(bands)])


def asked_keys(h: str, below: int, bands: int = BANDS) -> Column:
    """Keys at which every hash at a distance below `below` is stored in at least one."""

    def around(i: int) -> Column:
        # one constant, not thousands of expressions
        flips = F.split(F.lit(",".join(map(str, _masks(_cuts(bands)[i][1], _radii(bands, below)[i])))), ",").cast("array<bigint>")
        return F.transform(flips, lambda m: _key(F.col(h), i, bands).bitwiseXOR(m))

    return F.flatten(F.array(*[around(i) for i in range(bands) if _radii(bands, below)[i] >= 0]))


def _near(left: DataFrame, right: DataFrame, below: int, bands: int | None) -> DataFrame:
    """(lh, rh) candidates: columns lh and rh hold distinct hashes."""
    bands = bands or bands_for(max(1, left.count(), right.count()), below)
    stored = right.select(F.explode(stored_keys("rh", bands)).alias("key"), "rh")
    asked = left.select(F.explode(asked_keys("lh", below, bands)).alias("key"), "lh")
    return split_join(asked, stored, ["key"])


def hamming_pairs(hashes: DataFrame, below: int, bands: int | None = None) -> DataFrame:
    """(a, b, distance), a < b, of all pairs of distinct values of column h (BIGINT) that differ in fewer than `below` bits.

    Null hashes are in no pair. An empty table has no pairs.
    """
    h = hashes.select("h").where("h is not null").distinct()
    near = _near(h.toDF("lh"), h.toDF("rh"), below, bands).where((F.col("lh") < F.col("rh")) & (hamming("lh", "rh") < below))
    return near.select(F.col("lh").alias("a"), F.col("rh").alias("b")).distinct().withColumn("distance", hamming("a", "b"))


def hamming_matches(left: DataFrame, right: DataFrame, below: int, bands: int | None = None) -> DataFrame:
    """(lh, rh, distance) of all pairs of distinct values of left.h and right.h that differ in fewer than `below` bits."""
    lh, rh = (df.select("h").where("h is not null").distinct().toDF(n) for df, n in ((left, "lh"), (right, "rh")))
    near = _near(lh, rh, below, bands).where(hamming("lh", "rh") < below)
    return near.select("lh", "rh").distinct().withColumn("distance", hamming("lh", "rh"))


#: Hashes of a cell of near_pairs that are one piece.
PIECE = 400_000


def shared_bands_for(n: int, below: int) -> int:
    """The number of bands of near_pairs of least expected time for n hashes: sorting one costs as much as comparing ten.
    There are four at least, so that a band has few values."""

    def cost(m: int) -> float:
        k = m - below + 1
        return math.comb(m, k) * n * (10 + n / 2 / 2.0 ** (64 * k / m))

    return min(range(max(4, below), max(4, below) + 6), key=cost)


def _runs(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of equal values of sorted v, by the distance of their positions."""
    at, d = np.flatnonzero(v[1:] == v[:-1]), 1
    while len(at):
        yield at, at + d
        d += 1
        at = at[: np.searchsorted(at, len(v) - d)]
        at = at[v[at] == v[at + d]]


def near_in_cell(hashes: np.ndarray, sides: np.ndarray, band: int, bands: int, below: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of distinct hashes (signed) that agree in that band and in none before as one of their first
    bands in common. sides: 0 for all hashes, or 1 and 2 where only pairs of both are asked for."""
    k = bands - below + 1
    masks = [np.uint64(((1 << width) - 1) << at) for at, width in _cuts(bands)]
    both = bool(sides.any())
    whole = hashes.view(np.uint64)
    for rest in combinations(range(band + 1, bands), k - 1):
        mask = np.bitwise_or.reduce([masks[i] for i in (band, *rest)])
        order = np.argsort(whole & mask)
        h, side = whole[order], sides[order]
        for i, j in _runs(h & mask):
            x = h[i] ^ h[j]
            good = np.bitwise_count(x) < below
            if both:
                good &= side[i] != side[j]
            i, j, x = i[good], j[good], x[good]
            for other in range(rest[-1] if rest else band):
                if other != band and other not in rest:
                    differs = (x & masks[other]) != 0
                    i, j, x = i[differs], j[differs], x[differs]
            if len(i):
                a, b = h[i].view(np.int64), h[j].view(np.int64)
                yield np.minimum(a, b), np.maximum(a, b)


def near_pairs(hashes: DataFrame, below: int, bands: int | None = None) -> DataFrame:
    """(a, b), a < b, of all pairs of values of column h (BIGINT, each once) that differ in fewer than `below` bits, which
    should be few. hashes is read more than once. Null hashes are in no pair. An empty table has no pairs.

    A hash is moved once for each band that can be the first in common; a cell of over PIECE hashes is cut in pieces of
    which every two meet in a task of their own.
    """
    h = hashes.select("h").where("h is not null")
    m = bands or shared_bands_for(max(1, hashes.count()), below)
    first = F.array(*[_key(F.col("h"), i, m) * m + i for i in range(below)])
    cells = h.select("h", F.explode(first).alias("cell"))
    # no more cells than bands times their values
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    mine = F.pmod(F.xxhash64("h"), F.col("pieces")).cast("int").alias("mine")
    met = cells.join(F.broadcast(sizes), "cell").select("cell", "h", mine, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    met = met.select("cell", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "h")

    def pairs(table: pa.Table) -> pa.Table:
        cell, p, q = (table.column(c)[0].as_py() for c in ("cell", "p", "q"))
        mine = table.column("mine").to_numpy()
        sides = np.where(mine == p, 1, 2).astype(np.int8) if p < q else np.zeros(len(mine), np.int8)
        found = list(near_in_cell(table.column("h").to_numpy(), sides, cell % m, m, below))
        a, b = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        return pa.table({"a": a, "b": b})

    return met.groupBy("cell", "p", "q").applyInArrow(pairs, "a long, b long")
