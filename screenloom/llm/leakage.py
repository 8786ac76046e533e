"""Evaluation texts leaking into documents (problem 7), by winnowing.

Texts are compared by their letters and digits after compatibility folding and case folding; all else only parts words,
and invisible characters don't even do that. A stream is the sequence of words, or, for items of languages written
without blanks, of single letters and digits. Each k-gram of a stream is hashed, and of every window of w neighbouring
hashes the least is kept: any run of k + w - 1 shared words (letters) has a kept hash in common. Hashes kept of items
and documents are joined; each hit is extended along its diagonal, and the longest shared run decides.

Null texts have no words. Items shorter than the least run can't leak. Texts are processed whole, of any length; tables
may be empty; a repeated document or item is reported under each of its ids.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, hot_join, split_join

#: Least run of words; of letters or digits for languages without blanks. k-gram and window add up to one more.
RUN = {"w": 12, "c": 30}
KGRAM = {"w": 7, "c": 16}
WITHOUT_BLANKS = ("ja",)
#: Kept hashes of the items, hits, and letters of the items' texts, that may be broadcast; with more, the joins are
#: shuffled, frequent hashes and items in pieces.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 20_000_000
#: Texts are hashed together up to so many characters.
CHARS = 1_500_000
_SEP, _KEEP, _DROP = 0, 1, 2
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@cache
def classes() -> np.ndarray:
    """For each code point whether it parts words, belongs to them or is passed over."""
    kinds = {"L": _KEEP, "N": _KEEP, "M": _KEEP}
    return np.fromiter((_DROP if (c := unicodedata.category(chr(i))) == "Cf" else kinds.get(c[0], _SEP) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_B), -1, 1 << 64))
    out = []
    for base in (_B, inverse):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept characters of all texts, whether each begins a word, and the number of its text."""
    joined = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", "\0".join(t.replace("\0", " ") for t in texts)).casefold())
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[raw]
    if (kind == _DROP).any():
        raw, kind = raw[kind != _DROP], kind[kind != _DROP]
    keep = kind == _KEEP
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    return raw[keep], first[keep], np.cumsum(raw == 0, dtype=np.int64)[keep]


def _ranges(chars: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each chars[lo:hi], from running sums of a polynomial modulo 2**64."""
    size = 1 << max(12, int(len(chars)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(_mix(chars.astype(np.uint64) + np.uint64(1)) * power[: len(chars)], out=sums[1:])
    return _mix((sums[hi] - sums[lo]) * inverse[lo])


def stream(texts: list[str], unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash-ready characters, start and end of each word (letter), and its text's number."""
    chars, first, doc = fold(texts)
    if unit == "w":
        chars = chars.astype(np.uint64) + (first.astype(np.uint64) << np.uint64(21))
        lo = np.flatnonzero(first)
    else:
        lo = np.arange(len(chars))
    return chars, lo, np.append(lo[1:], len(chars)) if len(lo) else lo, doc[lo] if len(lo) else lo


def _sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each window of w neighbours, by doubling."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = f(out[:-step], out[step:])
        done += step
    return out


def winnow(texts: list[str], unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, position and hash of each kept k-gram. Ties are all kept."""
    k, w = KGRAM[unit], RUN[unit] - KGRAM[unit] + 1
    chars, lo, hi, doc = stream(texts, unit)
    if len(lo) < k:
        return doc[:0], lo[:0], lo[:0].astype(np.uint64)
    h = _ranges(chars, lo[: len(lo) - k + 1], hi[k - 1 :])
    whole = doc[: len(lo) - k + 1] == doc[k - 1 :]
    h = np.where(whole, h, _NONE)
    # windows that reach over the ends of the stream or of a text only keep more
    pad = np.full(w - 1, _NONE)
    least = _sliding(np.concatenate([pad, h, pad]), w, np.minimum)
    kept = np.flatnonzero(whole & (_sliding(least, w, np.maximum) == h))
    word_at = np.arange(len(lo)) - np.searchsorted(doc, doc, "left")
    return doc[kept], word_at[kept], h[kept]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids: list = []
    texts: list[str] = []
    n = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            n += len(t)
            if n >= CHARS:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _fingerprints(units: str, wanted=None):
    """wanted: broadcast, for each unit the sorted hashes that others are dropped for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            key = np.array(ids, np.int64)
            for unit in units:
                if wanted is not None and not len(wanted.value[unit]):
                    continue
                doc, at, h = winnow(texts, unit)
                if wanted is not None and len(doc):
                    known = wanted.value[unit]
                    hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                    doc, at, h = doc[hit], at[hit], h[hit]
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(key[doc]), pa.array([unit] * 1).take(pa.array(np.zeros(len(doc), np.int8))), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32))], names=["id", "unit", "fp", "at"])

    return run


def fingerprints(df: DataFrame, row: str, text: str, units: str = "wc", wanted=None) -> DataFrame:
    """(id, unit, fp, at): kept hashes of each text and their positions, in words ('w') or letters ('c')."""
    return df.where(F.col(text).isNotNull() & F.col(row).isNotNull()).select(F.col(row).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_fingerprints(units, wanted), "id long, unit string, fp long, at int")


def longest_run(doc: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[int, int]:
    """Longest run of equal entries of two sequences along the given diagonals (doc index minus item index), and its start in doc."""
    best = (0, 0)
    for d in diagonals:
        a, b = max(0, d), min(len(doc), len(item) + d)
        if b <= a:
            continue
        same = np.concatenate([[False], doc[a:b] == item[a - d : b - d], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        if len(edge):
            n = edge[:, 1] - edge[:, 0]
            i = int(np.argmax(n))
            best = max(best, (int(n[i]), -(a + int(edge[i, 0]))))
    return best[0], -best[1]


def _sequence(text: str, unit: str) -> np.ndarray:
    chars, lo, hi, _ = stream([text], unit)
    return _ranges(chars, lo, hi) if len(lo) else np.zeros(0, np.uint64)


def _extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        known: dict[tuple[str, str], np.ndarray] = {}
        out = []
        for r in pdf.itertuples(index=False):
            for text in (r.doc_text, r.item_text):
                if (text, r.unit) not in known:
                    known[text, r.unit] = _sequence(text, r.unit)
            n, at = longest_run(known[r.doc_text, r.unit], known[r.item_text, r.unit], list(r.diagonals))
            if n >= RUN[r.unit]:
                out.append((r.doc_id, r.item_id, r.unit, n, at))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "unit", "run", "at"])


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, unit, run, at): every document that shares a long enough run with an item, the longest run's
    length in words or letters and where it begins in the document. documents: doc_id, text; items: item_id, lang, text."""
    unit_of = F.when(F.col("lang").isin(*WITHOUT_BLANKS), "c").otherwise("w")
    tests = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), unit_of.alias("unit"), F.col("text").alias("item_text"))
    wanted = tests.select(F.col("item_id").alias("_i"), F.col("unit").alias("_u"))
    of_items = fingerprints(tests, "item_id", "item_text").join(wanted, (F.col("id") == F.col("_i")) & (F.col("unit") == F.col("_u")), "left_semi").select(F.col("id").alias("item_id"), "unit", "fp", F.col("at").alias("item_at")).distinct()
    of_items = checkpoint(of_items)
    few_items = of_items.count() <= BROADCAST_ROWS
    wanted = None
    if few_items:  # a measured number of hashes of the items; documents' other hashes needn't leave their batch
        fps = of_items.select("unit", "fp").distinct().toPandas()
        wanted = documents.sparkSession.sparkContext.broadcast({u: np.sort(fps.fp[fps.unit == u].to_numpy(np.int64).view(np.uint64)) for u in "wc"})
    of_docs = fingerprints(documents, "doc_id", "text", wanted=wanted).select(F.col("id").alias("doc_id"), "unit", "fp", "at")
    hits = of_docs.join(F.broadcast(of_items), ["unit", "fp"]) if few_items else split_join(of_docs, of_items, ["unit", "fp"], 100_000)
    pairs = hits.groupBy("doc_id", "item_id", "unit").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"))
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("doc_text"))
    # few documents hold passages: then all others needn't be shuffled to meet them
    pairs = checkpoint(pairs)
    few = (pairs.agg(F.sum(F.size("diagonals"))).first()[0] or 0) <= BROADCAST_ROWS
    both = texts.join(F.broadcast(pairs) if few else pairs, "doc_id")
    short = (tests.agg(F.sum(F.length("item_text"))).first()[0] or 0) <= BROADCAST_CHARS
    both = both.join(F.broadcast(tests), ["item_id", "unit"]) if short else hot_join(both, tests, ["item_id", "unit"], counted=pairs)
    found = both.mapInPandas(_extend, "doc_id long, item_id long, unit string, run int, at int")
    return found.groupBy("doc_id", "item_id", "unit").agg(F.max(F.struct("run", F.col("at"))).alias("m")).select("doc_id", "item_id", "unit", F.col("m.run").alias("run"), F.col("m.at").alias("at"))
