"""Reading level of each document (problem 9), by a Rasch-style latent difficulty model.

A sentence is a respondent with a latent level theta, a word (or trait of build) of a language an item with a difficulty
delta on the same scale: the log-odds that the word occurs in a sentence are alpha - gamma * (theta - delta)**2 plus two
threshold terms. Rasch's single slope doesn't fit, as words of easy sentences vanish from hard ones and words of middling
ones from both; gamma is the word's discrimination, alpha its frequency where level and difficulty meet, and the
thresholds (a step, a gap between levels; orthogonal to the rest) let words begin or end sharply at a level. A document of level L has sentences of
level k with chance T(L, k). Labels fix the documents' levels of a bounded sample; the sentences' levels, the words'
parameters and T are estimated in turn: each round is one distributed pass over the sentences, whose sums per word are
combined and turned into the word's parameters where they lie. Only the parameters, one row per word
of the labelled sample, reach the driver, which sends them out for the next pass. Every document is then scored whole:
its level is the one under which its sentences are most likely.

Running sentences end with a sentence mark and consist mostly of words that the model knows. A text without any, or with
more than LIST_LINES lines of a list or log to each, has no level (null), so label lists, logs, blank and null texts have
none. A line without a sentence mark at its end counts as one of a list or log; the lines of a hard-wrapped passage (each
goes on in lower case after an unfinished line) count as one. Lines are counted, not characters, so that a long quoted or
leaked block takes no level away. Repeated labels of a document are averaged; labels of unknown documents, null labels and
labels outside 1 to 5 are ignored. Without usable labels no document has a level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

LEVELS = 5
#: Bound of the fit: labelled documents (those of smallest hash are taken if there are more). All their words and
#: languages take part.
MOST_LABELLED = 20_000
#: A word or trait counts from so many labelled sentences on.
LEAST_SENTENCES = 4
ROUNDS = 6
#: Levels on the latent scale, and what a word's log-odds are made of there.
#: Ridge on slope, discrimination and thresholds.
RIDGE = [0.02, 0.02, 0.05, 0.05]
THETA = np.arange(LEVELS) - (LEVELS - 1) / 2
DESIGN = np.stack([np.ones(LEVELS), THETA, -(THETA**2), np.array([-1, 2, 0, -2, 1]), np.array([1, -4, 6, -4, 1]) / 2], 1)
#: Part of a sentence's words that must be known.
KNOWN = 0.5
#: Lines of a list or log to a running sentence, at most; a list or log that quotes a sentence stays one.
LIST_LINES = 2
#: A line of so many words can open a hard-wrapped passage; labels are shorter.
PASSAGE_WORDS = 4
_SPLIT = re.compile(r"(?<=[.!?])[\s]+|(?<=[。！？])(?![」』）)\"'])|(?<=[。！？][」』）)])|\n")
_END = re.compile(r"[.!?。！？][\"'」』）)]*$")
_TOKEN = re.compile(r"[^\W\d_ぁ-ヿ一-鿿]+|[ァ-ヺー]+|[ぁ-ゖ]+|[一-鿿々]+")
_GOES_ON = re.compile(r"[\s>*#|•·–-]*(?:\d+\s+)?([^\W\d_ぁ-ヿ一-鿿])")
_OPENING = re.compile(r"(?<=、)[ぁ-ゖ一-鿿々]{2,8}")


def sentences(text: str) -> list[str]:
    """Pieces of a text that end with a sentence mark."""
    return [s for x in _SPLIT.split(text) if x and _END.search(s := x.rstrip())]


def list_lines(text: str) -> int:
    """Lines that end without a sentence mark, those of a hard-wrapped passage as one."""
    n, passage = 0, False
    for line in text.split("\n"):
        pieces = [x for x in _SPLIT.split(line) if x and not x.isspace()]
        if not pieces:
            continue
        goes_on = passage and (m := _GOES_ON.match(line)) is not None and m[1].islower()
        unfinished = not _END.search(pieces[-1].rstrip())
        n += unfinished and not (goes_on and len(pieces) == 1)
        passage = unfinished and (goes_on or len(_TOKEN.findall(pieces[-1])) >= PASSAGE_WORDS)
    return n


def words(sentence: str) -> set[str]:
    """Words, and for text without blanks runs of one script and pairs of characters of the longer ones."""
    out = set(_TOKEN.findall(sentence.lower()))
    for x in [x for x in out if x[0] >= "一" and len(x) > 2]:
        out.update(x[i : i + 2] for i in range(len(x) - 1))
    return out


def traits(sentence: str) -> set[str]:
    """Length, number of clauses, and how clauses open."""
    commas = sentence.count(",") + sentence.count("、")
    return {f"#c{min(commas, 6)}", f"#n{int(2 * np.log2(max(1.0, len(sentence) / 4)))}", *(f"#o{m}" for m in _OPENING.findall(sentence))}


def parameters(n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(alpha', beta, gamma, two thresholds) of each word from its occurrences n [word, level] in q [word, level]
    sentences: log-odds alpha' + beta * theta - gamma * theta**2 + thresholds, so that delta = beta / (2 * gamma).

    Berkson's estimate: least squares on the empirical log-odds, each weighted by its information; two sentences of the
    word's mean rate stand in at every level, and a ridge keeps rare words near no effect."""
    mean = n.sum(1, keepdims=True) / q.sum(1, keepdims=True)
    p = np.clip((n + 2 * mean + 1e-3) / (q + 2.01), 1e-5, 1 - 1e-5)
    weight = np.maximum(q * p * (1 - p), 1)
    left = np.einsum("wk,ki,kj->wij", weight, DESIGN, DESIGN) + np.diag([0, *RIDGE])
    right = (weight * (np.log(p) - np.log1p(-p))) @ DESIGN
    return np.linalg.solve(left, right[..., None])[..., 0]


class Model:
    """languages, words (language number, word), x: parameters of each word, spread: T [document, sentence]."""

    def __init__(self, languages: list[str], words_: list[tuple[int, str]], x: np.ndarray, spread: np.ndarray) -> None:
        self.languages, self.words, self.x, self.spread = languages, words_, x, spread
        self.at: list[dict[str, int]] = [{} for _ in languages]
        for i, (g, w) in enumerate(words_):
            self.at[g][w] = i
        odds = np.clip(x @ DESIGN.T, -14, 8)
        self.odds = odds
        self.base = np.zeros((len(languages), LEVELS))
        np.add.at(self.base, np.array([g for g, _ in words_], np.int64), -np.log1p(np.exp(odds)))

    def difficulty(self) -> np.ndarray:
        """delta of each word, in levels, cut to one beyond the scale's ends."""
        return np.clip(np.where(self.x[:, 2] > 0, self.x[:, 1] / np.maximum(2 * self.x[:, 2], 1e-6), np.sign(self.x[:, 1]) * 9), THETA[0] - 1, THETA[-1] + 1) + (LEVELS + 1) / 2

    def known(self, w: set[str], last: int) -> tuple[int, list[int]]:
        """The language that knows most of the words, the last one first, and their numbers there."""
        best: tuple[int, list[int]] = (last, [i for x in w if (i := self.at[last].get(x)) is not None])
        if len(best[1]) < 0.8 * len(w):
            for g, at in enumerate(self.at):
                found = [i for x in w if (i := at.get(x)) is not None]
                if len(found) > len(best[1]):
                    best = (g, found)
        return best

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Level (0: none) and number of running sentences of each text."""
        doc, tongue, ids, starts = [], [], [], []
        last = 0
        for d, t in enumerate(texts):
            running = []
            for s in sentences(t) if t else []:
                if w := words(s):
                    g, found = self.known(w, last)
                    if found and len(found) >= KNOWN * len(w):
                        last = g
                        running.append((s, g, found))
            most = LIST_LINES * len(running)
            if not running or (t.count("\n") >= most and list_lines(t) > most):
                continue
            for s, g, found in running:
                doc.append(d)
                tongue.append(g)
                starts.append(len(ids))
                ids += found
                ids += [i for x in traits(s) if (i := self.at[g].get(x)) is not None]
        level, n = np.zeros(len(texts), np.int32), np.bincount(np.array(doc, np.int64), minlength=len(texts))
        if not doc:
            return level, n
        ll = self.base[np.array(tongue)] + np.add.reduceat(self.odds[np.array(ids)], np.array(starts), axis=0)
        p = np.exp(ll - ll.max(1, keepdims=True)) @ self.spread.T
        total = np.zeros((len(texts), LEVELS))
        np.add.at(total, np.array(doc), np.log(p))
        has = n > 0
        level[has] = total[has].argmax(1) + 1
        return level, n


def _spread(q: np.ndarray) -> np.ndarray:
    k = np.arange(LEVELS)
    t = q + np.exp(-1.6 * np.abs(k[:, None] - k[None]))
    return t / t.sum(1, keepdims=True)


def _document_weights(level: np.ndarray) -> np.ndarray:
    """Mean of labels -> weights of the two nearest levels."""
    return np.clip(1 - np.abs(level[:, None] - np.arange(1, LEVELS + 1)[None]), 0, 1)


def fit(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """documents: doc_id, text, lang; labels: doc_id, level. Labelled documents without lang don't take part."""
    sc = documents.sparkSession.sparkContext
    marks = labels.where(F.col("level").between(1, LEVELS) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("level").alias("mean"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    sample = documents.where("text is not null and lang is not null").select("doc_id", "text", "lang").join(F.broadcast(marks), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lv, g, sorted(w | traits(s))) for t, g, lv in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "mean"))) for s in sentences(t) if (w := words(s))]
            mean, lang, w = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(mean, pa.float64()), pa.array(lang, pa.string()), pa.array(w, pa.list_(pa.string()))], names=["mean", "lang", "words"])

    cuts = checkpoint(sample.mapInArrow(cut, "mean double, lang string, words array<string>"))
    counts = cuts.select("lang", F.explode("words").alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SENTENCES)
    listed = counts.select("lang", "w").orderBy("lang", "w").collect()  # words of the bounded sample
    if not listed:
        return None
    languages = sorted({r.lang for r in listed})
    lang_at = {g: i for i, g in enumerate(languages)}
    words_ = [(lang_at[r.lang], r.w) for r in listed]
    sent = sc.broadcast({(g, w): i for i, (g, w) in enumerate(words_)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for b in batches:
            lang = [lang_at.get(g, -1) for g in b.column(1).to_pylist()]
            ids = [[i for x in w if (i := at.get((g, x))) is not None] for g, w in zip(lang, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["mean", "lang", "ids"])

    coded = checkpoint(cuts.mapInArrow(encode, "mean double, lang int, ids array<int>").where("lang >= 0 and size(ids) > 0"))
    n_words, n_lang = len(words_), len(languages)
    word_lang = np.array([g for g, _ in words_], np.int64)
    spread, model = _spread(np.zeros((LEVELS, LEVELS))), None
    for turn in range(rounds):
        now = sc.broadcast(None if model is None else (model.odds, model.base))

        def sums(batches: Iterator[pa.RecordBatch], spread=spread, now=now) -> Iterator[pa.RecordBatch]:
            """Expected numbers by level: of sentences with each word (key 0 and up), of all sentences of each language
            (-1 - language), and by levels of documents (-1 - languages - level)."""
            n, q_all, t_all = np.zeros((n_words, LEVELS)), np.zeros((n_lang, LEVELS)), np.zeros((LEVELS, LEVELS))
            for b in batches:
                if not b.num_rows:
                    continue
                lang, ids = b.column(1).to_numpy(zero_copy_only=False), b.column(2)
                length = np.diff(ids.offsets.to_numpy())
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(b.num_rows), length)
                weights = _document_weights(b.column(0).to_numpy(zero_copy_only=False))
                q = weights @ spread
                if now.value is not None:
                    odds, base = now.value
                    x = base[lang] + np.log(q + 1e-12)
                    np.add.at(x, of, odds[flat])
                    q = np.exp(x - x.max(1, keepdims=True))
                    q /= q.sum(1, keepdims=True)
                for k in range(LEVELS):
                    n[:, k] += np.bincount(flat, weights=q[of, k], minlength=n_words)
                np.add.at(q_all, lang, q)
                t_all += weights.T @ q
            some = np.flatnonzero(n.any(1))
            keys = np.concatenate([some, -1 - np.arange(n_lang), -1 - n_lang - np.arange(LEVELS)])
            values = np.concatenate([n[some], q_all, t_all])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *(pa.array(values[:, k]) for k in range(LEVELS))], names=["key", *(f"v{k}" for k in range(LEVELS))])

        cols = [f"v{k}" for k in range(LEVELS)]
        added = checkpoint(coded.mapInArrow(sums, "key int, " + ", ".join(f"{c} double" for c in cols)).groupBy("key").agg(*[F.sum(c).alias(c) for c in cols]))
        q_all, t_all = np.zeros((n_lang, LEVELS)), np.zeros((LEVELS, LEVELS))
        for r in added.where("key < 0").collect():
            k = -1 - r.key
            (q_all if k < n_lang else t_all)[k if k < n_lang else k - n_lang] = r[1:]

        def solve(batches: Iterator[pa.RecordBatch], q_all=q_all) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    key = b.column(0).to_numpy()
                    x = parameters(np.stack([b.column(1 + k).to_numpy() for k in range(LEVELS)], 1), q_all[word_lang[key]] + 1e-9)
                    yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["key", *"abcde"])

        got = added.where("key >= 0").mapInArrow(solve, "key int, " + ", ".join(f"{c} double" for c in "abcde")).toPandas()
        x = np.zeros((n_words, DESIGN.shape[1]))
        x[:, 0] = -14
        x[got.key] = got[[*"abcde"]].to_numpy()
        if turn >= 1:
            spread = _spread(t_all)
        model = Model(languages, words_, x.astype(np.float32).astype(float), spread)
    return model


def levels(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, level, n_sentences) of every document; level null: none."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(None if model is None else (model.languages, model.words, model.x, model.spread))  # a row per word of the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if sent.value is None else Model(*sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                level, n = (np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows, np.int64)) if m is None else m.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(level, pa.int32(), mask=level == 0), pa.array(n, pa.int32())], names=["doc_id", "level", "n_sentences"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, level int, n_sentences int")
