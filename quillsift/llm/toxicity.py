"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a learned lexicon (whole words and word beginnings, after undoing common character
swaps), how close its hits stand to second-person words, capitals, punctuation and obfuscation rates, length. Lexicon
and trees are fitted on training remainders 1 to 3, the calibration on remainder 4; at most MAX_TRAINING labelled rows
are used. Scoring reads whole texts in Arrow batches; null texts count as empty and get the score of an empty text.
Without labels of both kinds the score is their share, 0 without any.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import arrow_batches, held_out
from quillsift.llm.labelled import training_rows

MAX_TRAINING = 20_000
LEXICON_SIZE = 2_000
MIN_TOXIC_DOCS = 4
PREFIXES = (4, 5, 6)
NEAR = 6
CACHE = 400_000

#: Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre vos du dich dir ihr euch dein deine sie tú ti usted ustedes vosotros tus su".split())
#: Characters that stand in for letters.
SWAPS = str.maketrans("0134578@$!+|", "oieastbasitl")
_EDGE = ".,;:!?\"'()[]{}<>*-_/\\#%&|$~^`"

FEATURES = ("word_density", "word_max", "word_hits", "prefix_density", "prefix_max", "prefix_hits", "near_second", "second_rate", "upper_rate", "exclaim_rate", "punct_rate", "obfuscated_rate", "log_words")


def plain(word: str) -> tuple[str, bool]:
    """(word without edges, swaps undone and inner symbols dropped; whether that changed it)."""
    core = word.strip(_EDGE)
    if core.isalpha():
        return core, False
    if not any(c.isalpha() for c in core):
        return "", False
    clear = "".join(c for c in core.translate(SWAPS) if c.isalpha())
    return clear, any(a.isalpha() and not b.isalpha() and b not in "'-’." for a, b in zip(core, core[1:], strict=False))


def vocabulary(text: str) -> set[str]:
    """What a text offers to the lexicon: plain words, and word beginnings marked by their length."""
    out = set()
    for w in set(text.lower().split()):
        p, _ = plain(w)
        if p:
            out.add(p)
            out.update(f"{n}^{p[:n]}" for n in PREFIXES if len(p) > n)
    return out


class Lexicon:
    """Weights of words and beginnings, with a bounded memory of words seen."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.seen: dict[str, tuple[float, float, bool, bool]] = {}

    def word(self, w: str) -> tuple[float, float, bool, bool]:
        """(word weight, best beginning's weight, second person, obfuscated)."""
        got = self.seen.get(w)
        if got is None:
            p, odd = plain(w)
            begin = max((self.weights.get(f"{n}^{p[:n]}", 0.0) for n in PREFIXES if len(p) > n), default=0.0)
            got = (self.weights.get(p, 0.0), begin, p in SECOND_PERSON, odd)
            if len(self.seen) > CACHE:
                self.seen.clear()
            self.seen[w] = got
        return got

    def features(self, text: str) -> list[float]:
        """One value for each of FEATURES."""
        words = text.lower().split()
        n = max(len(words), 1)
        of = self.word
        got = [of(w) for w in words]
        a = [x[0] for x in got]
        b = [x[1] for x in got]
        hits = [i for i, x in enumerate(got) if x[0] > 0 or x[1] > 0]
        second = [i for i, x in enumerate(got) if x[2]]
        near, k = 0, 0
        for i in hits:
            while k < len(second) and second[k] < i - NEAR:
                k += 1
            near += k < len(second) and second[k] <= i + NEAR
        chars = max(len(text), 1)
        letters = text.encode("ascii", "ignore")
        upper = sum(map(letters.count, _UPPER))
        punct = sum(map(letters.count, _PUNCT))
        return [
            sum(a) / n, max(a, default=0.0), float(sum(x > 0 for x in a)), sum(b) / n, max(b, default=0.0), float(sum(x > 0 for x in b)),
            near / n, len(second) / n, upper / chars, text.count("!") / n, punct / chars, sum(x[3] for x in got) / n, math.log1p(len(words)),
        ]


_UPPER = [bytes([c]) for c in range(65, 91)]
_PUNCT = [bytes([c]) for c in b"!?.,;:#*$%&|"]


class Trees:
    """Logistic gradient boosting with histogram splits; trees are complete and of equal depth."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.2, bins: int = 32, ridge: float = 2.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        coded = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-raw))
            g, h = q - y, q * (1 - q)
            node = np.zeros(len(y), int)
            features, values = [], []
            for level in range(self.depth):
                n = 1 << level
                best = np.full(n, 1e-9)
                feature, cut = np.zeros(n, int), np.full(n, np.inf)
                for f in range(x.shape[1]):
                    b = len(cuts[f]) + 1
                    key = node * b + coded[:, f]
                    gs, hs = (np.bincount(key, w, n * b).reshape(n, b).cumsum(1) for w in (g, h))
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    if not gl.shape[1]:
                        continue
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    at = gain.argmax(1)
                    top = gain[np.arange(n), at]
                    new = top > best
                    best[new], feature[new], cut[new] = top[new], f, cuts[f][at[new]]
                features.append(feature)
                values.append(cut)
                node = node * 2 + (x[np.arange(len(y)), feature[node]] > cut[node])
            n = 1 << self.depth
            leaf = -np.bincount(node, g, n) / (np.bincount(node, h, n) + self.ridge) * self.rate
            raw += leaf[node]
            self.trees.append((features, values, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, at = np.full(len(x), self.base), np.arange(len(x))
        for features, values, leaf in self.trees:
            node = np.zeros(len(x), int)
            for f, c in zip(features, values, strict=True):
                node = node * 2 + (x[at, f[node]] > c[node])
            out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (raw, probability), rising, shrunk a little from 0 and 1."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of raw
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
    return np.array([t / n for _, n, t in blocks]), np.array([(s + 0.5) / (n + 1) if n > 1 else s / n for s, n, _ in blocks])


class Model:
    """Lexicon, trees and calibration; picklable."""

    def __init__(self, weights: dict[str, float], trees: Trees | None, knots: tuple[np.ndarray, np.ndarray], share: float):
        self.weights, self.trees, self.knots, self.share = weights, trees, knots, share

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        a, p = self.knots
        smooth = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        # nearly all from isotonic regression; a trace of the raw order parts its ties
        return np.clip(0.98 * np.interp(raw, a, np.maximum.accumulate(p)) + 0.02 * smooth, 0, 1) if len(a) else smooth

    def scorer(self):
        """texts -> scores."""
        lexicon = Lexicon(self.weights)

        def score(texts: list[str]) -> np.ndarray:
            if self.trees is None or not texts:
                return np.full(len(texts), self.share)
            return self.calibrated(self.trees.raw(np.array([lexicon.features(t) for t in texts])))

        return score


def lexicon_weights(train: DataFrame) -> dict[str, float]:
    """Log odds of the entries that toxic training texts hold most above the others; counted on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, every = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if y else every).update(vocabulary(t))
        if toxic:  # an entry that no toxic text holds can't win
            names = list(toxic | every)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([toxic[k] for k in names], pa.int64()), pa.array([every[k] for k in names], pa.int64())], names=["entry", "toxic", "other"])
        elif every:
            names = list(every)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([0] * len(names), pa.int64()), pa.array(list(every.values()), pa.int64())], names=["entry", "toxic", "other"])

    n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    t, o = n.get(1, 0), n.get(0, 0)
    counts = train.select("text", "label").mapInArrow(count, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("other") + 0.5) / (o + 1))
    best = counts.filter(F.col("toxic") >= MIN_TOXIC_DOCS).withColumn("w", odds).filter("w > 1.5").orderBy(F.desc(F.col("w") * F.log1p("toxic")), "entry").limit(LEXICON_SIZE)
    return {r["entry"]: float(r["w"]) for r in best.select("entry", "w").collect()}


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> Model:
    """A model of labels.toxic."""
    arrow_batches(docs.sparkSession)
    train = training_rows(docs, labels, "toxic", most)
    weights = lexicon_weights(train.filter("part < 4"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for b in batches:
            got = [lexicon.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "label", "part"])

    got = train.select("text", "label", "part").mapInArrow(rows, "x array<double>, label int, part int").toArrow()
    x = np.array(got.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
    y, part = (np.asarray(got.column(k), float) for k in (1, 2))
    fitting = part < 4
    if len(np.unique(y[fitting])) < 2:
        return Model({}, None, (np.empty(0), np.empty(0)), float(y.mean()) if len(y) else 0.0)
    order = np.lexsort(x.T)  # rows come in any order; sums then don't depend on it
    x, y, fitting = x[order], y[order], fitting[order]
    trees = Trees().fit(x[fitting], y[fitting])
    knots = isotonic(trees.raw(x[~fitting]), y[~fitting]) if len(np.unique(y[~fitting])) == 2 else (np.empty(0), np.empty(0))
    return Model(weights, trees, knots, float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of([t or "" for t in b.column(1).to_pylist()]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
