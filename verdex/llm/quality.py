"""Operator 4: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Tokens are runs of word characters and runs of other visible characters; a token
equal (ignoring case) to the one before it is written as one fixed mark, so that
repetition is a feature of its own.  Unigrams and bigrams are hashed into a fixed
number of weights; a text's value for a feature is its share of the text's
n-grams, so the score is a sparse dot product: the mean weight of the n-grams.

``train`` reads a bounded sample of labelled rows (a hash of the id picks
them, so every source and size is treated alike); scoring covers every whole text.
The sample has about ``SAMPLE_ROWS`` rows and ``SAMPLE_CHARS`` characters at most, so long
texts make it fewer rows, never shorter ones.

Texts that are null or without tokens get the score of the bias alone.  A score equal to
the threshold is predicted 1.  A text that comes with several labels is learnt once for
each; the queries give one, the greatest.  Rows that repeat are scored alike, each for
itself, whatever their batch; an empty table gives none, and without labelled rows the
score is that of no knowledge, 0.5.  Very long texts are scored whole; an operator cuts its
batches by bytes, so a task holds one such text at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.llm.common import append_columns

TOKENS = regex.compile(r"\w+|[^\w\s]+")
#: Bounds of the sample of labelled rows that ``train`` fits on: rows and characters.
SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 12_000_000
BITS = 18
CACHED_WORDS = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)
REPEATED = 0x5851F42D4C957F2D


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h
        return h


class Features:
    """Hashed n-gram indices of many texts at once."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.get = WordHashes().__getitem__

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; then for all words in a row: unigram, bigram with the next word, is there a next word?"""
        find, get = TOKENS.findall, self.get
        words = [find(t) if t else [] for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        flat = [x for w in words for x in w]
        n = len(flat)
        exact = np.fromiter(map(get, flat), np.uint64, n)
        folded = np.fromiter(map(get, map(str.lower, flat)), np.uint64, n)
        goes_on = np.ones(n, bool)
        goes_on[np.cumsum(counts)[counts > 0] - 1] = False
        again = np.zeros(n, bool)
        again[1:] = (folded[1:] == folded[:-1]) & goes_on[:-1]
        exact[again] = np.uint64(REPEATED)
        after = np.zeros(n, np.uint64)
        after[:-1] = exact[1:]
        with np.errstate(over="ignore"):
            single = (exact * MIX) >> self.shift
            pairs = ((exact * np.uint64(0xC2B2AE3D27D4EB4F) + after) * MIX) >> self.shift
        return counts, single.astype(np.int64), pairs.astype(np.int64), goes_on


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def scorer(self):
        features = Features(self.bits)

        def score(texts: list) -> np.ndarray:
            counts, single, pairs, goes_on = features(texts)
            total = np.zeros(len(texts))
            full = np.flatnonzero(counts)
            if len(full):
                each = self.weights[single].astype(np.float64) + np.where(goes_on, self.weights[pairs], 0.0)
                starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                total[full] = np.add.reduceat(each, starts) / (2 * counts[full] - 1)
            return 1.0 / (1.0 + np.exp(-np.clip(self.bias + SCALE * total, -35, 35)))

        return score


#: The shares of n-grams are small numbers; this factor brings them into the range of the learning rate.
SCALE = 10.0


@dataclass
class Trainer:
    """FTRL-proximal with per-coordinate rates (McMahan et al., 2013)."""

    bits: int = BITS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(index)
        p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w @ values)))))
        g = (p - label) * values
        sigma = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] += g * g


def fit(texts: list[str], labels: list[int], bits: int = BITS, epochs: int = 3, seed: int = 7) -> Model:
    """Learn from texts in memory; without both labels the score is the share of label 1."""
    if len(set(labels)) < 2:
        share = sum(labels) / len(labels) if labels else 0.5
        return Model(np.zeros(1 << bits, np.float32), math.log((share + 1e-3) / (1 - share + 1e-3)), bits)
    features, trainer = Features(bits), Trainer(bits)
    rows = []
    for text, label in zip(texts, labels):
        _, single, pairs, goes_on = features([text])
        index = np.concatenate([single, pairs[goes_on]])
        at, count = np.unique(index, return_counts=True)
        values = SCALE * count / max(1, len(index))
        rows.append((np.append(at, 1 << bits).astype(np.int32), np.append(values, 1.0).astype(np.float32), label))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            trainer.learn(*rows[i])
    w = trainer.weights(slice(None))
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def hash_sample(rows: DataFrame, key: str, bounds: list[tuple[Column, int]]) -> DataFrame:
    """Rows picked by a hash of the key so that each summed weight is about its bound at most; all rows where they fit."""
    totals = rows.agg(*[F.sum(weight).alias(f"w{i}") for i, (weight, _) in enumerate(bounds)]).first()
    share = min([1.0, *(bound / total for total, (_, bound) in zip(totals, bounds) if total)])
    if share >= 1.0:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(41)), F.lit(1 << 31)) < int(share * (1 << 31)))


def train(labelled: DataFrame, text: str, label: str, key: str, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on about ``sample_rows`` rows and ``sample_chars`` characters at most; rows without label count as none."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"))
    sample = hash_sample(rows, "key", [(F.lit(1), sample_rows), (F.length("text"), sample_chars)])
    got = sample.toPandas().sort_values(["key", "text"], kind="stable")
    return fit(got["text"].tolist(), [int(x) for x in got["label"]])


def score(df: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Add the probability of label 1 and whether it reaches the threshold."""

    def make():
        scorer = model.scorer()

        def apply(texts: list) -> list[pa.Array]:
            p = scorer(texts)
            return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]

        return apply

    return append_columns(df, make, [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())], on=text, keep=keep)
