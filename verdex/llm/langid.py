"""Operator 1: language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over them; each filter's
largest response in a fixed-length window goes through a softmax layer.  The
network is trained in numpy on labelled text.  To predict, the embedding and the
filters fold into tables by byte pair, so a response is a sum of table rows.  All
windows of a text are scored, the last one filled up with zero bytes; the text's
probabilities are the mean over its windows, weighted by their lengths.  A score
depends on the text alone, to the last bit: neither on its batch nor on its place.

Training reads all windows of the sampled texts.  The sample has about
``SAMPLE_DOCS`` texts and ``SAMPLE_CHARS`` characters a language at most; a hash of
the id picks whole texts.

``und`` (score 0) is predicted for null texts and texts without a letter, and for
every text when there is nothing to learn from.  Languages that tie: the first by
name.  Rows that repeat are predicted alike, each for itself; an empty table gives none.
Of a very long text ``SLAB`` windows are scored at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.llm.common import append_columns

WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
WINDOW = 256
PAD = max(WIDTHS)
#: Bounds of the training sample of each language.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 600_000
EPOCHS = 4
#: Windows that are scored at once.
SLAB = 512
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    offsets: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def scorer(self):
        """A function from texts to (language or None, score) pairs."""
        e = self.embedding
        tables = []
        for w in self.filters:
            rows = [e @ w[k] for k in range(len(w))]
            pairs = [(rows[k][:, None, :] + rows[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(w) - 1, 2)]
            tables.append(([np.ascontiguousarray(p, dtype=np.float32) for p in pairs], rows[-1].astype(np.float32) if len(w) % 2 else None))
        # What the filters answer to zero bytes: the filling of a text's last window.
        blank = np.concatenate([sum((p[0] for p in pairs), np.float32(0)) + (last[0] if last is not None else 0) for pairs, last in tables])

        def score(texts: list) -> tuple[list[str], list[float]]:
            data = [t.encode("utf-8") if t and LETTER.search(t) else b"" for t in texts]
            lengths = np.array([len(d) for d in data])
            found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
            full = np.flatnonzero(lengths)
            if not len(full) or not self.languages:
                return [f[0] for f in found], [f[1] for f in found]
            buffer = np.frombuffer(bytes(PAD).join([data[i] for i in full]) + bytes(PAD), np.uint8)
            begin = np.concatenate([[0], np.cumsum(lengths[full] + PAD)[:-1]])
            windows = -(-lengths[full] // WINDOW)
            starts = np.repeat(begin, windows) + WINDOW * (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
            owner = np.repeat(np.arange(len(full)), windows)
            size = np.minimum(WINDOW, np.repeat(begin + lengths[full], windows) - starts)
            total = np.zeros((len(full), len(self.languages)))
            for at in range(0, len(starts), SLAB):
                slab = slice(at, at + SLAB)
                first, stop = starts[at], starts[slab][-1] + size[slab][-1] + PAD
                p = self.windows(tables, blank, buffer[first:stop], starts[slab] - first, size[slab])
                np.add.at(total, owner[slab], p * size[slab][:, None])  # in order, so slabs change no bit
            total /= total.sum(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            for k, i in enumerate(full):
                found[i] = (self.languages[best[k]], float(total[k, best[k]]))
            return [f[0] for f in found], [f[1] for f in found]

        return score

    def windows(self, tables: list, blank: np.ndarray, part: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probabilities of some windows of a buffer; what is held meanwhile grows with these alone."""
        pair = part[:-1].astype(np.int32) * 256 + part[1:]
        n = len(part) - PAD + 1
        bounds = np.stack([starts, starts + size], axis=1).ravel()
        pooled = []
        for pairs, last in tables:
            response = pairs[0].take(pair[:n], axis=0)
            for k, p in enumerate(pairs[1:], 1):
                response += p.take(pair[2 * k : 2 * k + n], axis=0)
            if last is not None:
                response += last.take(part[2 * len(pairs) : 2 * len(pairs) + n], axis=0)
            # Every second stretch is a window; those between are padding.
            pooled.append(np.maximum.reduceat(response, bounds, axis=0)[::2])
        pooled = np.concatenate(pooled, axis=1)
        pooled = np.where((size < WINDOW)[:, None], np.maximum(pooled, blank), pooled)
        hidden = np.maximum(pooled + self.offsets, 0)
        # Sums along a row do not depend on the other rows, as a matrix product's may.
        logits = np.stack([(hidden * column).sum(axis=1) for column in self.dense.T], axis=1) + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def cut_windows(text: bytes) -> list[bytes]:
    """All windows of a text, each with the bytes that filters at its end look at."""
    return [text[i : i + WINDOW + PAD - 1] for i in range(0, len(text), WINDOW)]


def fit(texts: list[str], languages: list[str], seed: int = 3) -> Model:
    """Train on texts in memory: Adam on the cross entropy of window labels."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    rows, labels = [], []
    for text, language in zip(texts, languages):
        for w in cut_windows(text.encode("utf-8")):
            rows.append(w)
            labels.append(names.index(language))
    width = WINDOW + PAD - 1
    x = np.zeros((len(rows), width), np.uint8)
    for i, w in enumerate(rows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    y = np.array(labels)
    e = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
    e[0] = 0
    filters = [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
    offsets = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    dense = rng.normal(0, 0.1, (len(offsets), max(1, len(names)))).astype(np.float32)
    bias = np.zeros(max(1, len(names)), np.float32)
    params = [e, *filters, offsets, dense, bias]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    share = np.bincount(y, minlength=len(names)) / max(1, len(y)) if len(names) else None
    for _ in range(EPOCHS if len(names) > 1 else 0):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            xb, yb, m = x[at].astype(np.int64), y[at], len(at)
            emb = e[xb]
            span = width - PAD + 1
            pooled, where = [], []
            for w in filters:
                r = sum(emb[:, k : k + span] @ w[k] for k in range(len(w)))
                top = r.argmax(axis=1)
                where.append(top)
                pooled.append(np.take_along_axis(r, top[:, None, :], axis=1)[:, 0])
            h = np.concatenate(pooled, axis=1) + offsets
            a = np.maximum(h, 0)
            z = a @ dense + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            weight = (1 / (len(names) * share[yb])).astype(np.float32)
            g = p.copy()
            g[np.arange(m), yb] -= 1
            g *= (weight / m)[:, None]
            gh = (g @ dense.T) * (h > 0)
            grads = [np.zeros_like(e), *[np.zeros_like(w) for w in filters], gh.sum(0), a.T @ g, g.sum(0)]
            for j, w in enumerate(filters):
                part = gh[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(len(w)):
                    spots = where[j] + k
                    byte = np.take_along_axis(xb, spots, axis=1)
                    seen = e[byte]
                    grads[1 + j][k] = np.einsum("bf,bfd->df", part, seen)
                    np.add.at(grads[0], byte.ravel(), (part[:, :, None] * w[k].T[None]).reshape(-1, EMBEDDING))
            step += 1
            for q, d, mean, square in zip(params, grads, means, squares):
                mean += 0.1 * (d - mean)
                square += 0.001 * (d * d - square)
                q -= (0.01 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(names, e, filters, offsets, dense, bias)


def train(labelled: DataFrame, text: str, language: str, key: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on about ``sample_docs`` texts and ``sample_chars`` characters of each language at most; rows with a null in either are left out."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(language).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(language).alias("language"))
    totals = rows.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    if not totals:
        return fit([], [])
    shares = {r["language"]: min(1.0, sample_docs / r["n"], sample_chars / r["chars"]) for r in totals}
    share = F.create_map(*[F.lit(v) for k, x in sorted(shares.items()) for v in (k, int(x * (1 << 31)))])
    picked = rows.where(F.pmod(F.xxhash64("key", F.lit(23)), F.lit(1 << 31)) < share[F.col("language")])
    got = picked.toPandas().sort_values(["key", "text"], kind="stable")
    return fit(got["text"].tolist(), got["language"].tolist())


def predict(df: DataFrame, model: Model, text: str = "text", language: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the predicted language and its probability."""

    def make():
        scorer = model.scorer()

        def apply(texts: list) -> list[pa.Array]:
            names, p = scorer(texts)
            return [pa.array(names, pa.string()), pa.array(p, pa.float64())]

        return apply

    return append_columns(df, make, [T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())], on=text, keep=keep, limit=1 << 17)
