"""Operator 10: maximum-scoring passages over token log-odds, calibrated by extreme-value theory.

Learning counts, by label, in how many labelled texts each token stands; a token
is a word, or a word's beginning of 4, 5 or 6 characters with a mark.  A word's score is
its log-odds ratio under nested Dirichlet priors: the rate of all words is the prior
of the shortest beginning, each beginning (less the words that share the next one) the
prior of the next, the longest that of the word.  So every counted token has a score
of its own, of either sign; a word never seen has that of its longest known beginning,
and without one that of the prior, 0.  From each word's score a constant ``DRIFT`` goes
off, the cost of lengthening a passage, which keeps passages short.  Counts say in how
many texts a token stands, so a word repeated within ``APART`` words brings its drift alone.

Counts are exact and of all tokens: a table of words with their texts by label, from
which the beginnings are summed and every token's score is computed, by joins.  Up to
``SENT_TOKENS`` tokens their scores travel to the workers as one array (counted before,
64 MB at most).  Beyond that they stay a table: the distinct words of each text are joined
with it and come back to the text.  Both ways give the same scores.

Scoring finds all maximal scoring segments (Ruzzo and Tompa) in linear time.  For
scores of that kind the best segment of a chance text follows an extreme-value
law: E = K * n * exp(-lambda * S).  lambda solves sum p_i exp(lambda s_i) = 1 over
all token scores in non-toxic texts; K is the maximum-likelihood estimate from the best
segments of all of these, texts without one being censored at 0.  The
evidence of a text is -log of the product of its segments' E-values where they
are significant, and a logistic curve through the calibration's own threshold
turns it into a score of 0 to 1.  Calibration counts are cross-fitted: each half of
the labelled texts is scored with the counts of the other half.

Nulls, empty texts and texts without words have no segment and get the lowest
evidence.  A score ties with the threshold on the toxic side.  A text that has several
labels is learnt once for each row given; rows that repeat are scored alike, each for
itself; an empty table gives none, and without both labels nothing is toxic.  Very long texts
are read and scored whole, one at a time in a task.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.llm.common import Scratch, append_columns, map_batches, materialize, slices, without

WORDS = re.compile(r"\w+")
#: Places that a prior counts for.
PRIOR = 4.0
DRIFT = 1.0
#: Words between two places of a word that both count.
APART = 64
#: Tokens whose scores are sent to the workers; more are joined.
SENT_TOKENS = 4_000_000
CACHED_WORDS = 100_000
FLUSH_WORDS = 40_000
PREFIXES = (4, 5, 6)
#: Bins of the calibration's evidence.
BINS, BIN = 400, 0.1


def token_hashes(tokens: Iterable[str], n: int) -> np.ndarray:
    """Hashes of ``n`` lower-case tokens: Spark's xxhash64."""
    return np.fromiter((xxhash.xxh64_intdigest(t, seed=42) for t in tokens), np.uint64, n)


@dataclass
class Scores:
    """Scores of tokens, by ascending hash."""

    hashes: np.ndarray
    values: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-odds of lower-case words less the drift: that of the word, or of its longest known beginning, or of the prior."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out, left = np.full(len(words), -DRIFT), np.ones(len(words), bool)
        # Beginnings are hashed where nothing longer is known; a word that is no longer than a beginning does not have it.
        for k in (None, *reversed(PREFIXES)):
            asked = np.flatnonzero(left if k is None else left & (sizes > k))
            if not len(asked):
                continue
            hashes = token_hashes(words if k is None else (words[i][:k] + "*" for i in asked.tolist()), len(asked))
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[asked[hit]] = self.values[at[hit]]
            left[asked[hit]] = False
        return out


class Given(dict):
    """Scores of the lower-case words of one text."""

    def scores(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.get(w, -DRIFT) for w in words), np.float64, len(words))


class WordScores(dict):
    """Scores of words as they are written, bounded; new ones are looked up together."""

    def __init__(self, table: Scores | Given | None):
        self.table = table

    def of(self, words: list[str]) -> np.ndarray:
        if self.table is None:
            return np.full(len(words), -DRIFT)
        got = list(map(self.get, words))
        missing = [i for i, s in enumerate(got) if s is None]
        if missing:
            fresh = list(dict.fromkeys(words[i] for i in missing))
            if len(self) >= CACHED_WORDS:  # the newer ones stay
                newest = dict(itertools.islice(self.items(), len(self) - CACHED_WORDS // 2, None))
                self.clear()
                self.update(newest)
            self.update(zip(fresh, self.table.scores(list(map(str.lower, fresh))).tolist()))
            for i in missing:
                got[i] = self[words[i]]
        return np.array(got, np.float64)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, stop, score) of Ruzzo and Tompa, in linear time."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # stack rows: first, stop, sum before, sum up to the end, row below it with a smaller sum before
    stack: list[list] = []
    for i in positive.tolist():
        row = [i, i + 1, sums[i], sums[i + 1], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= row[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= row[3]:
                row[4] = j
                stack.append(row)
                break
            row[0], row[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(e - s)) for a, b, s, e, _ in stack]


@dataclass
class Model:
    """``table`` has the tokens' scores, or ``tokens`` is the folder of a table of (token, score) where they are too many; neither where there is nothing to learn from."""

    table: Scores | None = None
    tokens: str | None = None
    decay: float = 1.0
    scale: float = 0.1
    threshold: float = 5.0

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        """-log of the product of the E-values below 1 (all segments past the best are scored against the same text)."""
        if not segments:
            return -math.log(self.scale * max(n, 1) + 1.0)
        base = math.log(self.scale * max(n, 1) + 1e-9)
        gains = [self.decay * s - base for _, _, s in segments]
        return sum(g for g in gains if g > 0) or max(gains)

    def score(self, evidence: float) -> float:
        """0.7 at the threshold."""
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, evidence - self.threshold + math.log(7 / 3)))))


class Scanner:
    def __init__(self, table: Scores | Given | None):
        self.known = WordScores(table)

    def scores(self, text: str | None) -> np.ndarray:
        """Scores of the text's words; a word that stood less than ``APART`` words before says nothing new."""
        words = WORDS.findall(text) if text else []
        scores = self.known.of(words)
        last: dict[str, int] = {}
        for i in np.flatnonzero(scores > -DRIFT).tolist():
            word = words[i]
            if i - last.get(word, -APART) < APART:
                scores[i] = -DRIFT
            last[word] = i
        return scores

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        scores = self.scores(text)
        return len(scores), maximal_segments(scores)


NAMES = ("toxic0", "clean0", "toxic1", "clean1")
COUNTS = T.StructType([T.StructField("word", T.StringType()), *(T.StructField(n, T.LongType()) for n in NAMES)])


def count_words(labelled: DataFrame) -> DataFrame:
    """(half, text, label) rows to the number of texts that each word stands in; each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in NAMES]

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(set().union(*held))
            for i in range(0, len(words), 1 << 16):
                some = words[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[w] for w in some], pa.int64()) for c in held)], names=COUNTS.names)
            for counter in held:
                counter.clear()

        for part in itertools.chain.from_iterable(slices(b, 1) for b in batches):
            for half, text, label in zip(*(part.column(i).to_pylist() for i in range(3))):
                held[2 * half + 1 - label].update(set(WORDS.findall(text.lower())))
            if sum(map(len, held)) > FLUSH_WORDS:
                yield from flush()
        yield from flush()

    return map_batches(labelled, run, COUNTS).groupBy("word").agg(*[F.sum(n).alias(n) for n in NAMES])


#: What is learnt: from half 0, from half 1, from both.
SETS = ("first", "second", "both")


def token_scores(words: DataFrame, places: dict[str, tuple[int, int]]) -> DataFrame:
    """(token, score by set) of every word, and of every beginning as the score of words that begin so and are not known."""
    chain = [*(f"p{k}" for k in PREFIXES), "word"]
    starts = {k: words.where(F.length("word") > k).groupBy(F.substring("word", 1, k).alias(f"p{k}")).agg(*[F.sum(n).alias(f"{n}_p{k}") for n in NAMES]) for k in PREFIXES}
    starts = {k: materialize(t, f"p{k}") for k, t in starts.items()}
    shapes = []
    for end in (*PREFIXES, None):
        rows = starts[end].withColumn("token", F.concat(f"p{end}", F.lit("*"))) if end else words.select(F.col("word").alias("token"), *[F.col(n).alias(f"{n}_word") for n in NAMES])
        text = F.col(f"p{end}") if end else F.col("token")
        for k in PREFIXES:
            if end is None or k < end:
                at = F.when(F.length(text) > k, F.substring(text, 1, k))
                rows = rows.join(starts[k].withColumnRenamed(f"p{k}", f"at{k}"), at == F.col(f"at{k}"), "left")
        # A word that is no longer than a beginning stands there itself; behind a beginning nothing is known.
        missing = (lambda n: F.col(f"{n}_word")) if end is None else (lambda n: F.lit(0).cast("long"))
        shapes.append(rows.select("token", *[(F.coalesce(F.col(f"{n}_{c}"), missing(n)) if f"{n}_{c}" in rows.columns else missing(n)).alias(f"{n}_{c}") for c in chain for n in NAMES]))
    every = shapes[0]
    for shape in shapes[1:]:
        every = every.unionByName(shape)
    scores = []
    for name in SETS:
        halves = {"first": "0", "second": "1", "both": "01"}[name]
        toxic, clean = places[name]
        if not toxic or not clean:
            scores.append(F.lit(None).cast("double").alias(name))
            continue
        base = toxic / (toxic + clean)
        rate = F.lit(base)
        for i, c in enumerate(chain):
            # What the next longer token has is its own evidence; the rest of this one is its prior's.
            a, b = (sum(F.col(f"{label}{h}_{c}") - (F.col(f"{label}{h}_{chain[i + 1]}") if i + 1 < len(chain) else 0) for h in halves) for label in ("toxic", "clean"))
            rate = (a + PRIOR * rate) / (a + b + PRIOR)
        scores.append((F.log(rate / (1 - rate)) - (math.log(base / (1 - base)) + DRIFT)).alias(name))
    return every.select("token", *scores)


def tables_of(tokens: DataFrame) -> dict[str, Scores | None]:
    """The scores as arrays."""
    got = tokens.select(F.xxhash64("token").alias("hash"), *SETS).toArrow()
    hashes = got.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return {n: None if got.column(n).null_count else Scores(hashes[order], got.column(n).to_numpy()[order]) for n in SETS}


def spelled(rows: DataFrame, tokens: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``rows``, written, with ``__scores``: the lower-case words of each text, each with its scores in ``columns``.

    Distinct words of a text meet the vocabulary's scores and come back to it; nothing but one text's words is gathered in a place.
    """
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "spelled")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in itertools.chain.from_iterable(slices(b, 1) for b in batches):
            for at, body in zip(*(part.column(i).to_pylist() for i in range(2))):
                words = sorted({w.lower() for w in WORDS.findall(body)}) if body else []
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(words), pa.int64()), pa.array(words, pa.string())], names=["__row", "word"])

    pairs = materialize(map_batches(rows.select("__row", F.col(f"`{text}`")), words_of, "__row long, word string"), "pairs")
    names = [F.struct(F.lit(k).alias("size"), F.concat(F.substring("word", 1, k), F.lit("*")).alias("token")) for k in PREFIXES]
    names = [F.when(F.length("word") > k, n) for k, n in zip(PREFIXES, names)] + [F.struct(F.lit(1 << 20).alias("size"), F.col("word").alias("token"))]
    asked = pairs.select("word").distinct().select("word", F.explode(F.array_compact(F.array(*names))).alias("t")).select("word", "t.size", "t.token")
    met = asked.join(tokens, "token").groupBy("word").agg(F.max(F.struct("size", *columns)).alias("s"))
    known = materialize(met.select("word", *[F.col(f"s.{c}").alias(c) for c in columns]), "known")
    maps = pairs.join(known, "word").groupBy("__row").agg(F.collect_list(F.struct("word", *columns)).alias("__scores"))
    return rows.join(maps, "__row", "left").drop("__row")


SCANNED = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("segments", T.ArrayType(T.DoubleType())), T.StructField("rates", T.MapType(T.DoubleType(), T.LongType()))])


def solve_decay(rates: dict[float, float]) -> float:
    """The positive lambda with sum p_s exp(lambda s) = 1; 1 where no token scores above 0."""
    total = sum(rates.values())
    if not total or max(rates) <= 0:
        return 1.0
    f = lambda x: sum(n / total * math.exp(min(700.0, x * s)) for s, n in rates.items()) - 1.0
    high = 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    low = 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return min(max(high, 0.05), 4.0)


def train(labelled: DataFrame, text: str, label: str, key: str, sent: int = SENT_TOKENS) -> Model:
    """Learn from all labelled rows; rows without label count as none, null texts as empty."""
    half = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(2)).cast("int")
    rows = labelled.where(F.col(label).isin(0, 1)).select(half.alias("half"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"))
    with Scratch(labelled.sparkSession) as scratch:
        words = materialize(count_words(rows), "words")
        n = [x or 0 for x in words.agg(*[F.sum(n) for n in NAMES]).first()]
        places = {"first": (n[0], n[1]), "second": (n[2], n[3]), "both": (n[0] + n[2], n[1] + n[3])}
        if not all(places["both"]):
            return Model()
        tokens = materialize(token_scores(words, places), "tokens")
        # Texts of a half are scored with the counts of the other one, if it has both labels.
        crossed = ["second" if all(places["second"]) else "both", "first" if all(places["first"]) else "both"]
        if tokens.count() <= sent:
            tables = tables_of(tokens)
            return calibrated(rows, [tables[c] for c in crossed], Model(table=tables["both"]))
        kept = scratch.keep(tokens.select("token", F.col("both").alias("score")), "scores")
        return calibrated(spelled(rows, tokens, "text", SETS), crossed, Model(tokens=kept.inputFiles()[0].rpartition("/")[0]))


def calibrated(rows: DataFrame, crossed: list[Scores] | list[str], model: Model) -> Model:
    """The law of chance and the threshold, from texts scored with the counts of the other half: arrays, or names of columns of the text's own scores."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(s) for s in crossed if isinstance(s, Scores)]
        for part in itertools.chain.from_iterable(slices(b, 1) for b in batches):
            ys, ns, segs, chance = [], [], [], [np.empty(0)]
            given = part.column(3).to_pylist() if not scanners else [None] * part.num_rows
            for h, t, y, g in zip(*(part.column(i).to_pylist() for i in range(3)), given):
                scanner = scanners[h] if scanners else Scanner(Given((x["word"], x[crossed[h]]) for x in g or []))
                scores = scanner.scores(t)
                ys.append(y)
                ns.append(len(scores))
                segs.append([round(s, 3) for _, _, s in maximal_segments(scores)])
                if y == 0:
                    chance.append(scores)
            values, counts = np.unique(np.round(np.concatenate(chance), 1), return_counts=True)
            maps = [list(zip(values.tolist(), counts.tolist()))] + [[]] * (len(ys) - 1) if ys else []
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ns, pa.int64()), pa.array([max(s, default=0.0) for s in segs], pa.float64()), pa.array(segs, pa.list_(pa.float64())), pa.array(maps, pa.map_(pa.float64(), pa.int64()))], names=SCANNED.names)

    scanned = materialize(map_batches(rows, scan, SCANNED), "toxicity")
    rates = {r["s"]: r["n"] for r in scanned.select(F.explode("rates").alias("s", "n")).groupBy("s").agg(F.sum("n").alias("n")).collect()}  # bins of 0.1
    decay = solve_decay(rates)
    # With E = K n exp(-lambda S), K n exp(-lambda best) is exponential with mean 1; texts without a segment are censored.
    fitted = scanned.where((F.col("label") == 0) & (F.col("n") > 0)).agg(F.count_if(F.col("best") > 0).alias("seen"), F.sum(F.col("n") * F.exp(-decay * F.col("best"))).alias("mass")).first()
    scale = min(10.0, max(1e-4, fitted["seen"] / fitted["mass"])) if fitted["seen"] else 0.01
    base = F.log(scale * F.greatest(F.col("n"), F.lit(1)) + 1e-9)
    gains = F.transform("segments", lambda s: s * decay - base)
    above = F.aggregate(F.filter(gains, lambda g: g > 0), F.lit(0.0), lambda a, g: a + g)
    evidence = F.when(above > 0, above).otherwise(F.coalesce(F.array_max(gains), -F.log(scale * F.greatest(F.col("n"), F.lit(1)) + 1.0)))
    bins = scanned.select("label", F.least(F.greatest(F.floor(evidence / BIN), F.lit(-BINS)), F.lit(BINS)).cast("int").alias("bin")).groupBy("label", "bin").count().collect()
    hits = {(r["label"], r["bin"]): r["count"] for r in bins}
    total, best, top = sum(n for (y, _), n in hits.items() if y == 1), -1.0, BINS
    caught = false = 0
    for b in range(BINS, -BINS - 1, -1):
        caught, false = caught + hits.get((1, b), 0), false + hits.get((0, b), 0)
        if (f1 := 2 * caught / max(1, total + caught + false)) > best:
            best, top = f1, b
    # The middle of the gap below the threshold, if nothing of either label lies there.
    low = top - 1
    while low > -BINS and not hits.get((0, low)) and not hits.get((1, low)):
        low -= 1
    return Model(model.table, model.tokens, decay, scale, (top * BIN + (low + 1) * BIN) / 2)


PASSAGES = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score(
    df: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted", passages: str = "passages", threshold: float = 0.7, keep: list[str] | None = None
) -> DataFrame:
    """Add the score, whether it reaches the threshold, and the significant passages (E-value below 1)."""
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("score", pa.float64())]))

    def judged(scanners: Iterator[Scanner], texts: list) -> list[pa.Array]:
        p, spans = [], []
        for scanner, t in zip(scanners, texts):
            n, segments = scanner.scan(t)
            p.append(model.score(model.evidence(n, segments)))
            least = math.log(model.scale * max(n, 1) + 1e-9) / model.decay
            spans.append([{"first_word": a, "n_words": b - a, "score": s} for a, b, s in segments if s > least])
        return [pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(spans, kind)]

    fields = [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType()), T.StructField(passages, PASSAGES)]
    if model.tokens is None:
        return append_columns(df, lambda: lambda texts, scanner=Scanner(model.table): judged(itertools.repeat(scanner), texts), fields, on=text, keep=keep)
    base = without(df, [f.name for f in fields if f.name.lower() != text.lower()])
    carried = [c for c in (base.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in fields}]
    tokens = df.sparkSession.read.schema("token string, score double").parquet(model.tokens)
    source = spelled(base.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, text])]), tokens, text, ["score"])
    at, scores = source.columns.index(text), source.columns.index("__scores")
    where = [source.columns.index(c) for c in carried]
    schema = T.StructType([*(source.schema[c] for c in carried), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in itertools.chain.from_iterable(slices(b, at) for b in batches):
            scanners = (Scanner(Given((x["word"], x["score"]) for x in g or [])) for g in part.column(scores).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in where), *judged(scanners, part.column(at).to_pylist())], names=schema.names)

    return map_batches(source, run, schema)
