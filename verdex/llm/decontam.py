"""Operator 7: benchmark decontamination by SimHash of item-sized windows.

Words are lower-cased runs of word characters.  For every benchmark item of n words
the windows of n words of a document (the whole document if shorter) are
compared with it: a window's fingerprint is the 64-bit SimHash of its shingles,
weighted by how often they occur.  Windows that hold no shingle of any item of their size
have similarity 0 with all and get none.

The multi-index finds the items that a fingerprint is near to: eight tables, one for each
block of eight bits, give for a block's value all items whose block is within 2 bits of
it.  Two fingerprints within ``RADIUS`` = 16 bits agree to 16 // 8 = 2 bits in at least
one block, so the union of what the tables give misses none within the radius.  These are
verified by the exact similarity of weighted shingle sets, sum of minima / sum of maxima.

At a similarity of 0.8 fingerprints differ in 9.7 bits on average, so the tables alone find
about 99 in 100 windows there, and all but all of closer ones (a test measures it).  But the
radius bounds no similarity: a shingle that a window repeats weighs on all bits.  So that
none is missed, windows beyond the radius, and these alone, are verified, too, if they
have as many of an item's shingles as the threshold asks for; sliding counts make that
linear in the text.  Shingles have ``shingle`` words, or all words of a shorter item.

A benchmark of up to ``SENT_WORDS`` words goes to the workers, which read the documents once.
A larger one stays a table, and the documents are read once as well: those of their
shingles that may be the benchmark's (a bit set of 32 MB at most says so) meet each item's
rarest shingles.  A window that reaches the threshold holds at least that share of an
item's shingles, so it holds one of the rarest that make up the rest, and pairs that share
common shingles alone never meet.  Each document found gets its own items to be matched with.

Null and blank texts match nothing; items without words are skipped.  Rows that repeat are
matched each for itself; an item_id that repeats counts once a row of it.  Of
windows that tie the first counts.  Without items or documents there are no matches.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.llm.collocations import HashSet, hash_set
from verdex.llm.common import Scratch, append_columns, if_small, map_batches, materialize, slices
from verdex.llm.minhash import mix

WORDS = re.compile(r"\w+")
RADIUS = 16
BLOCKS = 8
SENT_WORDS = 1_000_000
CACHED_WORDS = 100_000
SCREEN_BITS = 20
#: Window starts that are fingerprinted at once.
SPAN = 4096
C1 = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h
        return h


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = mix(out * C1 + hashes[i : n + i])
    return mix(out + np.uint64(k))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums of the hashes' bits as +1 and -1, one row more than hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as eight bytes a row."""
    return np.packbits(sums > 0, axis=1)


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (a.total() + b.total() - both) if both else 0.0


COUNT = np.array([x.bit_count() for x in range(256)], np.uint8)
#: NEIGHBOURS[x, y]: two values of a block within RADIUS // BLOCKS bits.
NEIGHBOURS = COUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS


def block_tables(prints: np.ndarray) -> np.ndarray:
    """tables[j, v]: as packed bits, the items whose block j is within RADIUS // BLOCKS bits of the value v."""
    return np.stack([np.packbits(NEIGHBOURS[:, prints[:, j]], axis=1, bitorder="little") for j in range(BLOCKS)])


def near(windows: np.ndarray, tables: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs that a table gives and that are within the radius."""
    given = np.bitwise_or.reduce([tables[j][windows[:, j]] for j in range(BLOCKS)])
    at, item = np.nonzero(np.unpackbits(given, axis=1, count=len(prints), bitorder="little"))
    close = COUNT[windows[at] ^ prints[item]].sum(axis=1) <= RADIUS
    return at[close], item[close]


@dataclass
class Items:
    """Items of one number of words: ids, shingle counts, fingerprints with their block tables, and by shingle who holds it."""

    size: int
    ids: list[object]
    bags: list[Counter]
    prints: np.ndarray
    tables: np.ndarray
    holders: dict[int, list[int]]


class Matcher:
    def __init__(self, items: list[tuple[object, str]], shingle: int, percent: int, supplement: bool = True):
        self.percent, self.supplement = percent, supplement
        self.get = WordHashes().__getitem__
        groups: dict[tuple[int, int], list[tuple[object, np.ndarray]]] = {}
        for item, text in items:
            words = WORDS.findall(text.lower())
            if words:
                k = min(shingle, len(words))
                with np.errstate(over="ignore"):
                    groups.setdefault((k, len(words)), []).append((item, shingles(self.hash(words), k)))
        #: By shingle length: items by size, and a screen of all their shingles.
        self.sizes: dict[int, list[Items]] = {}
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for (k, size), members in sorted(groups.items()):
            holders: dict[int, list[int]] = {}
            for i, (_, h) in enumerate(members):
                for x in np.unique(h).tolist():
                    holders.setdefault(x, []).append(i)
            prints = np.concatenate([packed(bit_sums(h)[-1:]) for _, h in members])
            self.sizes.setdefault(k, []).append(Items(size, [m[0] for m in members], [Counter(m[1].tolist()) for m in members], prints, block_tables(prints), holders))
        for k in self.sizes:
            every = np.unique(np.concatenate([h for (kk, _), members in groups.items() if kk == k for _, h in members]))
            screen = np.zeros(1 << SCREEN_BITS, bool)
            screen[every >> np.uint64(64 - SCREEN_BITS)] = True
            self.known[k] = screen, every

    def hash(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.get, words), np.uint64, len(words))

    def __call__(self, texts: list) -> list[list[dict]]:
        """Per text the best window of each item that it reaches, by item order."""
        words = [WORDS.findall(t.lower()) if t else [] for t in texts]
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        flat = self.hash([x for w in words for x in w])
        found: list[dict] = [{} for _ in texts]
        with np.errstate(over="ignore"):
            for k, groups in self.sizes.items():
                screen, every = self.known[k]
                h = shingles(flat, k)
                at = np.flatnonzero(screen[h >> np.uint64(64 - SCREEN_BITS)])
                at = at[np.isin(h[at], every)]
                owner = np.searchsorted(ends, at, side="right")
                inside = at + k <= ends[owner]
                at, owner = at[inside], owner[inside]
                for text in np.unique(owner):
                    first = ends[text] - lengths[text]
                    hits = at[owner == text] - first
                    own = h[first : ends[text] - k + 1]
                    self.search(own, hits, int(lengths[text]), k, groups, found[text])
        return [sorted(f.values(), key=lambda m: (m["item_id"] is None, m["item_id"] or 0, m["first_word"])) for f in found]

    def search(self, own: np.ndarray, hits: np.ndarray, n: int, k: int, groups: list[Items], found: dict) -> None:
        values = own[hits].tolist()
        for group in groups:
            size, width = group.size, min(group.size, n)  # words of an item, words in a window
            span = width - k + 1  # shingles in a window
            places: dict[int, list[int]] = {}
            for at, x in zip(hits.tolist(), values):
                for i in group.holders.get(x, ()):
                    places.setdefault(i, []).append(at)
            if not places:
                continue

            def meet(i: int, first: int, s: float) -> None:
                """The best window counts, of equal ones the first."""
                if 100 * s >= self.percent - 1e-9:
                    held = found.get((k, size, i))
                    if held is None or (s, -first) > (held["similarity"], -held["first_word"]):
                        found[k, size, i] = {"item_id": group.ids[i], "similarity": s, "first_word": first, "n_words": width}

            # Windows that hold a shingle of any of these items, as merged intervals of starts.
            starts = np.array(sorted({a for at in places.values() for a in at}))
            low, high = np.maximum(starts - span + 1, 0), np.minimum(starts, n - width)
            fits = low <= high
            prints: dict[int, np.ndarray] = {}
            for start, stop in intervals(low[fits], high[fits]):
                for a in range(start, stop, SPAN):
                    b = min(stop, a + SPAN)
                    sums = bit_sums(own[a : b + span - 1])
                    prints[a] = packed(sums[span : span + b - a] - sums[: b - a])
                    for w, i in zip(*(x.tolist() for x in near(prints[a], group.tables, group.prints))):
                        meet(i, a + w, weighted_similarity(Counter(own[a + w : a + w + span].tolist()), group.bags[i]))
            # Shingles that a window must share with an item of this size.
            least = math.ceil((self.percent - 1e-9) * (span + size - k + 1) / (100 + self.percent) - 1e-6)
            begins = sorted(prints)
            for i, at in places.items():
                if self.supplement and len(at) >= least:
                    for first, both in overlaps(np.array(at), own, span, n - width, least, group.bags[i]):
                        a = begins[bisect.bisect_right(begins, first) - 1]
                        if COUNT[prints[a][first - a] ^ group.prints[i]].sum() > RADIUS:
                            meet(i, first, both / (span + size - k + 1 - both))


def overlaps(at: np.ndarray, own: np.ndarray, span: int, last: int, least: int, bag: Counter) -> Iterator[tuple[int, int]]:
    """(start, shared shingles) of the windows up to ``last`` with ``least`` of the places ``at`` where an item's shingles stand."""
    # The window of places j .. j + least - 1 is possible if they lie within one span.
    near = at[least - 1 :] - at[: len(at) - least + 1] < span
    low, high = np.maximum(at[least - 1 :] - span + 1, 0)[near], np.minimum(at[: len(at) - least + 1], last)[near]
    fits = low <= high
    for start, stop in intervals(low[fits], high[fits]):
        counts: Counter = Counter()
        both = 0
        come, go = np.searchsorted(at, start), np.searchsorted(at, start)
        for first in range(start, stop):
            while come < len(at) and at[come] < first + span:
                x = int(own[at[come]])
                counts[x] += 1
                both += counts[x] <= bag[x]
                come += 1
            while at[go] < first:
                x = int(own[at[go]])
                both -= counts[x] <= bag[x]
                counts[x] -= 1
                go += 1
            yield first, both


def intervals(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Unions of [low, high] ranges that are sorted, as half-open ranges."""
    at = stop = None
    for a, b in zip(low.tolist(), high.tolist()):
        if at is None:
            at, stop = a, b + 1
        elif a <= stop:
            stop = max(stop, b + 1)
        else:
            yield at, stop
            at, stop = a, b + 1
    if at is not None:
        yield at, stop


MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))
KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def sent_items(items: DataFrame, most: int) -> list[tuple[object, str]] | None:
    """The (item, text) rows, None if they have over ``most`` words; no more than that reaches the driver."""
    held, words = [], 0
    for row in items.orderBy("item", "text").toLocalIterator():
        words += len(WORDS.findall(row["text"]))
        held.append((row["item"], row["text"]))
        if words > most and len(held) > 1:
            return None
    return held


def shingle_rows(rows: DataFrame, key: str, sizes: list[int] | None, shingle: int, known: HashSet | None) -> DataFrame:
    """(key, hash, n): distinct shingles of each text with their counts; of all ``sizes``, or of the size that an item of that length has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = WordHashes().__getitem__
        for part in itertools.chain.from_iterable(slices(b, 1) for b in batches):
            for at, text in zip(*(part.column(i).to_pylist() for i in range(2))):
                words = WORDS.findall(text.lower()) if text else []
                if not words:
                    continue
                flat = np.fromiter(map(get, words), np.uint64, len(words))
                with np.errstate(over="ignore"):
                    found = np.concatenate([shingles(flat, k) for k in (sizes or [min(shingle, len(words))])])
                if known is not None:
                    found = found[known.has(found)]
                if len(found):
                    hashes, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(hashes), pa.int64()), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=[key, "hash", "n"])

    return map_batches(rows, run, f"{key} long, hash long, n long")


def listed(rows: DataFrame, items: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(__row, __items): for each document row the (item, text) that it may hold, by shared rare shingles."""
    items = materialize(items.withColumn("at", F.monotonically_increasing_id()), "items")
    sizes = list(range(1, shingle + 1))  # items of fewer words have shorter shingles
    bags = materialize(shingle_rows(items.select("at", "text"), "at", None, shingle, None), "bags")
    known = hash_set(bags.select("hash").distinct())
    hits = materialize(shingle_rows(rows, "__row", sizes, shingle, known).select("__row", "hash"), "hits")
    # An item's rarest shingles, as many as it can lack and one more.
    often = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    ranked = bags.join(often, "hash")
    whole = bags.groupBy("at").agg(F.sum("n").alias("whole"))
    rarest = Window.partitionBy("at").orderBy("often", "hash").rowsBetween(Window.unboundedPreceding, -1)
    absent = F.coalesce(F.sum("n").over(rarest), F.lit(0))
    ranked = ranked.join(whole, "at")
    present = F.sum("n").over(Window.partitionBy("at"))
    lacked = F.col("whole") - F.ceil((F.col("whole") * percent - 1e-6) / 100)  # shingles that a match may lack
    # Shingles that stand in no document are lacked already.
    chosen = ranked.withColumn("before", absent + F.col("whole") - present).where(F.col("before") <= lacked).select("hash", "at")
    pairs = hits.join(materialize(chosen, "rarest"), "hash").select("__row", "at").distinct()
    texts = pairs.join(items.select("at", "item", "text"), "at")
    return texts.groupBy("__row").agg(F.collect_list(F.struct("item", "text")).alias("__items"))


def match_items(docs: DataFrame, items: list[tuple[object, str]], text: str, out: str, shingle: int, percent: int, keep: list[str]) -> DataFrame:
    """Add the matches with items that go to the workers."""

    def make():
        matcher = Matcher(items, shingle, percent)
        return lambda texts: [pa.array(matcher(texts), KIND)]

    return append_columns(docs, make, [T.StructField(out, MATCHES)], on=text, keep=keep)


def matches(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "matches",
    shingle: int = 5,
    percent: int = 80,
    sent_words: int = SENT_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add to each row the benchmark items that a window of its text reaches, with the best window."""
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    bench = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    sent = sent_items(bench, sent_words)
    if sent is not None:
        return match_items(docs, sent, text, out, shingle, percent, carried)
    kept = list(dict.fromkeys([*carried, text]))
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias("__row")), "numbered")
        wanted = materialize(listed(rows.select("__row", F.col(f"`{text}`")), bench, shingle, percent), "wanted")
        asked = rows.select("__row", F.col(f"`{text}`").alias("text")).join(wanted, "__row")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in itertools.chain.from_iterable(slices(b, 1) for b in batches):
                for at, body, own in zip(*(part.column(i).to_pylist() for i in range(3))):
                    mine = Matcher(sorted(((x["item"], x["text"]) for x in own), key=lambda x: (x[0] is not None, x[0] or 0, x[1])), shingle, percent)([body])
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array(mine, KIND)], names=["__row", "__matches"])

        schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField("__matches", MATCHES)])
        found = scratch.keep(map_batches(asked, run, schema).where(F.size("__matches") > 0), "found")
    joined = rows.join(if_small(found, weight=F.size("__matches")), "__row", "left")
    return joined.select(*[F.col(f"`{c}`") for c in carried], F.coalesce("__matches", F.array().cast(MATCHES)).alias(out))
