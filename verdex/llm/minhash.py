"""Operator 6: near-duplicate documents by min-max hashing.

Words are lower-cased (A-Z) runs of bytes other than white space; a document's set
holds its distinct ``shingle``-word shingles (the whole sequence if it is shorter).
Each permutation of the shingle hashes gives two signature values, its minimum
*and* its maximum, so half as many permutations are evaluated; both agree between
two sets with probability equal to their Jaccard similarity.  ``rows`` values
form a band; with 40 bands of 6 a pair at similarity 0.8 goes unseen with probability
5e-6.  Documents with equal sets are one node from the start.

Links are confirmed on the full sets.  Components need no list of all pairs of a
bucket: first every member of a bucket meets the bucket's smallest member.  Only
where that leaves a bucket in several components, the members outside the smallest
member's component meet all members of other components (as pairs in small buckets,
block by block inside tasks in large ones), so no link between different
components is lost, and a bucket of copies costs one pair a member.

Defined results: a null or blank text has an empty set and links with nothing.
Rows that repeat a doc_id are one document whose texts can each link; exact repeats
change nothing.  Rows with a null doc_id cannot be named by a link: their component and
kept are null.  Other columns of the input are not read.  An empty table gives none.  Very long texts are
shingled whole; a task holds the set of one such text at a time.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.llm.common import Scratch, append_columns, if_small, map_batches, materialize, slices
from verdex.llm.components import components

BANDS = 40
ROWS = 6
CACHED_WORDS = 100_000
CACHED_SETS = 128
#: Buckets of up to so many members are compared as pairs of rows; larger ones in
#: blocks of members inside tasks.  Both ways compare the same pairs on full sets.
PAIR_MEMBERS = 32
BLOCK_MEMBERS = 512
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, shingle: int):
        self.shingle = shingle
        self.get = WordHashes().__getitem__

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words = text.encode("utf-8").lower().split() if text else []
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.get, words), np.uint64, n)
        k = min(n, self.shingle)
        out = h[: n - k + 1].copy()
        for i in range(1, k):
            out = mix(out * C1 + h[i : n - k + 1 + i])
        return np.unique(mix(out + np.uint64(k)))


class Signer:
    """Set identity and band keys of a text."""

    def __init__(self, shingle: int, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shingler = Shingler(shingle)
        self.bands, self.rows = bands, rows
        n = -(-bands * rows // 2)
        self.factors = (rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.shifts = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]
        # A band mixes minima and maxima of different permutations, so its values are independent.
        self.order = rng.permutation(2 * n)[: bands * rows]
        self.salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """Minimum and maximum under each permutation."""
        folded = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        most = np.zeros(len(self.factors), np.uint32)
        for i in range(0, len(folded), 512):
            p = folded[None, i : i + 512] * self.factors
            p ^= p >> np.uint32(15)
            p *= np.uint32(0x2C1B3C6D)
            p += self.shifts
            np.minimum(least, p.min(axis=1), out=least)
            np.maximum(most, p.max(axis=1), out=most)
        return np.concatenate([least, most])

    def __call__(self, text: str | None) -> tuple[int, int, int, np.ndarray]:
        h = self.shingler.hashes(text)
        if not len(h):
            return 0, 0, 0, np.empty(0, np.int64)
        a, b = np.add.reduce(h), np.bitwise_xor.reduce(mix(h + C1))
        v = self.values(h)[self.order].astype(np.uint64).reshape(self.bands, self.rows)
        key = self.salt.copy()
        for i in range(self.rows):
            key = mix(key * C1 + v[:, i])
        return len(h), int(a.astype(np.int64)), int(b.astype(np.int64)), key.astype(np.int64)


SIGNED = [T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def sign(df: DataFrame, text: str, shingle: int, bands: int, rows: int, keep: list[str]) -> DataFrame:
    def make():
        signer = Signer(shingle, bands, rows)

        def apply(texts: list) -> list[pa.Array]:
            with np.errstate(over="ignore"):
                rows_ = [signer(t) for t in texts]
            n, a, b, keys = zip(*rows_) if rows_ else ((), (), (), ())
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            return [pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))]

        return apply

    return append_columns(df, make, SIGNED, on=text, keep=keep)


CONFIRMED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of (a, b, set_a, set_b) pairs those whose full sets reach the similarity.

    ``docs`` has (doc_id, text); of several texts of an id the one whose set was meant counts.
    """
    docs = texts_of(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))), docs)
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        held: OrderedDict[str, tuple[int, np.ndarray]] = OrderedDict()

        def full(text: str) -> tuple[int, np.ndarray]:
            got = held.pop(text, None)
            if got is None:
                h = shingler.hashes(text)
                got = int(np.add.reduce(h).astype(np.int64)), h
                if len(held) >= CACHED_SETS:
                    held.popitem(last=False)
            held[text] = got
            return got

        with np.errstate(over="ignore"):
            for part in itertools.chain.from_iterable(slices(b, 5) for b in batches):
                found = []
                for a, b, sa, sb, ta, tb in zip(*(part.column(i).to_pylist() for i in range(6))):
                    (ia, ha), (ib, hb) = full(ta), full(tb)
                    if ia == sa and ib == sb:
                        both = len(np.intersect1d(ha, hb, assume_unique=True))
                        if 100 * both >= percent * (len(ha) + len(hb) - both):
                            found.append((a, b))
                a, b = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_batches(rows, run, CONFIRMED)


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows of the given ids."""
    ids = materialize(ids.distinct(), "ids")
    return materialize(docs.join(if_small(ids), "doc_id", "left_semi"), "texts")


def between(members: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between components in large buckets: (band, size, node, label, minor) to a spanning forest.

    A bucket's members are dealt into blocks, and its minor members into blocks of their
    own.  Every pair of such blocks is a group: a member travels with its full set once
    for each block of minor members, of which there is one unless they are many, and
    a minor member once for each block.  A task counts one minor member's intersections
    with a whole block through an inverted index, and returns only links that join
    components it has not joined yet.
    """
    members = materialize(members, "large")
    if members.isEmpty():
        return docs.sparkSession.createDataFrame([], CONFIRMED)
    wanted = materialize(members.select("node").distinct().join(nodes.select("node", "set_a"), "node"), "wanted")
    texts = texts_of(wanted.select(F.col("node").alias("doc_id")), docs)

    def make():
        shingler = Shingler(shingle)

        def apply(values: list) -> list[pa.Array]:
            with np.errstate(over="ignore"):
                found = [shingler.hashes(t) for t in values]
                return [pa.array([h.tobytes() for h in found], pa.binary()), pa.array([int(np.add.reduce(h).astype(np.int64)) for h in found], pa.int64())]

        return apply

    sets = append_columns(texts, make, [T.StructField("set", T.BinaryType()), T.StructField("set_a", T.LongType())], on="text", keep=["doc_id"])
    sets = materialize(sets.withColumnRenamed("doc_id", "node").join(wanted, ["node", "set_a"], "left_semi").dropDuplicates(["node", "set_a"]), "sets")
    counted = members.groupBy("band").agg(F.count_if("minor").alias("minors"))
    placed = members.join(materialize(counted, "minors"), "band")
    blocks, probes = (F.ceil(F.col(c) / BLOCK_MEMBERS).cast("int") for c in ("size", "minors"))
    own = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    columns = ["band", "i", "j", "probe", "node", "label"]
    targets = placed.withColumn("i", own(1, blocks)).withColumn("j", F.explode(F.sequence(F.lit(0), probes - 1)))
    minors = placed.where("minor").withColumn("j", own(2, probes)).withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = targets.withColumn("probe", F.lit(False)).select(*columns).unionByName(minors.withColumn("probe", F.lit(True)).select(*columns))
    spread = spread.join(sets.select("node", "set"), "node")

    def join_components(table: pa.Table) -> pa.Table:
        node, label, probe = (table.column(c).to_numpy() for c in ("node", "label", "probe"))
        held = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        lengths = np.array([len(h) for h in held])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        links = []
        few, many = np.flatnonzero(probe), np.flatnonzero(~probe)
        if len(few) and len(many):
            flat = np.concatenate([held[m] for m in many])
            owner = np.repeat(np.arange(len(many)), lengths[many])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for a in few:
                low, high = np.searchsorted(flat, held[a], "left"), np.searchsorted(flat, held[a], "right")
                size = high - low
                at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                both = np.bincount(owner[at], minlength=len(many))
                near = 100 * both >= percent * (lengths[a] + lengths[many] - both)
                for b in many[near]:
                    x, y = find(int(label[a])), find(int(label[b]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        links.append((int(node[a]), int(node[b])))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("band", "i", "j").applyInArrow(join_components, CONFIRMED)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    ``kept`` marks the rows of each component's smallest doc_id.  Ids are integers.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(_near_duplicates(docs, doc_id, text, shingle, percent, bands, rows), "near")


def _near_duplicates(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(sign(texts, "text", shingle, bands, rows, keep=["doc_id"]), "signed")
    named = signed.where("doc_id is not null and n_shingles > 0")
    nodes = materialize(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n")), "nodes")
    # One row a set: that of its smallest document.
    chosen = named.join(nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).where("doc_id = node")
    members = materialize(chosen.select("node", F.explode("bands").alias("band")).distinct(), "members")
    heads = members.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last"))
    heads = materialize(heads.where("head <> last").select("band", "head"), "heads")
    readable = texts.where("doc_id is not null and text is not null")

    def tested(pairs: DataFrame) -> DataFrame:
        """Confirmed links of (a, b) pairs whose set sizes allow the similarity."""
        pairs = materialize(pairs.select("a", "b").distinct(), "met")
        pairs = pairs.join(nodes.select(F.col("node").alias("a"), "set_a", F.col("n").alias("n_a")), "a")
        pairs = pairs.join(nodes.select(F.col("node").alias("b"), F.col("set_a").alias("set_b"), F.col("n").alias("n_b")), "b")
        fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        pairs = materialize(pairs.where(fits).select("a", "b", "set_a", "set_b"), "pairs")
        return materialize(confirm(pairs, readable, shingle, percent), "confirmed")

    links = tested(heads.select("band", F.col("head").alias("a")).join(members.select("band", F.col("node").alias("b")), "band").where("a <> b"))
    # A doc_id with several texts ties the nodes of their sets together.
    several = named.groupBy("doc_id").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high")).where("low <> high").select("doc_id")
    ties = named.select("doc_id", "set_a", "set_b").join(several, "doc_id").join(nodes, ["set_a", "set_b"]).where("doc_id <> node")
    links = materialize(links.unionByName(ties.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))), "tied")
    labels = components(links)
    # Buckets left in several components: members outside the head's component meet the others.
    label = labels.select("node", "component")
    known = members.join(heads.select("band"), "band", "left_semi").join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("label"))
    known = materialize(known, "known")
    mixed = known.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
    mixed = materialize(mixed.where("low <> high").select("band", "size"), "mixed")
    if not mixed.isEmpty():
        major = heads.join(mixed, "band").withColumnRenamed("head", "node").join(label, "node", "left")
        major = materialize(major.select("band", "size", F.col("node").alias("head"), F.coalesce("component", "node").alias("major")), "major")
        around = known.join(major, "band").where("node <> head")
        around = materialize(around.select("band", "size", "node", "label", (F.col("label") != F.col("major")).alias("minor")), "around")
        few = around.where(F.col("size") <= PAIR_MEMBERS)
        minor = materialize(few.where("minor").select("band", F.col("node").alias("a"), F.col("label").alias("label_a")), "minor")
        # Two minor members would meet twice, so they keep one order.
        cross = minor.join(few.select("band", F.col("node").alias("b"), "label", "minor"), "band").where("label_a <> label and (not minor or a < b)")
        more = tested(cross).unionByName(between(around.where(F.col("size") > PAIR_MEMBERS), nodes, readable, shingle, percent))
        more = materialize(more, "more")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    # Rows find their set's node, and nodes their component.
    placed = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"], "left")
    placed = placed.join(labels, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
