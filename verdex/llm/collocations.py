"""Phrase collocations from position bitmaps, one vertical table a shard.

The words of each language are laid out shard by shard.  A shard has, for every word,
the bitmap of its positions, compressed to the 16-bit blocks that are not empty; the
ends of pieces hold a position that no word has, so no phrase crosses them.

*Extending* a phrase by a word is a shift and an AND: the starts of ``p w`` are the starts
of ``p`` that are also positions of ``w`` shifted back by the words of ``p``; the popcount
is the number of occurrences, overlaps included.  All words are tried at once, block by
block.  Counts are summed over shards:

1. Popcounts of single words.
2. Pairs of frequent words, as 64-bit hashes.  They only choose what step 3 looks at.
3. Depth first, a run of first words at a time: pairs, triples and quadruples of which
   every neighbouring pair may be frequent, with their texts.  These counts are exact.

Between the steps workers get a bit set of the hashes of what was frequent, of 32 MB at
most: it may let a rare phrase through, whose count decides later, and never loses one.

Nulls: a null text is empty, a null language ``und``.  Repeated rows count each time.
A very long text is cut after ``CUT_BYTES``; a part also holds the three next tokens, but
only starts before them count.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdex.llm.common import CHUNK_BYTES, Scratch, map_batches, materialize, slices, spread

#: Text of a shard, and of all shards that a task has open.
SHARD_BYTES = 16 << 20
OPEN_BYTES = 48 << 20
#: A longer text is laid out in parts.
CUT_BYTES = 4 << 20
#: Positions of a block, a power of two and the bits of a mask.
WIDTH, SHIFT = 16, 4
#: Blocks of first words that are extended at once.
RUN = 1 << 15
#: Rows of a result batch.
OUT_ROWS = 1 << 16
#: Bits of a set of hashes: so many a member, at most 2 ** 28 (32 MB).
BITS_EACH, MOST_BITS = 16, 28
LONGEST = 4

MARK = b"."
_BYTES = bytes(46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = re.compile(rb"[^ .]+|\.")
_SHARD = "lang string, words binary, sizes binary, blocks binary, masks binary, spare binary, positions long"


def plain(text: bytes) -> bytes:
    """A-Z in lower case, every end of a piece as a full stop, tabs as spaces."""
    return text.translate(_BYTES)


def tokens(flat: bytes) -> pa.DictionaryArray:
    """Words and full stops."""
    found = pa.array(flat.replace(MARK, b" . ").split(b" "), pa.binary())
    return found.filter(pc.not_equal(found, b"")).dictionary_encode()


def parts(flat: bytes, limit: int) -> Iterator[tuple[bytes, list[bytes]]]:
    """A text in parts of about ``limit`` bytes that end with a token, and the next tokens behind each."""
    start = 0
    while len(flat) - start > limit:
        ends = [at for at in (flat.find(b" ", start + limit), flat.find(MARK, start + limit)) if at >= 0]
        if not ends:
            break
        end = min(ends)
        yield flat[start:end], [m.group() for m in islice(_TOKEN.finditer(flat, end), LONGEST - 1)]
        start = end
    yield (flat[start:] if start else flat), []


class Layout:
    """The open shard of a language."""

    def __init__(self, lang: str):
        self.lang, self.size, self.short, self.held = lang, 0, [], 0
        self.chunks: list[pa.DictionaryArray] = []
        self.spare: list[int] = []
        self.length = 0

    def add(self, text: bytes, cut: int) -> None:
        self.size += len(text)
        if len(text) <= cut:
            self.short.append(text)
            self.held += len(text)
            if self.held >= CHUNK_BYTES:
                self.settle()
            return
        self.settle()
        for part, behind in parts(plain(text), cut):
            self.put(tokens(part))
            self.spare += range(self.length, self.length + len(behind))
            self.put(pa.array([*behind, MARK], pa.binary()).dictionary_encode())

    def settle(self) -> None:
        if self.short:
            self.put(tokens(plain(b" . ".join([*self.short, b""]))))
            self.short, self.held = [], 0

    def put(self, found: pa.DictionaryArray) -> None:
        self.chunks.append(found)
        self.length += len(found)

    def close(self) -> pa.RecordBatch | None:
        self.settle()
        if not self.length:
            return None
        unified = pa.chunked_array(self.chunks).unify_dictionaries()
        words = unified.chunk(0).dictionary.to_pylist()
        code = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in unified.chunks]).astype(np.int32)
        at = np.argsort(code, kind="stable").astype(np.int32)  # by word, then by position
        code = code[at]
        if MARK in words:
            keep = code != words.index(MARK)
            at, code = at[keep], code[keep]
        if not len(at):
            return None
        block = at >> SHIFT
        new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        masks = np.bitwise_or.reduceat(np.left_shift(1, at & (WIDTH - 1)).astype(np.uint16), new)
        code, block = code[new], block[new]
        used, sizes = np.unique(code, return_counts=True)
        delta = np.diff(block, prepend=0)
        first = np.cumsum(sizes) - sizes
        delta[first] = block[first]
        row = {"lang": self.lang, "words": b" ".join([words[i] for i in used]), "sizes": sizes.astype(np.int32), "blocks": delta.astype(np.int32), "masks": masks, "spare": np.array(self.spare, np.int64)}
        row = {k: v if k == "lang" else packed(v if isinstance(v, bytes) else v.tobytes()) for k, v in row.items()}
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.string() if k == "lang" else pa.binary()) for k, v in row.items()} | {"positions": pa.array([self.length], pa.int64())})


def packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def shards(docs: DataFrame, lang: str, text: str, shard_bytes: int = SHARD_BYTES, cut: int = CUT_BYTES) -> DataFrame:
    """The vertical tables, one row a shard."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Layout] = {}
        for batch in batches:
            for part in slices(batch, 1):
                for name, body in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    layout = opened.setdefault(name, Layout(name))
                    layout.add(body, cut)
                    while layout is not None and (layout.size >= shard_bytes or sum(x.size for x in opened.values()) > OPEN_BYTES):
                        full = max(opened.values(), key=lambda x: x.size)
                        if (row := opened.pop(full.lang).close()) is not None:
                            yield row
                        layout = layout if full is not layout else None
        for layout in opened.values():
            if (row := layout.close()) is not None:
                yield row

    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return map_batches(spread(rows), lay, _SHARD)


class Shard:
    """A shard's words and their bitmaps, as parallel arrays (word, block, mask) in order of words."""

    def __init__(self, row: dict):
        self.lang = row["lang"]
        self.words = unpacked(row["words"]).split(b" ")
        sizes = np.frombuffer(unpacked(row["sizes"]), np.int32)
        block = np.cumsum(np.frombuffer(unpacked(row["blocks"]), np.int32).astype(np.int64))
        first = np.cumsum(sizes) - sizes
        # The running sum starts anew with each word: take off what had come before it.
        base = np.zeros(len(sizes), np.int64)
        base[1:] = block[first[1:] - 1]
        self.block = (block - np.repeat(base, sizes)).astype(np.int32)
        self.mask = np.frombuffer(unpacked(row["masks"]), np.uint16)
        self.word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.n_blocks = (row["positions"] >> SHIFT) + 1
        self.own = np.full(self.n_blocks, (1 << WIDTH) - 1, np.uint16)
        for at in np.frombuffer(unpacked(row["spare"]), np.int64):
            self.own[at >> SHIFT] &= ~np.uint16(1 << (int(at) & (WIDTH - 1)))

    def hashes(self) -> np.ndarray:
        """As Spark's xxhash64(lang, word)."""
        seed = xxhash.xxh64_intdigest(self.lang.encode(), seed=42)
        return np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) for w in self.words), np.uint64, len(self.words))

    def counts(self) -> np.ndarray:
        return np.bincount(self.word, weights=np.bitwise_count(self.mask & self.own[self.block]), minlength=len(self.words)).astype(np.int64)

    def keep(self, chosen: np.ndarray) -> None:
        held = chosen[self.word]
        self.word, self.block, self.mask = self.word[held], self.block[held], self.mask[held]

    def shifted(self, by: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' bitmaps moved back by ``by`` positions, in order of blocks: (first row of each block, word, mask)."""
        low, carry = self.mask >> np.uint16(by), self.mask << np.uint16(WIDTH - by)
        here, over = low != 0, (carry != 0) & (self.block > 0)
        block = np.concatenate([self.block[here], self.block[over] - 1])
        order = np.argsort(block, kind="stable")
        start = np.searchsorted(block[order], np.arange(self.n_blocks + 1))
        return start, np.concatenate([self.word[here], self.word[over]])[order], np.concatenate([low[here], carry[over]])[order]


def extend(block: np.ndarray, mask: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, mask) for every row of a phrase's bitmap that has starts in common with a shifted word."""
    start, word, shifted = index
    n = start[block + 1] - start[block]
    row = np.repeat(np.arange(len(block), dtype=np.int32), n)
    at = np.arange(len(row)) + np.repeat(start[block] - (np.cumsum(n) - n), n)
    both = mask[row] & shifted[at]
    hit = np.flatnonzero(both)
    return row[hit], word[at[hit]], both[hit]


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64 bits for an ordered pair of hashes."""
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(29))


class HashSet:
    """Bits of hashes: no member is missed, others are taken for one now and then."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def hash_set(hashes: DataFrame) -> HashSet:
    """The set of column ``hash``; 32 MB at most reach the driver, as bitmaps that Spark has built."""
    power = min(MOST_BITS, max(15, (hashes.count() * BITS_EACH).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit((1 << power) - 1)) + 1
    pieces = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros(1 << (power - 3), np.uint8)
    for bucket, piece in pieces.toLocalIterator():
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(piece, np.uint8)
    return HashSet(bits)


def runs(shard: Shard, limit: int = RUN) -> Iterator[slice]:
    """Runs of rows of the bitmaps, whole words where these fit."""
    bounds = np.flatnonzero(np.r_[True, shard.word[1:] != shard.word[:-1]]) if len(shard.word) else np.zeros(0, np.int64)
    start, n = 0, len(shard.word)
    while start < n:
        end = n
        if n - start > limit:
            last = bounds[np.searchsorted(bounds, start + limit, "right") - 1]
            end = int(last) if last > start else start + limit
        yield slice(start, end)
        start = end


def summed(key: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their place for each row, and their popcounts."""
    found, place = np.unique(key, return_inverse=True)
    return found, place, np.bincount(place, weights=np.bitwise_count(mask), minlength=len(found)).astype(np.int64)


def word_counts(table: DataFrame) -> DataFrame:
    """(lang, word, a) over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            shard = Shard(row)
            counts = shard.counts()
            for at in range(0, len(counts), OUT_ROWS):
                words = pa.array(shard.words[at : at + OUT_ROWS], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(words)), words, pa.array(counts[at : at + OUT_ROWS])], names=["lang", "word", "a"])

    return map_batches(table, run, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def pair_counts(table: DataFrame, frequent: HashSet) -> DataFrame:
    """(hash, a) of pairs of words that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            shard = Shard(row)
            hashes = shard.hashes()
            shard.keep(frequent.has(hashes))
            index, n = shard.shifted(1), np.int64(len(shard.words))
            for run in runs(shard):
                at, word, mask = extend(shard.block[run], shard.mask[run] & shard.own[shard.block[run]], index)
                key, _, a = summed(shard.word[run][at] * n + word, mask)
                yield pa.RecordBatch.from_arrays([pa.array(pair_hash(hashes[key // n], hashes[key % n]).view(np.int64)), pa.array(a)], names=["hash", "a"])

    return map_batches(table, run, "hash long, a long").groupBy("hash").agg(F.sum("a").alias("a"))


def phrase_counts(table: DataFrame, frequent: HashSet, pairs: HashSet) -> DataFrame:
    """(lang, phrase, size, a) of phrases of which every word and every pair may be frequent, depth first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            shard = Shard(row)
            hashes, words = shard.hashes(), pa.array(shard.words, pa.binary()).view(pa.string())
            shard.keep(frequent.has(hashes))
            index = {by: shard.shifted(by) for by in range(1, LONGEST)}
            n = np.int64(len(shard.words))
            for run in runs(shard):
                block, mask = shard.block[run], shard.mask[run] & shard.own[shard.block[run]]
                phrase, place = np.unique(shard.word[run], return_inverse=True)
                phrases = phrase[:, None]  # the words of each phrase; ``place`` is the phrase of each row
                for size in range(2, LONGEST + 1):
                    at, word, both = extend(block, mask, index[size - 1])
                    held = np.flatnonzero(pairs.has(pair_hash(hashes[phrases[place[at], -1]], hashes[word])))
                    if not len(held):
                        break
                    at, word, mask = at[held], word[held], both[held]
                    key, further, a = summed(place[at] * n + word, mask)
                    phrases = np.concatenate([phrases[key // n], (key % n)[:, None]], axis=1)
                    block, place = block[at], further
                    for i in range(0, len(a), OUT_ROWS):
                        some = phrases[i : i + OUT_ROWS]
                        text = pc.binary_join_element_wise(*(words.take(pa.array(some[:, k])) for k in range(size)), " ")
                        yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(some)), text, pa.array(np.full(len(some), size, np.int32)), pa.array(a[i : i + OUT_ROWS])], names=["lang", "phrase", "size", "a"])

    return map_batches(table, run, "lang string, phrase string, size int, a long").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"))


def exact(count: str) -> Column:
    return F.col(count).cast("decimal(20,0)")


def between(first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.col("ws"), first, n), " ")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Each phrase with l, r and score of its lowest-scoring cut, the first of equals."""
    parts_of = words.select("lang", F.col("word").alias("part"), F.col("a").alias("f")).unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    cuts = phrases.withColumn("ws", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", between(F.lit(1), F.col("k")).alias("head"), between(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = cuts.join(parts_of.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = materialize(cuts.join(parts_of.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]), "cuts")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, outer): the count of the commonest longer phrase around a phrase."""
    longer = phrases.where("size > 2").withColumn("ws", F.split("phrase", " "))
    longer = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    return longer.select("lang", between(F.col("at"), F.col("n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", support: int = 30, covered: int = 80, shard_bytes: int = SHARD_BYTES, cut: int = CUT_BYTES) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of all phrases of 2 to 4 words that occur ``support`` times.

    Without those inside a longer one that has at least ``covered`` percent of their occurrences.
    """
    with Scratch(docs.sparkSession) as scratch:
        table = materialize(shards(docs, lang, text, shard_bytes, cut), "shards")
        words = materialize(word_counts(table), "words")
        often = words.where(F.col("a") >= support)
        frequent = hash_set(often.select(F.xxhash64("lang", "word").alias("hash")))
        pairs = materialize(pair_counts(table, frequent).where(F.col("a") >= support).select("hash"), "pairs")
        phrases = materialize(phrase_counts(table, frequent, hash_set(pairs)).where(F.col("a") >= support), "phrases")
        total = words.groupBy("lang").agg(F.sum("a").alias("n"))
        found = scored(phrases, often).join(contained(phrases), ["lang", "phrase"], "left")
        found = found.where(F.col("outer").isNull() | (exact("outer") * 100 < exact("a") * covered)).drop("outer")
        return scratch.keep(found.join(total, "lang"), "collocations")


def first_of_each(found: DataFrame, limit: int, salts: int = 64) -> DataFrame:
    """The first ``limit`` phrases of each language by score, count and text, with their rank.

    Ranked first within shares of a language, so that no task sorts a whole language.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= limit)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)
