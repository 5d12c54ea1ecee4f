"""Operator 3: edit-aware token counting with pre-token segment trees.

A document is cut into pre-tokens by the tokenizer's pattern.  Runs of pre-tokens
form leaves that hold a number of characters and of tokens; a tree of sums stands
on the leaves.  An edit replaces a range of characters.  Where a pre-token ends
depends only on the text from its start to two characters past its end (white space
leaves its last character to what follows, and contractions have two letters), so:

* leaves whose end lies before the edit, with two characters of context, stand;
* from there the new text is cut again until a new pre-token boundary falls on an
  old leaf boundary behind the edit; from that point on everything stands.

Only the text between is encoded again, and only sums above changed leaves change.

Nulls: a null text is the empty text (no leaves, no tokens); null edits are none, in an
edit a null number of removed characters is 0 and a null insertion the empty text.
Edits count by places in the text as it was, in any order; those that insert at one
place do so in the order given.  An edit that reaches outside the text, has no place, or
overlaps one before it is left out.  Rows repeat and ids may be null: each row is its
own document; an empty table gives none.  A column of the input that has the name of
one that is added is replaced.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.llm.bpe import Encoder, default_pattern, default_vocabulary, read_ranks
from verdex.llm.common import append_columns, map_batches, slices, without
from verdex.operators.lookups import spread

LEAF_PIECES = 64
#: Counted pre-tokens a worker remembers from task to task (some 120 MB).
CACHED_PIECES = 1_000_000
FAN_OUT = 16
#: The pattern looks two characters past the end of a pre-token; one's own must look no further.
CONTEXT = 2

EDITS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("removed", T.IntegerType()), T.StructField("inserted", T.StringType())]))
KINDS = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
STATE = [T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]


class Counts(dict):
    """Pre-token to number of tokens, bounded."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        n = len(self.encoder.encode_piece(piece))
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = n
        return n


class SumTree:
    """Sums over leaves in levels of FAN_OUT; ``splice`` recomputes only what changed."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = [list(chars)], [list(tokens)]
        self.rebuilt = 0
        self._raise(0)

    def _raise(self, first: int) -> None:
        """Recompute the levels above, from the node over leaf ``first`` on."""
        level = 0
        while len(self.chars[level]) > 1:
            if len(self.chars) == level + 1:
                self.chars.append([])
                self.tokens.append([])
            first //= FAN_OUT
            for sums, below in ((self.chars[level + 1], self.chars[level]), (self.tokens[level + 1], self.tokens[level])):
                del sums[first:]
                sums.extend(sum(below[i : i + FAN_OUT]) for i in range(first * FAN_OUT, len(below), FAN_OUT))
            level += 1
        del self.chars[level + 1 :], self.tokens[level + 1 :]

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        dc, dt = chars - self.chars[0][leaf], tokens - self.tokens[0][leaf]
        for level in range(len(self.chars)):
            self.chars[level][leaf] += dc
            self.tokens[level][leaf] += dt
            leaf //= FAN_OUT

    def total(self) -> int:
        return self.tokens[-1][0] if self.tokens[-1] else 0

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where that leaf starts."""
        if not self.chars[0]:
            return 0, 0
        node = start = 0
        for level in range(len(self.chars) - 2, -1, -1):
            node *= FAN_OUT
            last = min(node + FAN_OUT, len(self.chars[level])) - 1
            while node < last and start + self.chars[level][node] <= position:
                start += self.chars[level][node]
                node += 1
        return node, start

    def splice(self, first: int, stop: int, chars: list[int], tokens: list[int]) -> None:
        if stop - first == len(chars):
            for i, (c, t) in enumerate(zip(chars, tokens)):
                self._set(first + i, c, t)
        else:
            self.chars[0][first:stop], self.tokens[0][first:stop] = chars, tokens
            self._raise(first)


class Counter:
    def __init__(self, encoder: Encoder):
        self.cut = encoder.split
        self.pieces = encoder.split.__self__.finditer
        self.get = Counts(encoder).__getitem__

    def leaves(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        lengths, counts = list(map(len, pieces)), list(map(self.get, pieces))
        cuts = range(0, len(pieces), LEAF_PIECES)
        return [sum(lengths[i : i + LEAF_PIECES]) for i in cuts], [sum(counts[i : i + LEAF_PIECES]) for i in cuts]

    def build(self, text: str | None) -> SumTree:
        return SumTree(*self.leaves(self.cut(text or "")))

    def edit(self, text: str, tree: SumTree, at: int, removed: int, inserted: str) -> tuple[str, int]:
        """Apply one edit to text and tree; returns the text and how many characters were encoded again."""
        new = text[:at] + inserted + text[at + removed :]
        first, start = tree.leaf_at(max(0, at - CONTEXT))
        if first and start > at - CONTEXT:
            first -= 1
            start -= tree.chars[0][first]
        shift = len(inserted) - removed
        old_end, leaf = start, first
        chars = tree.chars[0]
        fresh: list[str] = []
        where = start
        stop = len(chars)
        for match in self.pieces(new, start):
            if where >= at + len(inserted) and where > start:
                while leaf < len(chars) and old_end + shift < where:
                    old_end += chars[leaf]
                    leaf += 1
                if old_end + shift == where and old_end >= at + removed:
                    stop = leaf
                    break
            fresh.append(match[0])
            where = match.end()
        tree.splice(first, stop, *self.leaves(fresh))
        return new, where - start


def sound(edits: list[dict], n: int) -> list[tuple[int, int, str]]:
    """Edits that lie in a text of ``n`` characters and do not overlap, by place; equal places as given."""
    out, free = [], 0
    for e in sorted((e for e in edits if e is not None and e["at"] is not None), key=lambda e: e["at"]):
        at, removed = e["at"], e["removed"] or 0
        if removed >= 0 and free <= at <= n - removed:
            out.append((at, removed, e["inserted"] or ""))
            free = at + removed
    return out


_HELD: dict[tuple[int, str], Counter] = {}


def held_counter(words: list[bytes], cut: str) -> Counter:
    """This worker's counter for a vocabulary and pattern."""
    key = zlib.crc32(b"\0".join(words)), cut
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Counter(Encoder(words, cut))
    return _HELD[key]


def build(df: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the leaves of each text's tree and its number of tokens."""
    words, cut = read_ranks(vocabulary or default_vocabulary()), pattern or default_pattern()

    def make():
        counter = held_counter(words, cut)

        def apply(texts: list) -> list[pa.Array]:
            trees = [counter.build(t) for t in texts]
            return [
                pa.array([t.chars[0] for t in trees], pa.list_(pa.int32())),
                pa.array([t.tokens[0] for t in trees], pa.list_(pa.int32())),
                pa.array([t.total() for t in trees], pa.int64()),
            ]

        return apply

    return append_columns(df, make, STATE, on=text, keep=keep)


def update(
    state: DataFrame,
    edits: str = "edits",
    text: str = "text",
    reencoded: str = "n_chars_reencoded",
    vocabulary: str | None = None,
    pattern: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Apply each row's edits to its text and tree; adds how many characters were encoded again.

    ``keep`` names the columns to return, of the input's and of those that change.
    """
    words, cut = read_ranks(vocabulary or default_vocabulary()), pattern or default_pattern()
    changed = [T.StructField(text, T.StringType()), *STATE, T.StructField(reencoded, T.LongType())]
    source = without(state, [reencoded])
    if keep is not None:
        wanted_names = {c.lower() for c in keep}
        changed = [f for f in changed if f.name.lower() in wanted_names]
    own = {text.lower(), reencoded.lower(), *(f.name for f in STATE)}
    carried = [c for c in (source.columns if keep is None else keep) if c.lower() not in own]
    given = [*carried, text, "leaf_chars", "leaf_tokens", edits]
    source = spread(source).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)])
    schema = T.StructType([*(T.StructField(c, source.schema[i].dataType) for i, c in enumerate(carried)), *changed])
    n = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held_counter(words, cut)
        for part in itertools.chain.from_iterable(slices(b, n) for b in batches):
            rows = []
            for value, chars, tokens, wanted in zip(*(part.column(n + k).to_pylist() for k in range(4))):
                value, again = value or "", 0
                if not wanted:
                    rows.append((value, chars or [], tokens or [], sum(tokens or []), 0))
                    continue
                tree = SumTree(chars or [], tokens or [])
                for edit in reversed(sound(wanted, len(value))):
                    value, more = counter.edit(value, tree, *edit)
                    again += more
                rows.append((value, tree.chars[0], tree.tokens[0], tree.total(), again))
            columns = list(zip(*rows)) if rows else [()] * 5
            made = dict(zip([text, "leaf_chars", "leaf_tokens", "n_tokens", reencoded], zip(columns, KINDS)))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *(pa.array(*made[f.name]) for f in changed)], names=schema.names)

    return map_batches(source, run, schema)


#: Fixed patterns of what the redaction edits replace, and with what.
REDACTIONS = re.compile(r"(?P<EMAIL>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<IP>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<SECRET>\b(?=[a-f]*\d)[0-9a-f]{32,}\b)|(?P<PHONE>\+?\d[\d ()-]{7,}\d)")


#: What every redaction holds; texts without it are not searched further.
HINT = re.compile(r"[@\d]")


def redaction_edits(df: DataFrame, text: str = "text", edits: str = "edits", keep: list[str] | None = None) -> DataFrame:
    """Add the edits that replace e-mail and IP addresses, telephone numbers and long hex secrets by a tag."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("removed", pa.int32()), ("inserted", pa.string())]))

    def make():
        def apply(texts: list) -> list[pa.Array]:
            hint = HINT.search
            return [pa.array([[{"at": m.start(), "removed": m.end() - m.start(), "inserted": f"[{m.lastgroup}]"} for m in REDACTIONS.finditer(t)] if t and hint(t) else [] for t in texts], kind)]

        return apply

    return append_columns(df, make, [T.StructField(edits, EDITS)], on=text, keep=keep)
