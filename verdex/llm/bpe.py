"""Operator 5: byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut by the tokenizer's pattern; each piece is encoded by halving it down to
single bytes, encoding the halves and joining the two id sequences.  The join rests on a known
property of rank-ordered BPE: a sequence of tokens is *the* encoding of its bytes
exactly when every two neighbouring tokens encode, on their own, to themselves.
So the join re-encodes a window of k tokens on each side of the boundary and
accepts it once both window edges are such neighbours; otherwise k doubles.  Both
sides are correct encodings already, hence everything outside the window stands.
Decoding maps ids to bytes and concatenates neighbours up a tree of small fan-in.

Nulls and empty texts encode to no ids, null ids decode to no bytes.  Rows that
repeat are encoded alike, each for itself; an empty table gives none.  Repeated
pieces, halves and pairs of ids come from bounded tables of a task; that changes the time only.
Very long texts are encoded whole, one at a time in a task; long pieces are merged with a heap.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verdex.llm.common import append_columns

#: Windows of more bytes than this are merged with a heap.
SCAN_BYTES = 96
CACHED_PIECES = 200_000
CACHED_PAIRS = 100_000
#: Halves of pieces, and boundary windows, up to so many bytes are remembered, for many pieces share them.
PART_BYTES, WINDOW_BYTES = 8, 16
CACHED_PARTS = 50_000
#: Neighbours that are concatenated at once above the pairs.
FAN = 8
NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a tiktoken-format file read on the driver."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


class Encoder:
    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary = vocabulary
        self.ranks = {t: i for i, t in enumerate(vocabulary) if t}
        self.split = regex.compile(pattern).findall
        self.pairs = PairBytes(vocabulary)
        self._stable: dict[tuple[int, int], bool] = {}
        self._parts: dict[bytes, list[int]] = {}
        self._merged: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Plain rank-ordered merging; used on boundary windows."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        known = self._merged.get(piece)
        if known is not None:
            return known
        if len(piece) > SCAN_BYTES:
            return self.merge_by_heap(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            merged = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + merged, NEVER)
            if i < len(pairs):
                pairs[i] = ranks.get(merged + parts[i + 1], NEVER)
        merged = [ranks[p] for p in parts]
        if len(piece) <= WINDOW_BYTES:
            if len(self._merged) >= CACHED_PARTS:
                self._merged.clear()
            self._merged[piece] = merged
        return merged

    def merge_by_heap(self, piece: bytes) -> list[int]:
        """The same merges in O(n log n), for windows that had to grow."""
        ranks, n = self.ranks, len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                rank = ranks.get(piece[i : end[after[i]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] < 0 or after[i] >= n or end[after[i]] != stop:
                continue  # one of the two parts has changed since
            gone = after[i]
            end[i], after[i] = end[gone], after[gone]
            end[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [ranks[piece[i : end[i]]] for i in range(n) if end[i] > 0]

    def stable(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > CACHED_PAIRS:
                self._stable.clear()
            known = self._stable[key] = self.merge(self.vocabulary[left] + self.vocabulary[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join([self.vocabulary[t] for t in left[i:] + right[:j]]))
            if (i == 0 or self.stable(left[i - 1], window[0])) and (j == len(right) or self.stable(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) < 2:
            return [self.ranks[piece]] if piece else []
        known = self._parts.get(piece)
        if known is None:
            middle = len(piece) // 2
            known = self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))
            if len(piece) <= PART_BYTES:
                if len(self._parts) >= CACHED_PARTS:
                    self._parts.clear()
                self._parts[piece] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.encode_piece(piece)]

    def decode(self, packed: bytes) -> bytes:
        """Concatenate the bytes of neighbours up a tree: ids by pairs, then FAN at a time."""
        n = len(packed) // 8
        level = list(map(self.pairs.__getitem__, np.frombuffer(packed, "<u8", n).tolist()))
        if len(packed) % 8:
            level.append(self.vocabulary[int.from_bytes(packed[-4:], "little")])
        while len(level) > 1:
            level = [b"".join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        return level[0] if level else b""


class PairBytes(dict):
    """Two ids, packed in one number, to their bytes; refilled from empty when it has grown to its bound."""

    def __init__(self, vocabulary: list[bytes]):
        self.vocabulary = vocabulary

    def __missing__(self, pair: int) -> bytes:
        if len(self) >= CACHED_PAIRS:
            self.clear()
        made = self[pair] = self.vocabulary[pair & 0xFFFFFFFF] + self.vocabulary[pair >> 32]
        return made


class PieceTable(dict):
    """Piece to packed ids; refilled from empty when it has grown to its bound."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.encoder.encode_piece(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


def encode(
    df: DataFrame,
    text: str = "text",
    ids: str = "ids",
    n_tokens: str = "n_tokens",
    vocabulary: str | None = None,
    pattern: str | None = None,
    keep: list[str] | None = None,
    decoded: str | None = None,
) -> DataFrame:
    """Add the ids of each text, packed as little-endian unsigned 32-bit integers, and their count.

    ``decoded`` names a column for the bytes that the ids decode to, made by the same worker.
    """
    words, cut = read_ranks(vocabulary or default_vocabulary()), pattern or default_pattern()

    def make():
        pieces = PieceTable(Encoder(words, cut))
        find, get = pieces.encoder.split, pieces.__getitem__

        def apply(texts: list) -> list[pa.Array]:
            out = [b"".join(map(get, find(t))) if t else b"" for t in texts]
            made = [pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())]
            if decoded is not None:
                made.append(pa.array([pieces.encoder.decode(x) if x else b"" for x in out], pa.binary()))
            return made

        return apply

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())]
    if decoded is not None:
        fields.append(T.StructField(decoded, T.BinaryType()))
    return append_columns(df, make, fields, on=text, keep=keep)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the bytes that packed ids stand for; null ids decode to no bytes."""
    words = read_ranks(vocabulary or default_vocabulary())

    def make():
        encoder = Encoder(words, r"\s")

        def apply(packed: list) -> list[pa.Array]:
            return [pa.array([encoder.decode(p) if p else b"" for p in packed], pa.binary())]

        return apply

    return append_columns(df, make, [T.StructField(decoded, T.BinaryType())], on=ids, keep=keep)
