"""Prefix trie of conversations by prefix-doubling naming.

A node is a distinct sequence of first turns.  Nobody walks the trie from its root and
no sequence is ever written out:

1. Turns are ranked within their conversation by one range sort (a long conversation
   may lie in many ranges) and get dense names, equal turns equal names.
2. Blocks of 2, 4, 8, .. turns that start at a multiple of their length are named, a
   join round a length: a block's name stands for the pair of names of its halves.
3. Prefixes are composed by the binary decomposition of their length, longest block
   first: the prefix of 13 turns is named by the pair (prefix of 12, block 12..13), that
   of 12 by (prefix of 8, block 8..12).  So all prefixes have names after as many rounds.
4. Rows with one name are one node.  All sums over subtrees are sums over the node's own
   members: a member is the *head* of a node if it is its smallest, and then it is the
   head of all deeper nodes on its path.  Nodes are thus told apart by (head, depth),
   each node below is charged to its head's row, and the rounds above have summed up
   the code points before every turn.

Rounds are as many as the longest conversation's length has binary digits, each an
aggregate with partial sums and joins above written tables, which adaptive execution
splits where one turn, prefix or conversation holds many of the rows.

Nulls: rows without conv_id belong to no conversation and are left out; a null turn comes
first; null role and text are empty.  Turns of one number are ordered by the SHA-256 of
role and text; rows that repeat are turns of their own.  Very long texts are hashed
whole.  An empty table has no conversation, so no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdex.llm.common import Scratch, map_batches, materialize

#: Bytes of one piece of a list of ids on its way to the hash.
PIECE_BYTES = 1 << 16


class Trie(NamedTuple):
    """``nodes``: one row a node.  ``ends``: (conv_id, depth, end), the conversations that end at the node (conv_id, depth)."""

    nodes: DataFrame
    ends: DataFrame


def numbered(rows: DataFrame, name: str, tag: str, first: int = 0) -> DataFrame:
    """The rows, written, with dense numbers from ``first`` in the order they have."""
    written = materialize(rows.withColumn("__at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("__at", 33)
    sizes = written.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # one row a written part
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", (before + first).alias("__before")))
    at = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(offsets, part == F.col("__part")).select(*[F.col(f"`{c}`") for c in rows.columns], at.alias(name))


def turn_key(role: Column, text: Column) -> Column:
    """32 bytes that stand for role and text."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos from 0, key, chars), written."""
    c, t, r, x = (F.col(f"`{n}`") for n in (conv_id, turn, role, text))
    turns = conversations.where(c.isNotNull()).select(c.alias("conv_id"), t.alias("turn"), turn_key(r, x).alias("key"), F.coalesce(F.length(x), F.lit(0)).cast("long").alias("chars"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    ranked = materialize(numbered(turns.repartitionByRange(*by).sortWithinPartitions(*by), "rank", "ranked").drop("turn"), "places")
    starts = materialize(ranked.groupBy("conv_id").agg(F.min("rank").alias("start")), "starts")
    return materialize(ranked.join(starts, "conv_id").select("conv_id", (F.col("rank") - F.col("start")).alias("pos"), "key", "chars"), "turns")


def shared_openings(turns: DataFrame, group: int, modulus: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of c - c % group in place of its own first h, h = crc32(decimal c) % modulus.

    ``group`` conversations at most read the first turns of one.  Returns the turns and
    all conv_ids, those without turns too.
    """
    sizes = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = materialize(sizes.select("conv_id", h.alias("h"), base).join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("kept")), "openings")
    own = turns.join(plan.select("conv_id", "h", "kept"), "conv_id").where("pos >= h").select("conv_id", (F.col("kept") + F.col("pos") - F.col("h")).alias("pos"), "key", "chars")
    firsts = turns.where(F.col("pos") < modulus - 1).select(F.col("conv_id").alias("base"), "pos", "key", "chars")
    opening = plan.where("kept > 0").select("conv_id", "base", "kept").join(firsts, "base").where("pos < kept").select("conv_id", "pos", "key", "chars")
    return materialize(own.unionByName(opening), "rebuilt"), plan.select("conv_id")


def name_pairs(pairs: DataFrame, tag: str, first: int = 0) -> DataFrame:
    """A written table with columns ``left`` and ``right``, and the dense ``name`` of that pair in their place."""
    names = numbered(pairs.select("left", "right").distinct(), "name", tag, first)
    return materialize(pairs.join(names, ["left", "right"]).drop("left", "right"), f"{tag}s")


def blocks(turns: DataFrame) -> list[DataFrame]:
    """(conv_id, at, name, chars) of the blocks of 1, 2, 4, .. turns while there are any, written; ``at`` counts blocks of that length."""
    names = numbered(turns.select("key").distinct(), "name", "key")
    levels = [materialize(turns.join(names, "key").select("conv_id", F.col("pos").alias("at"), "name", "chars"), "turnnames")]
    longest = levels[0].agg(F.max("at")).first()[0]
    if longest is None:  # no turns at all
        return []
    for _ in range(1, (longest + 1).bit_length()):
        half = F.col("at") % 2
        both = levels[-1].groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"), F.sum("chars").alias("chars"))
        levels.append(name_pairs(materialize(both.where(F.col("right").isNotNull()), "halves"), "block"))
    return levels


def paths(levels: list[DataFrame], convs: DataFrame) -> DataFrame:
    """(conv_id, depth, name, before, chars), written: the name of every prefix, the code points of its last turn and of those before it."""
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("name"), zero.alias("chars"))
    found, first = root, 1
    for j in reversed(range(len(levels))):
        block = levels[j].select("conv_id", "at", F.col("name").alias("right"), F.col("chars").alias("more"))
        ends = found.select("conv_id", F.shiftright("depth", j).alias("at"), "depth", F.col("name").alias("left"), "chars").join(block, ["conv_id", "at"])
        longer = materialize(ends.select("conv_id", (F.col("depth") + (1 << j)).alias("depth"), "left", "right", (F.col("chars") + F.col("more")).alias("chars")), "longer")
        named = name_pairs(longer, "prefix", first)
        first = named.agg(F.max("name")).first()[0] + 1  # each length has a prefix: that of the longest conversation
        found = found.unionByName(named)
    last = (levels[0] if levels else root.withColumn("at", zero)).select("conv_id", (F.col("at") + 1).alias("depth"), F.col("chars").alias("last"))
    full = found.join(last, ["conv_id", "depth"], "left").withColumn("last", F.coalesce("last", zero))
    return materialize(full.select("conv_id", "depth", "name", (F.col("chars") - F.col("last")).alias("before"), F.col("last").alias("chars")), "paths")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of conversations given as (conv_id, pos, key, chars); ``convs`` has every conv_id once.

    Nodes have conv_id (the head), depth, parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens; the node's turns are the first ``depth`` turns of its head.
    """
    with Scratch(turns.sparkSession) as scratch:
        rows = paths(blocks(turns), convs)
        nodes = materialize(rows.groupBy("name").agg(F.min("conv_id").alias("head"), F.count(F.lit(1)).alias("n_convs")), "nodes")
        headed = materialize(rows.join(nodes, "name"), "headed")
        is_head = F.col("head") == F.col("conv_id")
        members = headed.groupBy("conv_id").agg(
            F.max("depth").alias("n"),
            F.min(F.when(is_head, F.col("depth"))).alias("from_depth"),
            F.sum(F.when(is_head, 0).otherwise(F.col("chars"))).alias("shared"),
            F.max(F.when(~is_head, F.struct("depth", "head"))).getField("head").alias("above"),
            F.max(F.struct("depth", "name", "head", "n_convs")).alias("end"),
        )
        members = materialize(members, "members")
        stops = members.groupBy(F.col("end.name").alias("name")).agg(F.count(F.lit(1)).alias("n_ends"))
        tops = members.where("end.head = conv_id").select("conv_id", F.col("end.name").alias("name"), F.col("end.n_convs").alias("all"))
        leaves = tops.join(stops, "name").where(F.col("n_ends") == F.col("all")).select("conv_id", F.lit(1).alias("leaf"))
        told = materialize(members.select("conv_id", "n", "from_depth", "shared", "above").join(leaves, "conv_id", "left"), "told")
        opens = (F.col("from_depth") <= F.col("depth") + 1) & (F.col("n") > F.col("depth"))
        trie = headed.join(told, "conv_id").groupBy("name").agg(
            F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.max(F.when(is_head, F.when(F.col("depth") > F.col("from_depth"), F.col("conv_id")).otherwise(F.col("above")))).alias("parent_conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(F.when(opens, 1).otherwise(0)).alias("n_children"),
            F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"),
            F.sum(F.when(is_head, 0).otherwise(F.col("shared") - F.col("before"))).cast("long").alias("saved_tokens"),
        )
        ends = members.select(F.col("end.head").alias("conv_id"), F.col("end.depth").alias("depth"), F.col("conv_id").alias("end"))
        return Trie(scratch.keep(trie.drop("name"), "trie"), scratch.keep(ends, "ends"))


def list_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): of each node's ends, ascending, decimal and joined by commas.

    Lists are sorted by ranges and joined to pieces where they lie.  SHA-256 has no
    parallel form, so the pieces of one node stream through one task, a piece at a time.
    """
    by = ["conv_id", "depth", "end"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": [node[0]], "depth": [node[1]], "end": [first], "piece": [",".join(held)]}, schema=arrow)

        arrow = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("end", pa.int64()), ("piece", pa.string())])
        for batch in batches:
            for c, d, e in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and ((c, d) != node or size >= PIECE_BYTES):
                    yield piece()
                    held, size = [], 0
                if not held:
                    node, first = (c, d), e
                held.append(str(e))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if node is not None:
                for column, value in zip(done, (*node, state.hexdigest()), strict=True):
                    column.append(value)

        for batch in batches:
            for c, d, p in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "depth", "piece")), strict=True):
                if (c, d) == node:
                    state.update(b",")
                else:
                    close()
                    node, state = (c, d), hashlib.sha256()
                state.update(p.encode())
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["conv_id", "depth", "ends_sha256"])
                done = ([], [], [])
        close()
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["conv_id", "depth", "ends_sha256"])

    ids = ends.select(*[F.col(c).cast("long") for c in by])
    cut = map_batches(ids.repartitionByRange(*by).sortWithinPartitions(*by), pieces, "conv_id long, depth long, end long, piece string")
    return map_batches(cut.repartition("conv_id", "depth").sortWithinPartitions(*by), hashes, "conv_id long, depth long, ends_sha256 string")
