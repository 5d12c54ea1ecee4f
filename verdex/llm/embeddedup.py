"""Operator 2: near-duplicate embeddings by collision counting on one-dimensional projections.

Equal vectors are one node with a weight, so copies cost nothing.  Nodes are dealt
into the cells of ``T`` tables, each cell a box of ``K`` random projections; K grows
with the logarithm of the number of nodes, so that a cell of unrelated vectors
stays about ``CELL_ROWS`` rows, and T follows from the recall wanted: work grows as
n to the power 1.2, not 2.  Cells that near copies fill beyond ``BLOCK_ROWS`` are dealt
as pairs of blocks, whole, to many tasks.

In a cell, ``PROJECTIONS`` further random projections are sorted one by one; each vector
opens a window centred on its own projection, and the vectors that fall in it
collide with it.  A pair whose collisions reach the calibrated count (pairs at the
threshold reach it with probability ``RECALL``) is a candidate.  For this only ids and
projections travel, as 16-bit steps; vectors follow to the members of candidate pairs
alone.  Those are verified by their cosine in double precision.  A pair that
meets in several tables counts in its first.

Tasks return each node's number of links and a spanning forest of its components
among them, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
values link with nothing.  Vectors of different lengths never link.  Rows that
repeat a vec_id are vectors of their own; a row's component is the smallest
non-null vec_id reachable, itself included (null only if all of those are null).
Other columns of the input are not read.  An empty table gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.llm.common import Scratch, map_batches, materialize
from verdex.llm.components import components
from verdex.operators.lookups import spread

RECALL = 0.9999
PROJECTIONS = 48
#: Steps of a quantised projection in half a window.
STEPS = 16
CELL_ROWS = 384
BLOCK_ROWS = 512
#: Cell width in distances at the threshold.
CELL_WIDTH = 4.0
#: Distance of unrelated unit vectors.
FAR = math.sqrt(2.0)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def same_cell(distance: float, width: float) -> float:
    """Probability that two vectors at a distance share a randomly shifted interval of a Gaussian projection."""
    c = width / distance
    return 1 - 2 * normal_cdf(-c) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


@dataclass(frozen=True)
class Plan:
    threshold: float
    distance: float
    per_table: int
    tables: int
    count: int


def plan(nodes: int, threshold: float, recall: float = RECALL) -> Plan:
    distance = math.sqrt(max(2 - 2 * threshold, 1e-12))
    near, far = same_cell(distance, CELL_WIDTH * distance), same_cell(FAR, CELL_WIDTH * distance)
    per_table = max(1, math.ceil(math.log(max(nodes, 2) / CELL_ROWS) / math.log(1 / far)))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**per_table)))
    p = 2 * normal_cdf(1.0) - 1
    tail, count = 0.0, PROJECTIONS
    while count > 0:  # the largest count that pairs at the threshold reach with the recall
        tail += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if tail >= recall:
            break
        count -= 1
    return Plan(threshold, distance, per_table, tables, count)


class Space:
    """The random projections for vectors of one length."""

    def __init__(self, how: Plan, length: int, seed: int = 5):
        rng = np.random.default_rng([seed, length, how.per_table, how.tables])
        self.how = how
        self.cells = rng.normal(size=(length, how.tables * how.per_table))
        self.width = CELL_WIDTH * how.distance
        self.shift = rng.uniform(0, self.width, how.tables * how.per_table)
        self.mixers = rng.integers(0, 1 << 63, (how.tables, how.per_table), dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, how.tables, dtype=np.uint64)
        self.lines = rng.normal(size=(length, PROJECTIONS))

    def steps(self, unit: np.ndarray) -> np.ndarray:
        """Quantised projections; what lies within half a window lies within STEPS."""
        return np.clip(np.floor(unit @ self.lines * (STEPS / self.how.distance)), -32000, 32000).astype(np.int16)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each row in each table, as 64-bit keys."""
        box = np.floor((unit @ self.cells + self.shift) / self.width).astype(np.int64).astype(np.uint64)
        box = box.reshape(len(unit), self.how.tables, self.how.per_table)
        with np.errstate(over="ignore"):
            key = self.salt + (box * self.mixers).sum(axis=2, dtype=np.uint64)
            key ^= key >> np.uint64(31)
            key *= np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.astype(np.int64)


def unit_rows(values: pa.Array, length: int) -> np.ndarray:
    flat = values.flatten() if hasattr(values, "flatten") else values
    rows = np.asarray(flat, dtype=np.float64).reshape(-1, length)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Spaces(dict):
    def __init__(self, how: Plan):
        self.how = how

    def __missing__(self, length: int) -> Space:
        self[length] = Space(self.how, length)
        return self[length]


def cosines(unit: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, in double precision; close calls are summed in one fixed order."""
    product = unit[left] @ unit[right].T
    near = product >= threshold
    p, q = np.nonzero(np.abs(product - threshold) < 1e-9)
    near[p, q] = (unit[left[p]] * unit[right[q]]).sum(axis=1) >= threshold
    return near


def collisions(left: np.ndarray, right: np.ndarray, half: int) -> np.ndarray:
    """How many of their (integer) projections put each right row into each left row's window."""
    (n, width), m = left.shape, len(right)
    counts = np.zeros((n, m), np.uint8)
    if not n or not m:
        return counts
    # All projections are sorted in one go, each in a range of numbers of its own.
    apart = np.arange(width, dtype=np.int64) * (1 << 18)
    flat = (right + apart).T.ravel()
    order = np.argsort(flat, kind="stable")
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.arange(len(flat))
    line, own = flat[order], (left + apart).T.ravel()
    first = np.repeat(np.arange(width) * m, n)
    small = np.int16 if m < 1 << 15 else np.int32
    low = np.searchsorted(line, own - half, side="left") - first
    size = (np.searchsorted(line, own + half, side="right") - first - low).astype(small).reshape(width, n, 1)
    rank = (rank - np.repeat(np.arange(width) * m, m)).astype(small).reshape(width, 1, m)
    low = low.astype(small).reshape(width, n, 1)
    unsigned = np.uint16 if small is np.int16 else np.uint32
    some = max(1, (1 << 18) // (n * m))  # projections that are counted together
    for j in range(0, width, some):
        # One unsigned comparison says low <= rank < low + size.
        inside = (rank[j : j + some] - low[j : j + some]).view(unsigned) < size[j : j + some].view(unsigned)
        counts += inside[0] if some == 1 else inside.sum(axis=0, dtype=np.uint8)
    return counts


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> None:
    """Lower the labels of rows until all that are linked, directly or not, share the least."""
    most = np.iinfo(label.dtype).max
    while True:
        low = np.minimum(label[left], np.where(near, label[right][None, :], most).min(axis=1, initial=most))
        high = np.minimum(label[right], np.where(near, low[:, None], most).min(axis=0, initial=most))
        if (low == label[left]).all() and (high == label[right]).all():
            return
        label[left] = low
        label[right] = np.minimum(high, label[right])


def first_met(keys: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray, t: int) -> np.ndarray:
    """Of the near pairs those that share no cell in a table before ``t``."""
    if near.sum() * 16 < near.size:
        p, q = np.nonzero(near)
        near = np.zeros_like(near)
        new = ~(keys[left[p], :t] == keys[right[q], :t]).any(axis=1)
        near[p[new], q[new]] = True
        return near
    near = near.copy()
    for s in range(t):
        code = np.unique(keys[:, s], return_inverse=True)[1].astype(np.int32)
        near &= code[left][:, None] != code[right][None, :]
    return near


DEALT = T.StructType([T.StructField("cell", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("steps", T.BinaryType())])
MET = T.StructType([T.StructField("cell", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("own", T.IntegerType()), T.StructField("node", T.LongType())])
FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``df``."""
    with Scratch(df.sparkSession) as scratch:
        return scratch.keep(_near_duplicates(df, vec_id, embedding, threshold, recall), "near")


def deal(nodes: DataFrame, how: Plan) -> DataFrame:
    """(node, vector) to the node's cell in every table, with its quantised projections."""

    def run(batches):
        spaces = Spaces(how)
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths()) if batch.num_rows else np.empty(0, int)
            for length in np.unique(lengths):
                some = batch.filter(pa.array(lengths == length))
                for at in range(0, some.num_rows, 1024):
                    part = some.slice(at, 1024)
                    unit, space = unit_rows(part.column(1), int(length)), spaces[int(length)]
                    keys = space.keys(unit)
                    n, t = keys.shape
                    pick = pa.array(np.repeat(np.arange(n), t))
                    steps = pa.array([row.tobytes() for row in space.steps(unit)], pa.binary())
                    columns = [pa.array(keys.ravel()), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(np.full(n * t, length, np.int32)), part.column(0).take(pick), steps.take(pick)]
                    yield pa.RecordBatch.from_arrays(columns, names=DEALT.names)

    return map_batches(nodes.select("node", "vector"), run, DEALT)


def _near_duplicates(df: DataFrame, vec_id: str, embedding: str, threshold: float, recall: float) -> DataFrame:
    element = df.schema[embedding].dataType.elementType
    vector = F.col(embedding) if isinstance(element, (T.FloatType, T.DoubleType)) else F.col(embedding).cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = spread(df.select(F.col(vec_id).alias("vec_id"), vector.alias("vector")))
    rows = rows.select("vec_id", F.when(usable, F.col("vector")).alias("vector"))
    # Two hashes with different seeds tell 128 bits of vectors apart.
    full = F.col("vector").isNotNull()
    rows = rows.withColumns({"h1": F.when(full, F.xxhash64("vector", F.lit(1))), "h2": F.when(full, F.xxhash64(F.lit(2), "vector"))})
    named = materialize(rows.select("vec_id", "h1", "h2"), "hashed")
    # Equal vectors are one node: any row's vector serves.
    nodes = rows.where(full).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    weights = nodes.select("node", "h1", "h2", "weight", "least")
    how = plan(nodes.count(), threshold, recall)

    dealt = materialize(deal(nodes, how), "dealt")
    cells = dealt.groupBy("cell", "t", "length").count().where("count > 1")
    cells = materialize(cells.select("cell", "t", "length", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), "cells")
    # A row meets its own block and every other once: (own, j) and (i, own).
    placed = dealt.join(cells, ["cell", "t", "length"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cell", "t", "length", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "steps")

    def meet(table: pa.Table) -> pa.Table:
        """Members of a pair of blocks that have a candidate partner in it."""
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own = table.column("own").to_numpy()
        steps = np.frombuffer(b"".join(table.column("steps").to_pylist()), np.int16).reshape(len(own), -1).astype(np.int32)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        met = np.zeros(len(own), bool)
        for start in range(0, len(left), BLOCK_ROWS):
            some = left[start : start + BLOCK_ROWS]
            hits = (collisions(steps[some], steps[right], STEPS) >= how.count) & (some[:, None] != right[None, :])
            met[some] |= hits.any(axis=1)
            met[right] |= hits.any(axis=0)
        return table.select(MET.names).filter(pa.array(met))

    met = materialize(placed.groupBy("cell", "t", "length", "i", "j").applyInArrow(meet, MET), "met")
    carried = met.join(nodes.select("node", "weight", "vector"), "node")

    def count_links(table: pa.Table) -> pa.Table:
        t, i, j = (table.column(c)[0].as_py() for c in ("t", "i", "j"))
        node, weight, own = (table.column(c).to_numpy() for c in ("node", "weight", "own"))
        vectors = table.column("vector").combine_chunks()
        lengths = np.asarray(vectors.value_lengths())
        links, label = np.zeros(len(node)), np.arange(len(node))
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            unit = unit_rows(vectors.take(pa.array(at)), int(length))
            keys = held_spaces(how)[int(length)].keys(unit)
            left = np.flatnonzero(own[at] == i)
            right = left if i == j else np.flatnonzero(own[at] == j)
            for start in range(0, len(left), BLOCK_ROWS):
                some = left[start : start + BLOCK_ROWS]
                near = cosines(unit, some, right, how.threshold) & (some[:, None] != right[None, :])
                near = first_met(keys, some, right, near, t)
                links[at[some]] += near @ weight[at[right]].astype(np.float64)
                if i != j:
                    links[at[right]] += weight[at[some]].astype(np.float64) @ near
                forest(near, at[some], at[right], label)
        # Chunks of one block may have lowered each other's labels: follow them to their roots.
        while (label != label[label]).any():
            label = label[label]
        some, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
        return pa.table(
            {
                "a": pa.array(np.concatenate([node[some], node[tied]]), pa.int64()),
                "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[label[tied]], pa.int64())]),
                "n": pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(tied), np.int64)]), pa.int64()),
            }
        )

    found = materialize(carried.groupBy("cell", "t", "i", "j").applyInArrow(count_links, FOUND), "found")
    counts = materialize(found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "counts")
    labels = components(found.where("b is not null"))
    grouped = weights.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    names = materialize(grouped.groupBy("label").agg(F.min("least").alias("component_id")), "names")
    facts = grouped.join(names, "label").join(counts, "node", "left")
    facts = materialize(facts.select("h1", "h2", "component_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "facts")
    out = named.join(facts, ["h1", "h2"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


_HELD: dict[Plan, Spaces] = {}


def held_spaces(how: Plan) -> Spaces:
    """A worker's projections, kept between groups."""
    if how not in _HELD:
        _HELD.clear()
        _HELD[how] = Spaces(how)
    return _HELD[how]
