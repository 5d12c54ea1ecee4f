"""Key lookups: joins that behave like a dictionary with one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dimension is broadcast up to this size by the optimizer's estimate; beyond it
#: joins shuffle, unless adaptive execution finds the side small when it has run.
BROADCAST_BYTES = 32 << 20
#: A table of less than this in fewer files than there are cores may lie in one row group, which one task reads.
SPREAD_BYTES = 32 << 20


def dimension(dim: DataFrame, key: str, columns: list[str], unique: bool = False) -> DataFrame:
    """One row a key: of several the greatest, field by field order, so that lookups never multiply rows.

    ``unique`` says that the table's writer keeps one row a key already.
    """
    known = dim.where(F.col(key).isNotNull())
    if unique:
        return broadcast_if_small(known.select(key, *columns))
    keyed = known.groupBy(key).agg(F.max(F.struct(*columns)).alias("__v"))
    return broadcast_if_small(keyed.select(key, *[F.col(f"__v.{c}").alias(c) for c in columns]))


def plan_bytes(rows: DataFrame) -> int:
    """The optimizer's size estimate: file sizes of scans, products for joins.  Runs no job."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(rows: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark for broadcast what the plan's statistics bound."""
    return F.broadcast(rows) if plan_bytes(rows) <= limit else rows


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows of a small table in few files to all cores, before work that is dear by row.

    Larger tables, and those in many files, are read by many tasks anyway and do not move.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(rows) <= SPREAD_BYTES and 0 < len(rows.inputFiles()) < cores:  # files are listed for small tables alone
        return rows.repartition(cores)
    return rows


def inner(facts: DataFrame, dim: DataFrame, key: str, columns: list[str], unique: bool = False) -> DataFrame:
    """Facts whose key is known, with its columns."""
    return facts.join(dimension(dim, key, columns, unique), key)


def left(facts: DataFrame, dim: DataFrame, key: str, columns: list[str], unique: bool = False) -> DataFrame:
    """All facts; the columns are null where the key is unknown."""
    return facts.join(dimension(dim, key, columns, unique), key, "left")


def known(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Facts whose key is known."""
    return facts.join(dim.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose keys the table does not have, one a key."""
    return batch.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
