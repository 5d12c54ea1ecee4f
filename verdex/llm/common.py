"""Shared plumbing: reading tables, batching rows for Python workers, shared storage.

Column clashes: every operator names the columns it adds.  If the input already
has a column of that name (in any letter case), the operator's column replaces it.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.operators.lookups import spread

#: Upper bound on the text bytes that a Python worker turns into objects at once.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch where an operator runs a job itself (10,000 texts are some hundred MB with their copies).
BATCH_ROWS = 1_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of ids and small numbers that may be broadcast (some 30 MB in memory); counted before each use.
BROADCAST_ROWS = 1_000_000


#: Paths of the tables written by ``materialize``, in order.
WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share.

    Only in local mode, as in tests, a temporary one serves where none is set; on a
    cluster executors would write to their own disks, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            holder = tempfile.TemporaryDirectory(prefix="verdex-shared-")
            atexit.register(holder.cleanup)
            base = shared_dir.own = holder.name
    return base.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_ROWS`` rows for the time of the block; the session's own setting comes back."""
    before = spark.conf.get(ARROW_ROWS)
    limit_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def limit_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to at most ``BATCH_ROWS`` rows."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage in a way that outlives lost executors, and gives later joins an
    exchange directly above a scan, which adaptive execution can split when skewed.
    """
    path = f"{shared_dir(df.sparkSession)}/verdex-{tag}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written inside the block go when it ends; ``keep`` writes one that stays."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scratch:
        self.mark, self.kept = len(WRITTEN), []
        return self

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        out = materialize(df, tag)
        self.kept.append(WRITTEN[-1])
        return out

    def __exit__(self, *_: object) -> None:
        remove(self.spark, [p for p in WRITTEN[self.mark :] if p not in self.kept])
        WRITTEN[self.mark :] = self.kept


def if_small(rows: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Marked for broadcast if counted to be at most ``limit`` narrow rows (or ``limit`` of a summed weight); else joined by a shuffle."""
    n = rows.count() if weight is None else rows.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(rows) if n <= limit else rows


def drop_materialized(spark: SparkSession) -> None:
    """Remove the tables that this process has written; results that still read them fail afterwards."""
    remove(spark, WRITTEN)
    WRITTEN.clear()


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def without(df: DataFrame, names: list[str]) -> DataFrame:
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` whose workers, which are reused, give back what a task has freed.

    The session's ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB) bounds a
    batch; operators cut it again by bytes before they make objects of it.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, size_of: int | None, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that column ``size_of`` has about ``limit`` bytes a slice."""
    if size_of is None or batch.num_rows == 0:
        yield batch
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(size_of)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def append_columns(
    df: DataFrame,
    make: Callable[[], Callable[[list], list[pa.Array]]],
    fields: list[T.StructField],
    on: str,
    keep: list[str] | None = None,
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """Run a function over the values of column ``on`` in Arrow batches.

    ``make`` is called once per task and returns a function from a list of values
    (``str``/``bytes``/None) to one Arrow array per field.  All other columns pass
    through untouched; ``keep`` restricts which columns are returned.
    """
    base = without(df, [f.name for f in fields if f.name.lower() != on.lower()])
    carried = [c for c in (base.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in fields}]
    needed = list(dict.fromkeys([*carried, on]))
    source = spread(base.select(*[F.col(f"`{c}`") for c in needed]))
    at = needed.index(on)
    schema = T.StructType([*(source.schema[c] for c in carried), *fields])
    where = [needed.index(c) for c in carried]
    names = [*carried, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in slices(batch, at, limit):
                made = apply(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in where), *made], names=names)

    return map_batches(source, run, schema)
