"""Incremental import as a stream: new header files are picked up and written by version.

A bundle may come in parts over many micro-batches.  Parts that wait lie in an inbox
beside the catalogue, a folder an epoch and in it one a bundle; a bundle that says how
many files it has is imported by the batch that completes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from verdex import schemas
from verdex.functions.paths import absolute
from verdex.operators.lookups import broadcast_if_small
from verdex.plans.ingest import Options, ingest_headers
from verdex.sources.catalog import Change, Storage

DROPS = "bundle_name string, release string, build string, relative_path string, content binary, n_files long"
INBOX = "_inbox"


def receive(batch: DataFrame, epoch: int, out: str, options: Options = Options()) -> int:
    """Put a batch into the inbox and import the bundles that are whole now; returns how many.

    A batch that is repeated replaces its own parts, and a bundle that is imported again
    changes nothing.  Of files that came twice the later epoch counts.  A bundle without
    ``n_files`` is whole as it came.
    """
    spark, storage = batch.sparkSession, Storage(batch.sparkSession, out)
    part = F.substring(F.sha2(F.concat_ws("\0", "bundle_name", "release", "build"), 256), 1, 24)
    batch.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{out}/{INBOX}/epoch={epoch}")
    schema = T.StructType([*batch.schema.fields, T.StructField("epoch", T.LongType()), T.StructField("part", T.StringType())])
    inbox = spark.read.schema(schema).parquet(f"{out}/{INBOX}")
    bundle = ["part", "bundle_name", "release", "build"]
    # Bodies are not read for this: a row a bundle.
    held = inbox.groupBy(*bundle).agg(F.count_distinct("relative_path").alias("n"), F.max("n_files").alias("n_files"))
    whole = held.where(F.coalesce(F.col("n") >= F.col("n_files"), F.lit(True))).select(*bundle).collect()  # a row a bundle
    if not whole:
        return 0
    parts = [r["part"] for r in whole]
    ready = inbox.where(F.col("part").isin(parts))
    last = ready.groupBy("part", "relative_path").agg(F.max("epoch").alias("epoch"))
    found = ready.join(broadcast_if_small(last), ["part", "relative_path", "epoch"], "left_semi").dropDuplicates(["part", "relative_path"])
    found = found.select("bundle_name", "relative_path", absolute(F.col("relative_path")).alias("absolute_path"), "content")
    releases = spark.createDataFrame([(r["release"], r["build"], r["bundle_name"]) for r in whole], "release string, build string, bundle_name string")
    ingest_headers(Change(spark, out), found, releases, options)
    for e in storage.names(INBOX):
        for p in parts:
            storage.remove(f"{INBOX}/{e}/part={p}")
    return len(whole)


def watch(spark: SparkSession, root: str, out: str, checkpoint: str, options: Options = Options(), files_a_batch: int | None = None) -> StreamingQuery:
    """Import (bundle_name, release, build, relative_path, content, n_files) Parquet drops as they arrive; n_files may be missing."""
    reader = spark.readStream.schema(DROPS)
    if files_a_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            receive(batch, epoch, out, options)

    return reader.parquet(root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def symbol_counts(spark: SparkSession, symbols: str) -> DataFrame:
    """A running count of symbols by type over the symbol files of all folders: symbols as written, rewrites included."""
    schema = T.StructType([*schemas.SYMBOLS.fields, T.StructField("g", T.StringType())])
    return spark.readStream.schema(schema).parquet(symbols).groupBy("symbol_type").agg(F.count(F.lit(1)).alias("n"))
