"""Exact dedup by a heavy-hitter split, with DataFrame functions alone.

Texts are equal when identical after every run of blanks has become one space; their
SHA-256 stands for them.  Texts are read once: the narrow table of digests is written,
and all else reads that.

1. A Misra-Gries summary (Spark's frequent-items sketch, which decrements its counters
   in batches) of all digests, merged in two levels.  With ``TRACKED`` counters its error
   is at most 3.5/8192 of the rows, so it names every digest with over 1/``SHARE`` of
   them, and at most ``NAMED`` digests in all.
2. The digests so named are counted exactly.  Those that do reach 1/``SHARE`` of the
   rows are the winners: at most ``SHARE``, at any size of the table.
3. Winners are broadcast: their rows are decided where they lie, without a shuffle.
4. All other digests, each with less than that share, are grouped by an ordinary
   shuffle, summed up before it, and joined with their rows.

Nulls: a null text counts as empty; null doc_ids come last, so a group keeps one only
if it has no other.  Empty texts are equal to each other, not to a text of one space.
Very long texts are hashed whole.  Rows that repeat id and text are rows of their own,
of which one is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdex.llm.common import Scratch, materialize, without

#: Counters of a summary: a table of 8192 slots, three quarters full.
TRACKED = 6144
#: A digest with over one of so many rows is heavy.
SHARE = 1024
#: Digests whose estimate can reach that share: fewer than 1 / (1/1024 - 3.5/8192).
NAMED = 2048
#: Summaries that the last merge gets.
SUMMARIES = 256


def normalised(text: str | Column) -> Column:
    """The text with one space for every run of blanks; null is empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: str | Column) -> Column:
    """32 bytes that stand for the normalised text."""
    return F.unhex(F.sha2(normalised(text), 256))


def rank() -> Column:
    """Order among equal texts: ids ascending, null ids last, then place."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))


def named(digests: DataFrame) -> DataFrame:
    """(item): hashes of all digests that may be heavy, ``NAMED`` rows at most."""
    parts = digests.groupBy((F.spark_partition_id() % SUMMARIES).alias("part"))
    parts = parts.agg(F.expr(f"approx_top_k_accumulate(xxhash64(digest), {TRACKED})").alias("summary"))
    # Grouped by a constant, for without a group the summary of an empty partition cannot be read.
    merged = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {TRACKED}), {NAMED})").alias("found"))
    return merged.select(F.explode("found.item").alias("item"))


def groups_of(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank()).alias("first"))


def winners(digests: DataFrame) -> DataFrame:
    """(digest, group_size, first) of every digest with its share of rows, counted exactly; ``SHARE`` rows at most."""
    least = max(2, -(-digests.count() // SHARE))
    met = digests.join(F.broadcast(named(digests)), F.xxhash64("digest") == F.col("item"), "left_semi")
    return materialize(groups_of(met).where(F.col("group_size") >= least), "winners")


def split(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, digest) of all documents, and the winners among their digests."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest(F.col(f"`{text}`")).alias("digest"))
    rows = materialize(rows, "digests")
    return rows, winners(rows)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), a row for each row of ``docs``."""
    with Scratch(docs.sparkSession) as scratch:
        rows, heavy = split(docs, doc_id, text)
        small = rows.join(F.broadcast(heavy), "digest", "left_anti")
        columns = ["doc_id", "row", "digest", "group_size", "first"]
        all_rows = rows.join(F.broadcast(heavy), "digest").select(*columns).unionByName(small.join(groups_of(small), "digest").select(*columns))
        judged = all_rows.select("doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest")
        return scratch.keep(judged, "copies")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies of the winners go where they lie; only other rows meet the ids that stay.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows, heavy = split(docs, doc_id, text)
        small = rows.join(F.broadcast(heavy), "digest", "left_anti")
        firsts = heavy.unionByName(groups_of(small)).select(F.col("digest").alias("__digest"), F.col("first.id").alias("__id"))
        firsts = materialize(firsts, "firsts")
        told = without(docs, ["__digest"]).withColumn("__digest", digest(F.col(f"`{text}`")))
        heads = F.broadcast(heavy.select(F.col("digest").alias("__digest"), F.col("first.id").alias("__id"), F.lit(True).alias("__heavy")))
        told = told.join(heads, "__digest", "left").where(F.col("__heavy").isNull() | F.col("__id").eqNullSafe(F.col(f"`{doc_id}`"))).drop("__id", "__heavy")
        same = (told["__digest"] == firsts["__digest"]) & told[f"`{doc_id}`"].eqNullSafe(firsts["__id"])
        kept = scratch.keep(told.join(firsts, same, "left_semi"), "kept")
        if not kept.groupBy("__digest").count().where("count > 1").isEmpty():  # rows that repeat both id and text
            kept = kept.dropDuplicates(["__digest"])
        return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
