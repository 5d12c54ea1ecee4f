"""The index of names: which paths have three letters in a row in their file name or in an owner's name.

A search for a keyword of three letters or more intersects the postings of its trigrams;
only the paths found, and only the buckets that they lie in, are read from the tables,
whose names are then tested.  So what the index says too much costs time alone: postings
are added with a path or an owner, and stay when a version takes the owner back, until
``rebuild``.  A shorter keyword has no trigram, and its search reads all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.sources.catalog import WHOLE, Catalog, Change, Conflict, bucket_of, shelf_of

SIZE = 3
#: Trigrams of a keyword that are looked up, a bit each; the names found are tested with the whole keyword.
MOST = 63
#: So many folders of postings become one.
FOLDERS = 8


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text, none if it is shorter."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (SIZE - 1), F.lit(1)))
    every = F.transform(places, lambda i: F.substring(text, i, F.lit(SIZE)))
    return F.array_distinct(F.filter(every, lambda g: F.length(g) == SIZE))


def postings(names: DataFrame) -> DataFrame:
    """(gram, path_id) of (path_id, name) rows, each once."""
    return names.select(F.explode(grams_of(F.col("name"))).alias("gram"), "path_id").distinct()


def names_of(paths: DataFrame, presence: DataFrame) -> DataFrame:
    """(path_id, name) of files and owners."""
    return paths.select("path_id", F.col("file_name_lc").alias("name")).unionByName(presence.select("path_id", F.col("owner_name_lc").alias("name")).distinct())


def of_catalog(c: Catalog) -> DataFrame:
    """All postings of a catalogue."""
    return postings(names_of(c.paths, c.symbol_presence))


def refresh(change: Change, versions: list[int], fresh_paths: DataFrame) -> None:
    """Add the postings of new paths and of owners that a path did not have before."""
    if not versions:
        return
    now, before = change.catalog(), change.before
    numbers = F.col("version_num").isin(versions)
    here = now.file_instances.where(numbers).select("version_num", "content_id", "path_id")
    pairs = now.symbols.where(numbers).select("version_num", "content_id", "owner_name_lc").distinct().join(here, ["version_num", "content_id"])
    held = before.symbol_presence.select("path_id", "owner_name_lc")
    owners = pairs.select("path_id", "owner_name_lc").distinct().join(held, ["path_id", "owner_name_lc"], "left_anti")
    change.write("name_grams", postings(names_of(fresh_paths, owners)), replace=before.name_grams is None)


def rebuild(spark: SparkSession, root: str) -> None:
    """Write the index anew from what the catalogue has now."""
    change = Change(spark, root)
    change.rely("paths", "symbol_presence")
    try:
        change.write("name_grams", of_catalog(change.before))
        change.commit()
    except BaseException:
        change.abandon()
        raise


def compact(spark: SparkSession, root: str, most: int = FOLDERS) -> bool:
    """Merge the folders of postings if there are ``most`` or more; an import that comes between wins."""
    change = Change(spark, root)
    if len(change.next["tables"].get("name_grams", {}).get(WHOLE, [])) < most:
        return False
    try:
        change.write("name_grams", change.before.name_grams.select("gram", "path_id").distinct())
        change.commit()
    except Conflict:
        change.abandon()
        return False
    except BaseException:
        change.abandon()
        raise
    return True


def trigrams(spark: SparkSession, keyword: str) -> list[tuple[str, int]]:
    """The keyword's trigrams, made as those of names are, and their shelves; constants, so no job runs."""
    grams = grams_of(F.lower("k"))
    row = spark.sql("select :k as k", args={"k": keyword}).select(grams.alias("grams"), F.transform(grams, shelf_of).alias("shelves")).first()
    return list(zip(row["grams"], row["shelves"], strict=True))


def found(c: Catalog, keyword: str) -> DataFrame | None:
    """(path_id) of all paths that may have the keyword in a name; None where only a scan can tell."""
    if c.name_grams is None:
        return None
    found_in = trigrams(c.name_grams.sparkSession, keyword)[:MOST]
    if not found_in:
        return None
    wanted = [g for g, _ in found_in]
    rows = c.name_grams.where(F.col("gram").isin(wanted))
    if "shelf" in rows.columns:
        rows = rows.where(F.col("shelf").isin(sorted({s for _, s in found_in})))
    bit = F.coalesce(*[F.when(F.col("gram") == g, F.lit(1 << i).cast("long")) for i, g in enumerate(wanted)])
    return rows.groupBy("path_id").agg(F.bit_or(bit).alias("bits")).where(F.col("bits") == (1 << len(wanted)) - 1).select("path_id")


def narrowed(table: DataFrame, paths: DataFrame | None) -> DataFrame:
    """The rows of these paths; of a table that lies by buckets, only theirs are read."""
    if paths is None:
        return table
    if "bucket" in table.columns:
        # A set of BUCKETS numbers at most, found before the table is scanned.
        buckets = paths.agg(F.collect_set(bucket_of(F.col("path_id")))).scalar()
        table = table.where(F.array_contains(buckets, F.col("bucket")))
    return table.join(paths, "path_id", "left_semi")
