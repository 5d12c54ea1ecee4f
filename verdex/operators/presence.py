"""Symbol presence: for every symbol of a path the set of versions that have it.

A set is a bitmap, whatever the number of versions: one row (key, word, bits) for each 64
versions of which it has any, bit i of word w standing for version 64 w + i.  Unions are
``bit_or`` in the generated code of hash aggregates; the greatest member, a test for a
member and the sorted array come from the bits when they are asked for.

Stored presence is a table of mergeable parts, as the manifest has it: a change writes
rows of its own versions into a folder of its own, which owns them from then on.  What
older folders have of these versions is masked when they are read, so a version that is
imported again takes back what it no longer has, and no other row is written for it.
Rows of one key from several folders are merged by whoever needs the whole set.
``compact`` merges folders of like size, so there are few of them however many imports
there were, and each row is written again a logarithmic number of times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators.lookups import broadcast_if_small
from verdex.sources.catalog import OWNED, Catalog, Change, Conflict

KEY = ["path_id", "owner_kind", "owner_name", "symbol_type", "symbol_key"]
#: So many folders of like size become one.
FAN = 4


def target_versions(c: Catalog, bundles: list[str] | None = None, version_ids: list[str] | None = None) -> DataFrame:
    """Version numbers that pass both filters; an absent filter passes all."""
    rows = c.versions
    if bundles:
        rows = rows.where(F.col("bundle_name").isin(bundles))
    if version_ids:
        rows = rows.where(F.col("version_id").isin(version_ids))
    return rows.select("version_num").distinct().orderBy("version_num")


def word_of(version: Column) -> Column:
    return F.shiftright(version.cast("long"), 6).cast("int")


def bit_of(version: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), version.bitwiseAND(63).cast("int"))


def greatest() -> Column:
    """The greatest version of a row's bitmap."""
    return F.col("word").cast("long") * 64 + F.length(F.bin("bits")) - 1


def has(version_num: int) -> Column:
    """Is the version in the row's bitmap?"""
    return (F.col("word") == version_num >> 6) & (F.getbit("bits", F.lit(version_num & 63)) == 1)


def versions_of(word: Column, bits: Column) -> Column:
    """The versions of a bitmap, ascending."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)
    return F.transform(places, lambda i: i + word.cast("long") * 64)


def sets(presence: DataFrame, keys: list[str] = KEY, *more: Column) -> DataFrame:
    """(keys, versions): the whole set of each key as a sorted array, whatever rows it lies in."""
    words = presence.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"), *more)
    each = F.struct("word", versions_of(F.col("word"), F.col("bits")).alias("versions"))
    held = words.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("words"))
    return held.select(*keys, F.flatten(F.transform("words", lambda w: w["versions"])).alias("versions"))


def build(c: Catalog, versions: DataFrame | None = None) -> DataFrame:
    """Presence of the given versions (default all) in one pass.

    Both sides lie by version, so the filter prunes partitions.  A key has a row a version
    at most, so rows move once, by key, and are summed where they arrive.
    """
    instances = c.file_instances.select("version_num", "path_id", "content_id")
    if versions is not None:
        instances = instances.join(broadcast_if_small(versions.select("version_num")), "version_num", "left_semi")
    on = ["content_id"] + (["version_num"] if "version_num" in c.symbols.columns else [])
    met = c.symbols.select(*on, "owner_kind", "owner_name", "symbol_type", "symbol_key").join(instances, on)
    rows = met.select(*KEY, word_of(F.col("version_num")).alias("word"), bit_of(F.col("version_num")).alias("bits"))
    return merged(rows.withColumn("updated_at", F.current_timestamp()))


def merged(presence: DataFrame) -> DataFrame:
    """One row for each key and word: the union of the bits, the latest time.

    Dealt by key alone, so that whole sets (``sets``) need no further shuffle.
    """
    summed = presence.repartition(*KEY).groupBy(*KEY, "word").agg(F.bit_or("bits").alias("bits"), F.max("updated_at").alias("updated_at"))
    return summed.select(*KEY, F.lower("owner_name").alias("owner_name_lc"), "word", "bits", "updated_at")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of the sets by key; commutative, associative and idempotent."""
    columns = [*KEY, "word", "bits", "updated_at"]
    return merged(old.select(*columns).unionByName(new.select(*columns)))


def row_count(presence: DataFrame) -> DataFrame:
    """Merged keys."""
    return presence.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n_keys"))


def refresh(change: Change, versions: list[int], rebuild: bool = False) -> None:
    """Store the presence of versions in a change; nothing that other versions have is read or written.

    ``rebuild`` leaves out all that is stored of others.
    """
    if rebuild:
        for v in change.parts(OWNED) - set(versions):
            change.drop_part(OWNED, v)
    if not versions:
        return
    numbers = change.spark.createDataFrame([(v,) for v in versions], "version_num long")
    change.write(OWNED, build(change.catalog(), numbers), versions=versions)


def tiers(change: Change) -> dict[int, dict[str, list[int]]]:
    """Folders of stored presence with their versions, by the order of magnitude of their size."""
    owned: dict[str, list[int]] = {}
    for version, folders in change.next["tables"].get(OWNED, {}).items():
        for g in folders:
            owned.setdefault(g, []).append(int(version))
    out: dict[int, dict[str, list[int]]] = {}
    for g, held in owned.items():
        size = change.storage.size(f"{OWNED}/g={g}")
        out.setdefault(int(math.log(max(size, 1), FAN)), {})[g] = held
    return out


def compact(spark: SparkSession, root: str, fan: int = FAN) -> int:
    """Merge presence folders, ``fan`` or more of one order of magnitude at a time; returns how many went.

    An import that commits meanwhile and takes one of the versions makes a merge fail, which harms nothing.
    """
    gone = 0
    while True:
        change = Change(spark, root)
        full = [folders for _, folders in sorted(tiers(change).items()) if len(folders) >= fan]
        if not full:
            return gone
        versions = sorted(v for held in full[0].values() for v in held)
        only = {str(v): change.next["tables"][OWNED][str(v)] for v in versions}
        rows = change.read(OWNED, only)
        try:
            change.write(OWNED, merged(rows), versions=versions)
            change.commit()
        except Conflict:
            change.abandon()
            return gone
        except BaseException:
            change.abandon()
            raise
        gone += len(full[0])
