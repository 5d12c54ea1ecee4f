"""Dense version numbers and table upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdex.functions.versions import sort_key
from verdex.operators.lookups import new_rows


def assign_numbers(found: DataFrame, existing: DataFrame, allow_old: bool = False) -> DataFrame:
    """Number releases: known ids keep theirs, new ones follow the greatest in release order.

    ``found`` has (release, build, bundle_name); ``existing`` has (version_num, version_id).
    Two bundles with one id get two numbers.  Unless ``allow_old``, a new release that is
    not newer than all existing ones is an error when the result is computed.
    The table of releases is small by nature (a row a release), so one window orders it.
    """
    found = found.withColumns({"version_id": F.concat_ws("|", "release", "build"), "key": F.struct(sort_key(F.col("release")).alias("parts"), F.col("build").alias("build"))})
    held = existing.groupBy("version_id").agg(F.max("version_num").alias("known"))
    bar = F.instr("version_id", "|")
    newest = existing.agg(
        F.coalesce(F.max("version_num"), F.lit(0)).alias("last"),
        F.max(F.struct(sort_key(F.substring("version_id", F.lit(1), bar - 1)).alias("parts"), F.substring("version_id", bar + 1, F.length("version_id")).alias("build"))).alias("top"),
    )
    rows = found.join(held, "version_id", "left").crossJoin(F.broadcast(newest))  # newest is one row
    order = Window.partitionBy(F.col("known").isNull()).orderBy("key", "bundle_name")
    number = F.coalesce("known", F.col("last") + F.row_number().over(order)).cast("long")
    if not allow_old:
        stale = F.col("known").isNull() & F.col("top").isNotNull() & (F.col("key") <= F.col("top"))
        number = F.when(stale, F.raise_error(F.concat(F.lit("older than the newest version: "), F.col("version_id"))).cast("long")).otherwise(number)
    return rows.select(number.alias("version_num"), "version_id", "release", "build", "bundle_name")


def new_versions(batch: DataFrame, existing: DataFrame) -> DataFrame:
    return new_rows(batch, existing, ["version_num", "version_id"])


def new_paths(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Paths that the table lacks; of several rows of an id the greatest path stays."""
    one = batch.groupBy("path_id").agg(F.max("absolute_path").alias("absolute_path"))
    return one.join(existing.select("path_id"), "path_id", "left_anti")
