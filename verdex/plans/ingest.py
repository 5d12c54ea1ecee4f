"""Ingest: header trees to catalogue tables, idempotent by version and bundle.

One import is one change of the stored catalogue: headers are read, normalised and
parsed once into staged tables, every table of the catalogue derives from these, and
all become visible together.  A crash before that leaves the catalogue as it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.functions import ids, text
from verdex.functions.paths import with_path_columns
from verdex.operators import grams, parser, presence, versioning
from verdex.operators.lookups import broadcast_if_small, spread
from verdex.schemas import PATHS
from verdex.sources import headers as H
from verdex.sources import objects
from verdex.sources.catalog import Change, Conflict, bucket_of, with_symbol_columns, with_version_columns

SHARDS, PACK_BYTES = 64, 128 << 20


@dataclass(frozen=True)
class Options:
    """``resume`` leaves out bundles whose import into the same version has been finished, and keeps a journal.

    With it a bundle's files are read and parsed in ``slices`` by path, each a unit that is written down for whoever
    imports that bundle next: an import that is killed leaves its finished units, and the next one, with the same
    headers and ``max_files``, reads only the others.  Units go when their import has been committed.

    An import that another writer has overtaken is run again from what that one has left, ``attempts`` times at most.
    """

    bundles: tuple[str, ...] = ()
    max_files: int | None = None
    allow_old: bool = False
    truncate_all: bool = False
    skip_upload: bool = False
    resume: bool = False
    shards: int = SHARDS
    pack_bytes: int = PACK_BYTES
    attempts: int = 5
    slices: int = 1


def normalised(headers: DataFrame) -> DataFrame:
    """Add the collapsed body, its hash and size."""
    rows = spread(headers).withColumn("body", text.collapse_duplicate_lines(F.col("content")))
    return rows.withColumns({"content_hash": text.content_hash(F.col("body")), "byte_size": text.byte_size(F.col("body"))})


def pack_places(contents: DataFrame, shards: int = SHARDS, pack_bytes: int = PACK_BYTES, key: str = "blob_key", within: tuple[str, ...] = ("version_num",), shard: Column | None = None) -> DataFrame:
    """Add pack_object_key, pack_offset and pack_length: where bodies lie that are packed in key order.

    A pack is closed before a body that would make it exceed the target, and after one
    that fills it.  That depends on all bodies before, so sorted narrow rows stream by,
    a shard in a task, with the place of the last one; bodies do not move for it.
    A null size counts as 0; bodies of equal keys are packed in any order.
    """
    rows = contents.withColumn("__shard", ids.shard(F.col(key), shards) if shard is None else shard)
    rows = rows.repartition(*within, "__shard").sortWithinPartitions(*within, "__shard", key)
    made = [T.StructField("__pack", T.LongType()), T.StructField("pack_offset", T.LongType()), T.StructField("pack_length", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *made])
    groups, size = [rows.columns.index(c) for c in (*within, "__shard")], rows.columns.index("byte_size")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pack, used = None, 1, 0
        for batch in batches:
            packs, offsets, lengths = [], [], []
            for here, n in zip(zip(*(batch.column(i).to_pylist() for i in groups)), batch.column(size).to_pylist()):
                n = n or 0
                if here != at:
                    at, pack, used = here, 1, 0
                if used and used + n > pack_bytes:
                    pack, used = pack + 1, 0
                packs.append(pack)
                offsets.append(used)
                lengths.append(n)
                used += n
                if used >= pack_bytes:
                    pack, used = pack + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (packs, offsets, lengths))], names=schema.names)

    placed = rows.mapInArrow(fill, schema)
    name = [F.format_string("s%03d/p%09d", "__shard", "__pack")]
    if "version_num" in within:
        name.insert(0, F.format_string("v%06d", "version_num"))
    if "bundle_name" in within:
        name[-1] = F.concat(name[-1], F.format_string("-%06x", F.xxhash64("bundle_name").bitwiseAND(0xFFFFFF)))
    return placed.withColumn("pack_object_key", F.concat(F.lit("packs/"), F.concat_ws("/", *name), F.lit(".bin"))).drop("__shard", "__pack")


def ingest(spark: SparkSession, headers_root: str, files_root: str, out: str, options: Options = Options()) -> dict[str, int]:
    """Import bundles into the catalogue at ``out``; running it again changes nothing."""
    change = Change(spark, out, fresh=options.truncate_all)
    bundles = H.bundles_of(spark, headers_root, list(options.bundles))
    releases = H.choose_release(H.read_metadata(H.metadata_files(spark, files_root)), bundles)
    found = H.scan(spark, headers_root, list(options.bundles) or None, options.max_files)
    return ingest_headers(change, found, releases, options)


def ingest_headers(change: Change, found: DataFrame, releases: DataFrame, options: Options = Options()) -> dict[str, int]:
    """Import (bundle_name, absolute_path, content) files of (bundle_name, release, build) releases and commit.

    A bundle's files replace those that it had in its version.  Files of other bundles
    in that version stay, but for paths that are imported now.  Of two bundles of one
    import that share a version and a path the greater name counts.
    """
    for left in reversed(range(options.attempts)):
        try:
            counts = _ingest(change, found, releases, options)
            break
        except Conflict:
            change.abandon()
            if not left:
                raise
            change = change.again()
        except BaseException:
            change.abandon()
            raise
    presence.compact(change.spark, change.root)
    grams.compact(change.spark, change.root)
    return counts


def _ingest(change: Change, found: DataFrame, releases: DataFrame, options: Options) -> dict[str, int]:
    held, now = change.before, F.current_timestamp()
    change.rely("versions", "paths")  # numbers and new paths are those of the catalogue as it was
    numbered = change.stage("numbered", versioning.assign_numbers(releases, held.versions.select("version_num", "version_id"), options.allow_old))
    if options.resume and change.next["done"]:
        done = change.spark.createDataFrame(change.next["done"], "bundle_name string, version_id string")
        numbered = numbered.join(F.broadcast(done), ["bundle_name", "version_id"], "left_anti")  # a row a release
    bundles = [(r["bundle_name"], r["version_id"], r["version_num"]) for r in numbered.collect()]  # a row a release
    numbers = sorted({n for *_, n in bundles})
    versions = with_version_columns(versioning.new_versions(numbered, held.versions)).withColumn("created_at", now)
    change.write("versions", held.versions.unionByName(versions.select(*held.versions.columns)).coalesce(1))
    files, declared, units = _staged(change, found, numbered, bundles, options)
    if len(numbers) < len(bundles):
        last = files.groupBy("version_num", "path_id").agg(F.max("bundle_name").alias("bundle_name"))
        files = files.join(change.stage("last", last), ["version_num", "path_id", "bundle_name"], "left_semi")
    fresh = with_path_columns(versioning.new_paths(files.select("path_id", "absolute_path"), held.paths)).withColumn("created_at", now)
    fresh = change.stage("fresh", fresh.select(*PATHS.names))
    change.write("paths", fresh, replace=False)
    key = ["version_num", "path_id", "content_id"]
    if len(numbers) < len(bundles):
        declared = declared.join(files.select("version_num", "path_id", "bundle_name"), ["version_num", "path_id", "bundle_name"], "left_semi")
    declared = declared.drop("bundle_name")
    skipped = declared.where("orphaned").select(*key).distinct()
    good = files.join(broadcast_if_small(skipped), key, "left_anti").withColumn("blob_key", F.concat_ws("/", "version_id", F.substring("absolute_path", 2, 1 << 30)))
    narrow = good.select(*key, "bundle_name", "content_hash", "byte_size", "blob_key")
    if options.skip_upload:
        placed = narrow.withColumns({"pack_object_key": F.col("blob_key"), "pack_offset": F.lit(0).cast("long"), "pack_length": F.col("byte_size")})
    else:
        placed = pack_places(narrow, options.shards, options.pack_bytes, within=("version_num", "bundle_name"))
        placed = objects.sealed(change.stage("places", placed))
    placed = change.stage("placed", placed)
    if not options.skip_upload:
        # Packs are in their places before the manifest names them; a change that dies leaves packs that nobody reads.
        where = placed.select("version_num", "content_id", F.col("pack_object_key").alias("key"), "pack_offset")
        bodies = good.select("version_num", "content_id", F.col("body").alias("content")).join(where, ["version_num", "content_id"])
        objects.write_objects(bodies, change.root, at="pack_offset")
    symbols = with_symbol_columns(declared.where("not orphaned").drop("path_id", "orphaned"))
    made = {
        "contents": placed.select("content_id", "content_hash", "blob_key", "pack_object_key", "pack_offset", "pack_length", "byte_size", now.alias("created_at"), "version_num"),
        "file_instances": placed.select("version_num", "path_id", "content_id", "bundle_name", now.alias("updated_at")),
        "symbols": symbols,
    }
    reopened = sorted(set(numbers) & change.parts("file_instances"))
    if reopened:
        # What other bundles have in these versions, and this import does not bring, is written again beside it.
        mine = change.spark.createDataFrame([(n, b) for b, _, n in bundles], "version_num long, bundle_name string")
        kept = held.file_instances.where(F.col("version_num").isin(reopened)).join(F.broadcast(mine), ["version_num", "bundle_name"], "left_anti")
        kept = change.stage("kept", kept.join(files.select("version_num", "path_id"), ["version_num", "path_id"], "left_anti"))
        for name in made:
            old = kept if name == "file_instances" else getattr(held, name).where(F.col("version_num").isin(reopened)).join(kept.select("version_num", "content_id"), ["version_num", "content_id"], "left_semi")
            made[name] = made[name].unionByName(old.select(*made[name].columns))
    counted = {"file_instances": Observation(), "symbols": Observation()}
    for name, rows in made.items():
        for n in reopened:
            change.drop_part(name, n)
        change.write(name, rows, count=counted.get(name))
    _refresh_latest(change, numbers, reopened)
    presence.refresh(change, numbers)
    grams.refresh(change, numbers, fresh)
    change.commit([[b, v] for b, v, _ in bundles])
    for unit in units:
        change.storage.remove(unit)
    return {"versions": len(numbers), "files": counted["file_instances"].get["n"], "symbols": counted["symbols"].get["n"]}


STAGED = ["bundle_name", "version_id", "path_id", "content_id", "absolute_path", "content_hash", "byte_size", "body"]


def _read(found: DataFrame, named: DataFrame) -> DataFrame:
    """Normalised files with their ids; ``named`` has (bundle_name, version_id)."""
    files = normalised(found.join(broadcast_if_small(named), "bundle_name"))
    return files.withColumns({"path_id": ids.path_id(F.col("absolute_path")), "content_id": ids.content_id(F.col("version_id"), F.col("absolute_path"))}).select(*STAGED)


def _parsed(files: DataFrame) -> DataFrame:
    key = ["bundle_name", "version_id", "path_id", "content_id"]
    return parser.declarations(files.select(*key, text.repair_utf8(F.col("body")).alias("text")), key)


def _staged(change: Change, found: DataFrame, numbered: DataFrame, bundles: list[tuple[str, str, int]], options: Options) -> tuple[DataFrame, DataFrame, list[str]]:
    """Files and declarations of the bundles with their version numbers, read and parsed once; the journal's units among them."""
    named = numbered.select("bundle_name", "version_id")
    number = numbered.select("bundle_name", "version_id", "version_num")
    if not options.resume or not bundles:
        files = change.stage("files", _read(found, named))
        declared, units = change.stage("declared", _parsed(files)), []
    else:
        units = []
        slice_of = F.pmod(F.xxhash64("absolute_path"), F.lit(options.slices))
        for bundle, version_id, _ in bundles:
            name = hashlib.sha256(f"{bundle}\0{version_id}\0{options.max_files}".encode()).hexdigest()[:24]
            for n in range(options.slices):
                unit = f"_journal/{name}-{n}-of-{options.slices}"
                units.append(unit)
                if "_SUCCESS" in change.storage.names(f"{unit}/declared"):
                    continue  # a finished write has this mark
                mine = found.where((F.col("bundle_name") == bundle) & (slice_of == n))
                _read(mine, named).write.mode("overwrite").parquet(f"{change.root}/{unit}/files")
                _parsed(change.spark.read.parquet(f"{change.root}/{unit}/files")).write.mode("overwrite").parquet(f"{change.root}/{unit}/declared")
        files, declared = (change.spark.read.parquet(*[f"{change.root}/{u}/{t}" for u in units]) for t in ("files", "declared"))
    few = broadcast_if_small(number)
    return files.join(few, ["bundle_name", "version_id"]), declared.join(few, ["bundle_name", "version_id"]).drop("version_id"), units


def _refresh_latest(change: Change, numbers: list[int], reopened: list[int]) -> None:
    """Newest version of each path, for the buckets of paths that change alone.

    New versions can only raise it.  A path that a reopened version has lost is looked up
    in the other versions, if that version was its newest; others are not read for it.
    """
    now, before = change.catalog(), change.before
    came = now.file_instances.where(F.col("version_num").isin(numbers)).groupBy("path_id").agg(F.max("version_num").alias("latest_version_num"))
    held = before.latest_by_path.select("path_id", "latest_version_num")
    lost = change.stage("lost", held.where(F.col("latest_version_num").isin(reopened)).join(came, "path_id", "left_anti").select("path_id")) if reopened else None
    made = came
    if lost is not None:
        found = now.file_instances.join(broadcast_if_small(lost), "path_id", "left_semi")
        made = made.unionByName(found.groupBy("path_id").agg(F.max("version_num").alias("latest_version_num")))
    made = change.stage("latest", made.withColumn("bucket", bucket_of(F.col("path_id"))))
    touched = {r["bucket"] for r in made.select("bucket").distinct().collect()}  # at most BUCKETS, as below
    if lost is not None:
        touched |= {r["bucket"] for r in lost.select(bucket_of(F.col("path_id")).alias("bucket")).distinct().collect()}
    parts = touched & change.parts("latest_by_path")
    if parts:
        old = before.stored_latest.where(F.col("bucket").isin(sorted(parts))).select("path_id", "latest_version_num", "bucket")
        if lost is not None:
            old = old.join(broadcast_if_small(lost), "path_id", "left_anti")
        made = made.unionByName(old).groupBy("path_id", "bucket").agg(F.max("latest_version_num").alias("latest_version_num"))
    for part in parts:
        change.drop_part("latest_by_path", part)
    change.write("latest_by_path", made.select("path_id", "latest_version_num", "bucket"))
