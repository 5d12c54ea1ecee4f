"""The catalogue: its tables as DataFrames, and how they lie in storage.

A change of the catalogue writes new files into folders of its own, beside the old
ones: ``<table>/g=<folder>/...``, a name that no other change has.  What belongs to the
catalogue is said by the newest manifest, a small JSON file: for each table the folders
of each of its parts.  A change becomes visible by putting the next manifest in place,
which only one of several writers can do.  The others look at what has been committed
meanwhile: if it left alone what they have read and replaced, they put their own
changes on top of it and try again, else they fail and nothing of theirs is ever seen.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from verdex import schemas
from verdex.functions.paths import with_path_columns
from verdex.sources import objects

SCHEMAS = {
    "versions": schemas.VERSIONS,
    "paths": schemas.PATHS,
    "contents": schemas.CONTENTS,
    "file_instances": schemas.FILE_INSTANCES,
    "symbols": schemas.SYMBOLS,
    "symbol_presence": schemas.SYMBOL_PRESENCE,
    "latest_by_path": schemas.LATEST_BY_PATH,
    "name_grams": schemas.NAME_GRAMS,
}
#: What the parts of a table are: a version's rows, or the rows of a bucket of paths.
#: A change replaces the parts that it writes; tables without parts grow by folders.
PARTS = {"contents": "version_num", "file_instances": "version_num", "symbols": "version_num", "latest_by_path": "bucket"}
#: A part of presence is what a version has in one folder: its files hold many versions as bits.
OWNED = "symbol_presence"
#: How the files of a folder are dealt to subfolders.
DEALT = PARTS | {"paths": "bucket", "symbol_presence": "bucket", "name_grams": "shelf"}
SORTED = {
    "versions": ["version_num"], "paths": ["dir_name", "absolute_path"], "contents": ["content_id"], "file_instances": ["path_id"], "symbols": ["content_id", "symbol_type", "symbol_key"],
    "symbol_presence": ["path_id", "symbol_type", "symbol_key"], "latest_by_path": ["path_id"], "name_grams": ["gram", "path_id"],
}
BLOOMS = {"paths": ["absolute_path", "path_id"], "contents": ["content_id"], "symbols": ["content_id"], "symbol_presence": ["owner_name_lc"]}
BUCKETS = 64
#: Where the only part of a table without parts stands in a manifest.
WHOLE = ""


def bucket_of(path_id: Column) -> Column:
    return F.pmod(F.xxhash64(path_id.cast("long")), F.lit(BUCKETS)).cast("int")


def shelf_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class Conflict(RuntimeError):
    """Another change has been committed that touches what this one has read or replaced."""


class Catalog:
    """Six base tables, and what derives from them; each is a DataFrame or makes one when it is first asked for.

    Keys are unique: version_num in versions, path_id in paths, content_id of a version in contents.
    ``symbol_presence`` has (key, word, bits) rows, of which several may have one key and word.
    ``name_grams`` is the index of names, where there is one.  ``objects`` is the folder of the packs that contents
    lie in; ``blobs`` are the bodies of all contents, which a catalogue without packs has as a table.
    """

    TABLES = ("versions", "paths", "contents", "file_instances", "symbols", "symbol_presence", "blobs", "stored_latest", "name_grams")

    def __init__(self, *tables: DataFrame | Callable[[], DataFrame] | None, objects: str | None = None, **named: DataFrame | Callable[[], DataFrame] | None):
        self.objects = objects
        self._given = dict.fromkeys(self.TABLES) | dict(zip(self.TABLES, tables, strict=False)) | named

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in Catalog.TABLES:
            raise AttributeError(name)
        table = self._given[name]
        if table is not None and not isinstance(table, DataFrame):
            table = self._given[name] = table()
        return table

    @property
    def latest_by_path(self) -> DataFrame:
        if self.stored_latest is not None:
            return self.stored_latest
        return self.file_instances.groupBy("path_id").agg(F.max("version_num").alias("latest_version_num"))


def with_version_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("version_id_lc", F.lower("version_id"))


def with_symbol_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("owner_name_lc", F.lower("owner_name"))


class Storage:
    """A folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def names(self, path: str) -> list[str]:
        """Sorted names of what lies in a folder; none where it is missing."""
        at = self.at(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def folders(self, path: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(path)) if s.isDirectory())

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Write a new file whole or not at all; of several that try one succeeds, the others get FileExistsError."""
        if self.fs.exists(self.at(path)):
            raise FileExistsError(path)
        aside = f"_aside-{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(aside))
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        self.fs.mkdirs(self.at(path).getParent())
        place = self.fs.makeQualified(self.at(path)).toUri()
        if place.getScheme() == "file":  # a rename would replace a file here, a link does not
            try:
                os.link(self.fs.makeQualified(self.at(aside)).toUri().getPath(), place.getPath())
            finally:
                self.remove(aside)
            return
        jvm = self.spark._jvm
        none = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = none
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(path).toUri(), self.spark._jsc.hadoopConfiguration()).rename(self.at(aside), self.at(path), options)
        except Exception as e:
            self.remove(aside)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(path) from e
            raise

    def size(self, path: str) -> int:
        """Bytes of all files below."""
        return self.fs.getContentSummary(self.at(path)).getLength()

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        return time.time() - self.fs.getFileStatus(self.at(path)).getModificationTime() / 1000

    def remove(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def manifest_names(storage: Storage) -> list[str]:
    return [n for n in storage.names("_manifest") if n.endswith(".json") and n[:-5].isdigit()]


def manifest(storage: Storage) -> dict:
    """The newest manifest: per table and part its folders; what versions each presence folder has bits of; bundles that are done."""
    names = manifest_names(storage)
    return json.loads(storage.read(f"_manifest/{names[-1]}")) if names else {"number": 0, "tables": {}, "covers": {}, "done": []}


def owned_only(rows: DataFrame, parts: dict[str, list[str]], covers: dict[str, list[int]]) -> DataFrame:
    """Presence rows with the bits of those versions alone that their folder still owns."""
    owned: dict[str, set[int]] = {}
    for version, folders in parts.items():
        for g in folders:
            owned.setdefault(g, set()).add(int(version))
    masks = []
    for g, held in sorted(owned.items()):
        if held >= set(covers[g]):
            continue
        for word in sorted({v >> 6 for v in covers[g]}):
            bits = sum(1 << (v & 63) for v in held if v >> 6 == word)
            masks += [F.lit(f"{g}/{word}"), F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")]
    if not masks:
        return rows
    mask = F.try_element_at(F.create_map(*masks), F.concat_ws("/", "g", F.col("word").cast("string")))
    return rows.withColumn("bits", F.col("bits").bitwiseAND(F.coalesce(mask, F.lit(-1).cast("long")))).where("bits <> 0")


def read_table(spark: SparkSession, root: str, name: str, held: dict) -> DataFrame:
    """One table of a manifest; a table that the manifest does not know is empty, missing files are an error."""
    schema, dealt = SCHEMAS[name], DEALT.get(name)
    if dealt and dealt not in schema.names:
        schema = schemas.StructType([*schema.fields, schemas.StructField(dealt, schemas.LongType() if dealt == "version_num" else schemas.IntegerType())])
    parts = held["tables"].get(name)
    if not parts:
        return spark.createDataFrame([], schema)
    if name in PARTS:
        places = [f"{root}/{name}/g={g}/{dealt}={p}" for p, folders in sorted(parts.items()) for g in folders]
    else:
        places = [f"{root}/{name}/g={g}" for g in dict.fromkeys(g for folders in parts.values() for g in folders)]
    with_folder = schemas.StructType([*schema.fields, schemas.StructField("g", schemas.StringType())])
    rows = spark.read.schema(with_folder).option("basePath", f"{root}/{name}").parquet(*places)
    return (owned_only(rows, parts, held["covers"]) if name == OWNED else rows).drop("g")


def catalog_of(spark: SparkSession, root: str, held: dict) -> Catalog:
    root = root.rstrip("/")

    def table(name: str) -> Callable[[], DataFrame]:
        return lambda: read_table(spark, root, name, held)

    def packed() -> DataFrame:
        return objects.read_ranges(in_packs(c.contents).select("version_num", "content_id", "pack_object_key", "pack_offset", "pack_length"), root)

    made = {n: table("latest_by_path" if n == "stored_latest" else n) for n in Catalog.TABLES} | {"blobs": packed}
    if not held["tables"].get("latest_by_path"):
        made["stored_latest"] = None
    if not held["tables"].get("name_grams"):
        made["name_grams"] = None
    c = Catalog(**made, objects=root)
    return c


def in_packs(contents: DataFrame) -> DataFrame:
    """Contents whose bodies have been stored."""
    return contents.where(F.col("pack_object_key").startswith("packs/"))


def open_catalog(spark: SparkSession, root: str) -> Catalog:
    """The stored catalogue as its newest manifest has it; empty where there is none yet."""
    return catalog_of(spark, root, manifest(Storage(spark, root)))


class Change:
    """A change of a stored catalogue; nothing of it is seen before ``commit``.

    ``fresh`` starts from an empty catalogue, whose old parts all go with the commit.
    """

    def __init__(self, spark: SparkSession, root: str, fresh: bool = False):
        self.spark, self.root, self.fresh = spark, root.rstrip("/"), fresh
        self.storage = Storage(spark, root)
        self.base = manifest(self.storage)
        self.folder = f"{self.base['number'] + 1:09d}-{uuid.uuid4().hex[:12]}"
        self.aside = f"_stage-{self.folder}"
        self.next = json.loads(json.dumps(self.base))
        #: (table, part): the folders that stood there when this change replaced or dropped them.
        self.replaced: dict[tuple[str, str], list[str]] = {}
        self.added: set[tuple[str, str]] = set()
        self.relied: set[str] = set()
        self.written: set[str] = set()
        if fresh:
            for name, parts in self.base["tables"].items():
                for part in parts:
                    self._take(name, part)
            self.next["done"] = []
        self.before = self.catalog()

    def again(self) -> Change:
        """The same kind of change from the catalogue of now."""
        return Change(self.spark, self.root, self.fresh)

    def catalog(self) -> Catalog:
        """The catalogue with what has been written so far."""
        return catalog_of(self.spark, self.root, json.loads(json.dumps(self.next)))

    def read(self, name: str, parts: dict[str, list[str]]) -> DataFrame:
        """Some parts of a table as they are now."""
        return read_table(self.spark, self.root, name, json.loads(json.dumps(self.next | {"tables": {name: parts}})))

    def parts(self, name: str) -> set[int]:
        return {int(p) for p in self.next["tables"].get(name, {}) if p != WHOLE}

    def rely(self, *names: str) -> None:
        """The change is only right if no other one touches these tables meanwhile."""
        self.relied |= set(names)

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Write rows down for the time of the change."""
        path = f"{self.root}/{self.aside}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _take(self, name: str, part: str) -> None:
        """Empty a part."""
        if self.folder not in self.next["tables"].get(name, {}).pop(part, []):
            self.replaced.setdefault((name, part), self.base["tables"].get(name, {}).get(part, []))
        self.added.discard((name, part))

    def _add(self, name: str, part: str) -> None:
        folders = self.next["tables"].setdefault(name, {}).setdefault(part, [])
        if self.folder not in folders:
            folders.append(self.folder)
        self.added.add((name, part))

    def write(self, name: str, df: DataFrame, replace: bool = True, count: Observation | None = None, versions: list[int] | None = None) -> None:
        """Write a table, or those of its parts that ``df`` holds; ``replace`` false adds rows to a table without parts.

        Presence takes the ``versions`` that its rows have bits of: they are owned by this folder from now on, and what
        other folders have of them counts no more.  ``count`` observes the number of rows as ``n``.
        """
        dealt, place = DEALT.get(name), f"{name}/g={self.folder}"
        if dealt in ("bucket", "shelf") and dealt not in df.columns:
            df = df.withColumn(dealt, bucket_of(F.col("path_id")) if dealt == "bucket" else shelf_of(F.col("gram")))
        if dealt:
            # Ranges of the key by part: files of one part have ranges of their own, and no part is one task's alone.
            df = df.repartitionByRange(F.col(dealt), F.col(SORTED[name][0])).sortWithinPartitions(dealt, *SORTED[name])
        else:
            df = df.sortWithinPartitions(*SORTED[name])
        if count is not None:
            df = df.observe(count, F.count(F.lit(1)).alias("n"))
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        for column in BLOOMS.get(name, []):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        (writer.partitionBy(dealt) if dealt else writer).parquet(f"{self.root}/{place}")
        self.written.add(name)
        if name == OWNED:
            made = [str(v) for v in versions]
            self.next["covers"][self.folder] = sorted(versions)
        elif name in PARTS:
            made = [n.partition("=")[2] for n in self.storage.names(place) if n.startswith(f"{dealt}=")]
        else:
            made = [WHOLE]
        for part in made:
            if replace:
                self._take(name, part)
            self._add(name, part)

    def drop_part(self, name: str, part: int) -> None:
        """Leave a part out from now on."""
        if str(part) in self.next["tables"].get(name, {}):
            self._take(name, str(part))

    def on_top_of(self, held: dict) -> dict:
        """The manifest of a catalogue with this change; a conflict if that has moved what the change rests on."""
        for name in self.relied:
            if held["tables"].get(name, {}) != self.base["tables"].get(name, {}):
                raise Conflict(f"{name} has been changed meanwhile")
        out = json.loads(json.dumps(held))
        for (name, part), before in self.replaced.items():
            if held["tables"].get(name, {}).get(part, []) != before:
                raise Conflict(f"{name} {part} has been changed meanwhile")
            out["tables"].get(name, {}).pop(part, None)
        for name, part in sorted(self.added):
            out["tables"].setdefault(name, {}).setdefault(part, []).append(self.folder)
        out["tables"] = {name: parts for name, parts in out["tables"].items() if parts}
        living = {g for folders in out["tables"].get(OWNED, {}).values() for g in folders}
        out["covers"] = {g: v for g, v in (out["covers"] | self.next["covers"]).items() if g in living}
        if self.fresh:
            out["done"] = []
        return out

    def commit(self, done: list[list[str]] = ()) -> None:
        """Make the change visible, on top of what has been committed meanwhile."""
        while True:
            held = manifest(self.storage)
            out = self.on_top_of(held) | {"number": held["number"] + 1}
            out["done"] = sorted(map(list, {*map(tuple, out["done"]), *map(tuple, done)}))
            try:
                self.storage.put(f"_manifest/{out['number']:09d}.json", json.dumps(out))
            except FileExistsError:
                continue
            self.storage.remove(self.aside)
            return

    def abandon(self) -> None:
        """Remove all that the change has written."""
        self.storage.remove(self.aside)
        for name in self.written:
            self.storage.remove(f"{name}/g={self.folder}")


def truncate(spark: SparkSession, root: str) -> None:
    """Empty all tables."""
    Change(spark, root, fresh=True).commit()


def vacuum(spark: SparkSession, root: str, keep: int = 2, older_than_s: float = 86_400.0) -> int:
    """Remove files that none of the newest ``keep`` manifests names; returns how many folders went.

    Folders that have been touched within ``older_than_s`` seconds may be those of an open change and stay, also
    what changes that died have staged.
    """
    storage = Storage(spark, root)
    names = manifest_names(storage)
    used: set[tuple[str, str]] = set()
    for n in names[-keep:]:
        for table, parts in json.loads(storage.read(f"_manifest/{n}"))["tables"].items():
            used |= {(table, f"g={g}/{PARTS[table]}={p}" if table in PARTS else f"g={g}") for p, folders in parts.items() for g in folders}
    gone = 0

    def remove(path: str) -> int:
        if storage.age(path) < older_than_s:
            return 0
        storage.remove(path)
        return 1

    for table in SCHEMAS:
        for g in storage.names(table):
            inner = [f"{g}/{p}" for p in storage.names(f"{table}/{g}") if p.startswith(f"{PARTS[table]}=")] if table in PARTS else [g]
            old = [p for p in inner if (table, p) not in used]
            for p in [g] if table in PARTS and len(old) == len(inner) else old:
                gone += remove(f"{table}/{p}")
    for n in storage.names(""):
        if n.startswith(("_stage-", "_aside-")):
            gone += remove(n)
    for n in names[:-keep]:
        storage.remove(f"_manifest/{n}")
    return gone


def prepared_paths(df: DataFrame) -> DataFrame:
    return with_path_columns(df)
