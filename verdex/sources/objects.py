"""Objects: files that tasks write whole, and byte ranges of them.

Writing is a data source: rows (key, content) that lie together and in order become one
object a key.  A task writes into a folder of its own attempt and moves its objects to
their places when it has written all, so one that is killed leaves nothing there; what
attempts have left behind goes with the end of the job.  Objects of a job that fails go,
too.  Who writes a key again writes the same bytes: keys of packs tell their content.

Any file system serves that Arrow opens by its address: a mounted folder, HDFS, or an
object store.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "verdex_objects"


def opened(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of an address, and the path on it."""
    if "://" not in root and not root.startswith("file:"):
        return arrow_fs.LocalFileSystem(), root
    if root.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(root)


def parent(path: str) -> str:
    return path.rpartition("/")[0]


@dataclass
class Written(WriterCommitMessage):
    """The keys that a task has put in place."""

    keys: list[str] = field(default_factory=list)


class ObjectWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), f"_objects-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        fs, base = opened(self.root)
        mine = f"{base}/{self.job}/{uuid.uuid4().hex}"
        keys: list[str] = []
        out = None
        try:
            for row in rows:
                if not keys or row["key"] != keys[-1]:
                    if out is not None:
                        out.close()
                    fs.create_dir(mine, recursive=True)
                    out = fs.open_output_stream(f"{mine}/{len(keys)}")
                    keys.append(row["key"])
                out.write(bytes(row["content"] or b""))
        finally:
            if out is not None:
                out.close()
        for n, key in enumerate(keys):
            fs.create_dir(parent(f"{base}/{key}"), recursive=True)
            fs.move(f"{mine}/{n}", f"{base}/{key}")
        return Written(keys)

    def _clean(self) -> None:
        fs, base = opened(self.root)
        if fs.get_file_info(f"{base}/{self.job}").type != arrow_fs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.root)
        for key in (k for m in messages if m is not None for k in m.keys):
            if fs.get_file_info(f"{base}/{key}").type == arrow_fs.FileType.File:
                fs.delete_file(f"{base}/{key}")
        self._clean()


class ObjectSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["path"])


def write_objects(rows: DataFrame, root: str, at: str | None = None) -> None:
    """Write (key, content) rows as objects below ``root``; ``at`` orders the contents of one key, which are joined."""
    rows.sparkSession.dataSource.register(ObjectSink)
    order = ["key", *([at] if at else [])]
    placed = rows.repartition("key").sortWithinPartitions(*order).select("key", "content")
    placed.write.format(FORMAT).option("path", root).mode("append").save()


def read_ranges(refs: DataFrame, root: str, key: str = "pack_object_key", offset: str = "pack_offset", length: str = "pack_length", body: str = "body") -> DataFrame:
    """Add the bytes [offset, offset + length) of each row's object; only these are read.

    An object that is missing or too short is an error.
    """
    schema = T.StructType([*refs.schema.fields, T.StructField(body, T.BinaryType())])
    k, o, n = (refs.columns.index(c) for c in (key, offset, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root.rstrip("/"))
        name, handle = None, None
        try:
            for batch in batches:
                bodies = []
                for here, start, size in zip(*(batch.column(i).to_pylist() for i in (k, o, n)), strict=True):
                    if here != name:
                        if handle is not None:
                            handle.close()
                        name, handle = here, fs.open_input_file(f"{base}/{here}")
                    got = handle.read_at(size, start)
                    if len(got) != size:
                        raise OSError(f"{here} ends before {start + size}")
                    bodies.append(got)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.binary())], names=schema.names)
        finally:
            if handle is not None:
                handle.close()

    return refs.sortWithinPartitions(key, offset).mapInArrow(run, schema)


def sealed(placed: DataFrame) -> DataFrame:
    """Pack keys that tell the pack's content: ``p000000001.bin`` to ``p000000001-<hash of its members>.bin``."""
    members = placed.groupBy("pack_object_key").agg(F.bit_xor(F.xxhash64("blob_key", "content_hash", "pack_offset")).alias("__seal"))
    named = placed.join(members, "pack_object_key")
    seal = F.concat(F.lit("-"), F.substring(F.lower(F.hex("__seal")), -12, 12), F.lit(".bin"))
    return named.withColumn("pack_object_key", F.concat(F.regexp_replace("pack_object_key", r"(-[0-9a-f]+)?\.bin$", ""), seal)).drop("__seal").select(*placed.columns)

