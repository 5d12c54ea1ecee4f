"""Pack objects: what is on disk, what failing tasks leave, range reads."""

import pytest
from pyspark.sql import functions as F

from verdex.operators import search
from verdex.plans.ingest import Options, ingest_headers
from verdex.sources import objects
from verdex.sources.catalog import Change, open_catalog


def files_of(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_objects_are_their_contents_in_order(spark, tmp_path):
    rows = [(f"a/{k}.bin", n, bytearray(f"{k}:{n};".encode())) for k in range(7) for n in range(50)] + [("empty", 0, None)]
    objects.write_objects(spark.createDataFrame(rows, "key string, n int, content binary").repartition(5), f"file://{tmp_path}/o", at="n")
    expected = {f"a/{k}.bin": "".join(f"{k}:{n};" for n in range(50)).encode() for k in range(7)} | {"empty": b""}
    assert files_of(tmp_path / "o") == expected
    refs = spark.createDataFrame([("a/3.bin", 4, 8, 1), ("a/3.bin", 0, 0, 2), ("a/5.bin", 0, 4, 3)], "pack_object_key string, pack_offset long, pack_length long, i int")
    assert {r["i"]: bytes(r["body"]) for r in objects.read_ranges(refs, f"{tmp_path}/o").collect()} == {1: b"3:1;3:2;", 2: b"", 3: b"5:0;"}
    for bad in (("a/3.bin", 200, 100, 1), ("none", 0, 1, 1)):
        with pytest.raises(Exception, match="ends before|No such file"):
            objects.read_ranges(spark.createDataFrame([bad], refs.schema), f"{tmp_path}/o").collect()
    objects.write_objects(spark.createDataFrame([], "key string, content binary"), f"{tmp_path}/none")
    assert files_of(tmp_path) and not files_of(tmp_path / "none")


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") == 39, F.raise_error(F.lit("killed"))).otherwise(F.lit("body")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="killed"):
        objects.write_objects(rows, f"{tmp_path}/o")
    assert not files_of(tmp_path)


def test_a_task_that_dies_puts_nothing_in_place(tmp_path):
    writer = objects.ObjectWriter(str(tmp_path / "o"))

    def rows():
        yield {"key": "one", "content": b"1"}
        yield {"key": "two", "content": b"2"}
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(rows())
    assert all(name.startswith(writer.job) for name in files_of(tmp_path / "o"))
    done = writer.write(iter([{"key": "d/one", "content": b"1"}]))
    assert files_of(tmp_path / "o")["d/one"] == b"1"
    writer.abort([done, None])
    assert not files_of(tmp_path / "o")


def test_packs_of_an_import(spark, tmp_path):
    """Bodies lie on disk where contents say; the same import again writes the same packs; other contents other ones."""
    out = f"file://{tmp_path}/c"
    body = "@interface X{}\n- (void)go;\n@end\n"

    def bring(*names, **options):
        rows = [("b1", f"/{n}.h", bytearray(body.format(n).encode())) for n in names]
        found = spark.createDataFrame(rows, "bundle_name string, absolute_path string, content binary")
        ingest_headers(Change(spark, out), found, spark.createDataFrame([("b1", "1.0", "A")], "bundle_name string, release string, build string"), Options(shards=3, pack_bytes=100, **options))

    names = [f"n{i}" for i in range(30)]
    bring(*names)
    packs = {k: v for k, v in files_of(tmp_path / "c").items() if k.startswith("packs/")}
    c = open_catalog(spark, out)
    places = c.contents.join(c.file_instances, ["version_num", "content_id"]).join(c.paths, "path_id").collect()
    assert len(places) == 30 and {r["pack_object_key"] for r in places} == set(packs)
    for r in places:
        assert packs[r["pack_object_key"]][r["pack_offset"] : r["pack_offset"] + r["pack_length"]].decode() == body.format(r["file_name"][:-2])
    assert sum(map(len, packs.values())) == sum(r["pack_length"] for r in places) and all(len(p) <= 100 for p in packs.values())
    one = places[7]
    assert bytes(search.read_blob(c, 1, one["content_id"]).first()["body"]).decode() == body.format(one["file_name"][:-2])
    assert c.blobs.count() == 30
    bring(*names)
    assert {k: v for k, v in files_of(tmp_path / "c").items() if k.startswith("packs/")} == packs
    bring(*names[:5])
    assert set(packs) < {k for k in files_of(tmp_path / "c") if k.startswith("packs/")}
    assert open_catalog(spark, out).blobs.count() == 5
    bring("other", skip_upload=True)
    assert search.read_blob(open_catalog(spark, out), 1, open_catalog(spark, out).contents.first()["content_id"]).count() == 0
