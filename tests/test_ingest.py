"""Ingest end to end on a small tree; sources; streaming."""

import plistlib
import struct

import pytest

from verdex.operators import presence, search
from verdex.plans.ingest import Options, ingest, ingest_headers
from verdex.plans.pages import view_page
from verdex.sources import catalog, headers
from verdex.sources.catalog import Change, open_catalog, vacuum
from verdex.streaming.ingest import symbol_counts, watch

VIEW = b"@interface V : NSObject {\n    int _a;\n    int _a;\n}\n- (void)go;\n@end\n"


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    """Small tables need few files."""
    monkeypatch.setattr(catalog, "BUCKETS", 8)


@pytest.fixture()
def tree(tmp_path):
    for bundle, version, more in (("19B__x", "15.1", b""), ("19C__x", "15.2", b"@interface W\n- (id)new;\n@end\n")):
        folder = tmp_path / "headers" / bundle / "System" / "UIKit.framework"
        folder.mkdir(parents=True)
        (folder / "V.h").write_bytes(VIEW + more)
        (folder / "bad.h").write_bytes(b"{\n int x;\n")
        (folder / "skip.txt").write_bytes(b"no")
        meta = tmp_path / "files" / bundle
        meta.mkdir(parents=True)
        (meta / "Restore.plist").write_bytes(plistlib.dumps({"ProductVersion": version}))
        if version == "15.2":
            (meta / "SystemVersion.plist").write_bytes(plistlib.dumps({"ProductVersion": version, "ProductBuildVersion": "19C56"}))
        else:
            (meta / "SystemVersion.plist").write_bytes(b"not a plist")
    return tmp_path


def state(c):
    return (
        sorted(map(tuple, c.versions.select("version_num", "version_id", "bundle_name").collect())),
        sorted(map(tuple, c.paths.select("path_id", "absolute_path").collect())),
        sorted(map(tuple, c.file_instances.select("version_num", "path_id", "content_id").collect())),
        sorted(map(tuple, c.symbols.select("version_num", "content_id", "owner_name", "symbol_type", "symbol_key", "line_no").collect())),
        sorted(map(repr, presence.sets(c.symbol_presence).select("path_id", "owner_name", "symbol_key", "versions").collect())),
        sorted(map(tuple, c.contents.select("content_id", "content_hash", "pack_object_key", "pack_offset", "pack_length").collect())),
    )


def test_ingest_is_idempotent(spark, tree):
    out = f"file://{tree}/out"
    counts = ingest(spark, f"{tree}/headers", f"{tree}/files", out)
    assert counts == {"versions": 2, "files": 2, "symbols": 5}
    first = state(open_catalog(spark, out))
    assert first[0] == [(1, "15.1|19B", "19B__x"), (2, "15.2|19C56", "19C__x")]
    assert len(first[1]) == 2  # the skipped file keeps its path
    ingest(spark, f"{tree}/headers", f"{tree}/files", out)
    assert state(open_catalog(spark, out)) == first
    page = view_page(open_catalog(spark, out), "15.2|19c56", "/System/UIKit.framework/V.h")
    row = page.source.first()
    assert row["line_count"] == 8 and row["html"].startswith("@interface V")
    assert search.count_distinct_owners(open_catalog(spark, out)).first()[0] == 2
    assert view_page(open_catalog(spark, out), "15.2|19c56", "/no.h") is None


def test_one_version_at_a_time(spark, tree):
    out = f"file://{tree}/out2"
    ingest(spark, f"{tree}/headers", f"{tree}/files", out, Options(bundles=("19C__x",), skip_upload=True))
    with pytest.raises(Exception, match="older than the newest"):
        ingest(spark, f"{tree}/headers", f"{tree}/files", out, Options(bundles=("19B__x",)))
    ingest(spark, f"{tree}/headers", f"{tree}/files", out, Options(bundles=("19B__x",), allow_old=True))
    assert [r["version_id"] for r in open_catalog(spark, out).versions.orderBy("version_num").collect()] == ["15.2|19C56", "15.1|19B"]
    ingest(spark, f"{tree}/headers", f"{tree}/files", out, Options(bundles=("19B__x",), truncate_all=True))
    assert [r["version_num"] for r in open_catalog(spark, out).versions.collect()] == [1]


def test_metadata(spark, tree):
    with pytest.raises(Exception, match="no readable release metadata"):
        headers.choose_release(headers.read_metadata(headers.metadata_files(spark, f"{tree}/files")), spark.createDataFrame([("none",)], "bundle_name string")).collect()


def test_max_files_after_sorting(spark, tree):
    got = headers.scan(spark, f"{tree}/headers", max_files=1)
    assert {r["relative_path"] for r in got.collect()} == {"System/UIKit.framework/V.h"}


def test_executables(spark):
    thin = bytes.fromhex("cffaedfe") + bytes(8) + struct.pack("<I", 2)
    big = bytes.fromhex("feedface") + bytes(8) + struct.pack(">I", 2)
    library = bytes.fromhex("cffaedfe") + bytes(8) + struct.pack("<I", 6)
    fat = bytes.fromhex("cafebabe") + struct.pack(">I", 2) + struct.pack(">5I", 0, 0, 48, 0, 0) + struct.pack(">5I", 0, 0, 64, 0, 0) + library + thin
    fat64 = bytes.fromhex("bebafeca")
    cases = [(thin, True), (big, True), (library, False), (fat, True), (fat[:40], False), (fat64, False), (b"", False), (b"\xcf\xfa", False), (None, False)]
    frame = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, content binary")
    assert [r["is_executable"] for r in headers.executables(frame).orderBy("i").collect()] == [e for _, e in cases]


def test_tsv(spark, tmp_path):
    headers.write_tsv(spark.createDataFrame([("a\tb", None), ("\\", "x\n")], "a string, b string").coalesce(1), str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == sorted(["a\\tb\t\\N", "\\\\\tx\\n"])


def test_stream(spark, tmp_path):
    drops = spark.createDataFrame([("b1", "1.0", "A", "S/V.h", bytearray(VIEW))], "bundle_name string, release string, build string, relative_path string, content binary")
    drops.write.parquet(str(tmp_path / "drops"))
    out = f"file://{tmp_path}/out"
    watch(spark, str(tmp_path / "drops"), out, str(tmp_path / "ck")).awaitTermination(180)
    c = open_catalog(spark, out)
    assert c.symbols.count() == 2
    running = symbol_counts(spark, f"{out}/symbols").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert {r["symbol_type"]: r["n"] for r in spark.table("counts").collect()} == {"ivar": 1, "instance_method": 1}


def test_a_bundle_in_parts_is_imported_once_it_is_whole(spark, tmp_path):
    """Over three micro-batches, with a restart between them and a batch that comes again."""
    import verdex.streaming.ingest as stream

    out, root, schema = f"file://{tmp_path}/out", tmp_path / "drops", stream.DROPS

    def drop(*rows):
        spark.createDataFrame([(b, "1.0", u, p, bytearray(x), n) for b, u, p, x, n in rows], schema).coalesce(1).write.mode("append").parquet(str(root))

    drop(("b1", "A", "x.h", A, 3), ("b2", "B", "q.h", A, 1))
    watch(spark, str(root), out, str(tmp_path / "ck"), files_a_batch=1).awaitTermination(180)
    assert files_of(spark, out) == [(1, "/q.h", A)]
    drop(("b1", "A", "y.h", A, 3))
    drop(("b1", "A", "y.h", B, 3))
    watch(spark, str(root), out, str(tmp_path / "ck"), files_a_batch=1).awaitTermination(180)
    assert open_catalog(spark, out).versions.count() == 1
    late = spark.createDataFrame([("b1", "1.0", "A", "z.h", bytearray(C), 3)], schema)
    assert stream.receive(late, 7, out, Options(allow_old=True)) == 1
    whole = [(1, "/q.h", A), (2, "/x.h", A), (2, "/z.h", C)]
    assert [f for f in files_of(spark, out) if f[1] != "/y.h"] == whole and (2, "/y.h", B) in files_of(spark, out)
    assert not [p for p in (tmp_path / "out" / "_inbox").rglob("*.parquet")]
    assert stream.receive(late, 7, out, Options(allow_old=True)) == 0  # its other parts are gone with the import
    assert len(files_of(spark, out)) == 4


def test_pack_places(spark):
    """A pack is closed before a body that would make it exceed the target, and after one that fills it."""
    import hashlib

    from verdex.plans.ingest import pack_places

    sizes = {f"k{i:03d}": (0, 500, 900)[i % 3] if i % 11 == 0 else (i * 37) % 90 + 1 for i in range(200)}
    frame = spark.createDataFrame([(1, k, n) for k, n in sizes.items()], "version_num long, blob_key string, byte_size long")
    got = {r["blob_key"]: (r["pack_object_key"], r["pack_offset"], r["pack_length"]) for r in pack_places(frame, shards=3, pack_bytes=500).collect()}
    state = {}
    for key in sorted(sizes):
        shard = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big") % 3
        pack, used = state.get(shard, (1, 0))
        if used and used + sizes[key] > 500:
            pack, used = pack + 1, 0
        assert got[key] == (f"packs/v000001/s{shard:03d}/p{pack:09d}.bin", used, sizes[key])
        used += sizes[key]
        state[shard] = (pack + 1, 0) if used >= 500 else (pack, used)


def drop_of(*files):
    """(bundle, release, build, path, body) rows."""
    return [(b, r, u, p, bytearray(x)) for b, r, u, p, x in files]


def files_of(spark, out):
    c = open_catalog(spark, out)
    rows = c.file_instances.join(c.paths, "path_id").join(c.blobs, ["version_num", "content_id"])
    return sorted((r["version_num"], r["absolute_path"], bytes(r["body"])) for r in rows.collect())


def bring(spark, out, *files, **options):
    frame = spark.createDataFrame(drop_of(*files), "bundle_name string, release string, build string, relative_path string, content binary")
    releases = frame.select("bundle_name", "release", "build").distinct()
    found = frame.selectExpr("bundle_name", "concat('/', relative_path) as absolute_path", "content")
    return ingest_headers(Change(spark, out), found, releases, Options(**options))


A, B, C = (f"@interface {x}\n- (void)go;\n@end\n".encode() for x in "ABC")


def test_another_bundle_of_a_known_version(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    bring(spark, out, ("b1", "1.0", "A", "x.h", A), ("b1", "1.0", "A", "y.h", A))
    assert bring(spark, out, ("b2", "1.0", "A", "z.h", B), ("b2", "1.0", "A", "y.h", B)) == {"versions": 1, "files": 3, "symbols": 3}
    assert files_of(spark, out) == [(1, "/x.h", A), (1, "/y.h", B), (1, "/z.h", B)]
    # The same bundle again replaces its own files only.
    bring(spark, out, ("b1", "1.0", "A", "w.h", C))
    assert files_of(spark, out) == [(1, "/w.h", C), (1, "/y.h", B), (1, "/z.h", B)]
    assert sorted(r["latest_version_num"] for r in open_catalog(spark, out).latest_by_path.collect()) == [1, 1, 1]


def test_a_bundle_that_comes_again_as_a_new_release(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    bring(spark, out, ("b1", "1.0", "A", "x.h", A))
    bring(spark, out, ("b1", "1.1", "B", "x.h", B))
    assert files_of(spark, out) == [(1, "/x.h", A), (2, "/x.h", B)]
    assert owners_of(spark, out) == {"A": [1], "B": [2]}
    # Two bundles of one batch and one known version: the greater name has the path.
    bring(spark, out, ("b3", "1.1", "B", "x.h", C), ("b2", "1.1", "B", "x.h", A))
    assert files_of(spark, out) == [(1, "/x.h", A), (2, "/x.h", C)]
    assert bring(spark, out, ("b3", "1.1", "B", "x.h", A), resume=True) == {"versions": 0, "files": 0, "symbols": 0}
    assert files_of(spark, out) == [(1, "/x.h", A), (2, "/x.h", C)]


def test_a_crash_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/out"
    bring(spark, out, ("b1", "1.0", "A", "x.h", A))
    before = state(open_catalog(spark, out))
    monkeypatch.setattr(Change, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        bring(spark, out, ("b2", "2.0", "A", "x.h", B))
    monkeypatch.undo()
    assert state(open_catalog(spark, out)) == before
    bring(spark, out, ("b2", "2.0", "A", "x.h", B))
    assert [r["version_num"] for r in open_catalog(spark, out).versions.orderBy("version_num").collect()] == [1, 2]
    # Files that the manifest names and that are gone are an error, not an empty table.
    import shutil

    shutil.rmtree(tmp_path / "out" / "versions")
    with pytest.raises(Exception, match="(?i)path"):
        open_catalog(spark, out).versions.collect()


def owners_of(spark, out):
    """{owner: versions} of the stored presence."""
    return {r["owner_name"]: r["versions"] for r in presence.sets(open_catalog(spark, out).symbol_presence).collect()}


def files_under(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_an_import_touches_only_its_parts(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    bring(spark, out, *[("b1", "1.0", "A", f"x{i}.h", A) for i in range(40)])
    first, files = Change(spark, out).next["tables"], files_under(tmp_path / "out")
    bring(spark, out, ("b2", "2.0", "A", "x3.h", B))
    second = Change(spark, out).next["tables"]
    moved = {p for p, g in second["latest_by_path"].items() if first["latest_by_path"].get(p) != g}
    assert len(moved) == 1 and len(second["latest_by_path"]) > 5
    assert {p for p in second["file_instances"] if first["file_instances"].get(p) != second["file_instances"][p]} == {"2"}
    assert second["paths"][""][:1] == first["paths"][""] and len(second["paths"][""]) == 2
    # Presence is written for the import's own versions alone: one symbol.
    fresh = spark.read.parquet(*[f"{tmp_path}/out/{f}" for f in files_under(tmp_path / "out") - files if f.startswith("symbol_presence")])
    assert fresh.count() == 1 and second["symbol_presence"]["1"] == first["symbol_presence"]["1"]
    truth = state(open_catalog(spark, out))
    assert vacuum(spark, out, keep=1) == 0 and vacuum(spark, out, keep=1, older_than_s=0) > 0 and state(open_catalog(spark, out)) == truth
    assert search.presence_map(open_catalog(spark, out), truth[1][0][0]).count() >= 1


def test_an_import_that_comes_again_takes_back(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    bring(spark, out, ("b1", "1.0", "A", "x.h", A), ("b1", "1.0", "A", "y.h", A))
    bring(spark, out, ("b2", "2.0", "A", "x.h", A), ("b2", "2.0", "A", "y.h", B))
    bring(spark, out, ("b1", "1.0", "A", "x.h", C))
    assert owners_of(spark, out) == {"A": [2], "B": [2], "C": [1]}
    assert {(r["path_id"], r["latest_version_num"]) for r in open_catalog(spark, out).latest_by_path.collect()} == {(r["path_id"], 2) for r in open_catalog(spark, out).paths.collect()}
    # The newest version loses a path: its latest falls back to the version before that has it, or it has none.
    bring(spark, out, ("b3", "3.0", "A", "x.h", A), ("b3", "3.0", "A", "z.h", A))
    before = Change(spark, out).next["tables"]["latest_by_path"]
    bring(spark, out, ("b3", "3.0", "A", "y.h", B))
    c = open_catalog(spark, out)
    latest = {r["absolute_path"]: r["latest_version_num"] for r in c.latest_by_path.join(c.paths, "path_id").collect()}
    assert latest == {"/x.h": 2, "/y.h": 3}
    after = Change(spark, out).next["tables"]["latest_by_path"]
    touched = {r["bucket"] for r in c.paths.select(catalog.bucket_of(c.paths["path_id"]).alias("bucket")).distinct().collect()}
    assert {int(p) for p in set(before) | set(after) if before.get(p) != after.get(p)} <= touched
    assert owners_of(spark, out) == {"A": [2], "B": [2, 3], "C": [1]}


def test_presence_folders_are_merged_by_size(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    for n in range(1, 6):
        bring(spark, out, (f"b{n}", f"{n}.0", "A", "x.h", A if n % 2 else B))
    expected = {"A": [1, 3, 5], "B": [2, 4]}
    assert owners_of(spark, out) == expected
    folders = {g for gs in Change(spark, out).next["tables"]["symbol_presence"].values() for g in gs}
    assert len(folders) < 4  # at the fourth import all had become one
    bring(spark, out, ("b3", "3.0", "A", "x.h", C))  # a version that lies in a merged folder
    assert owners_of(spark, out) == {"A": [1, 5], "B": [2, 4], "C": [3]}
    assert presence.compact(spark, out, fan=2) >= 2
    assert owners_of(spark, out) == {"A": [1, 5], "B": [2, 4], "C": [3]}
    vacuum(spark, out, keep=1, older_than_s=0)
    assert owners_of(spark, out) == {"A": [1, 5], "B": [2, 4], "C": [3]}


def test_the_index_of_names_grows_with_imports(spark, tmp_path):
    from verdex.operators import grams

    def held():
        c = open_catalog(spark, out)
        return sorted(map(tuple, c.name_grams.select("gram", "path_id").collect())), sorted(map(tuple, grams.of_catalog(c).collect()))

    out = f"file://{tmp_path}/out"
    bring(spark, out, ("b1", "1.0", "A", "view.h", b"@interface Window\n- (void)go;\n@end\n"))
    assert held()[0] == held()[1] != []
    bring(spark, out, ("b2", "2.0", "A", "view.h", b"@interface Window\n- (void)go;\n@end\n@interface Other\n- (id)x;\n@end\n"), ("b2", "2.0", "A", "n.h", A))
    assert held()[0] == held()[1]  # each posting once: what was there is not written again
    assert [r["absolute_path"] for r in search.search_owner_candidates(open_catalog(spark, out), "the").collect()] == ["/view.h"]
    bring(spark, out, ("b2", "2.0", "A", "n.h", A))  # takes an owner back: found no more, though its postings stay
    assert search.search_owner_candidates(open_catalog(spark, out), "the").collect() == []
    assert set(held()[0]) > set(held()[1])
    assert grams.compact(spark, out, most=3) and not grams.compact(spark, out, most=3)
    grams.rebuild(spark, out)
    assert held()[0] == held()[1]


def test_an_import_resumes_where_it_was_killed(spark, tmp_path, monkeypatch):
    """Units that were finished are not read again, by whom ever; the result is that of one import."""
    from verdex.plans import ingest as module

    out, whole = f"file://{tmp_path}/out", f"file://{tmp_path}/whole"
    drops = [(f"b{n}", f"{n}.0", "A", f"{x}.h", body) for n in (1, 2, 3) for x, body in (("x", A), ("y", B), ("z", C))]
    bring(spark, whole, *drops)
    read = module._read
    units = []

    def killed(found, named):
        if len(units) == 3:
            raise RuntimeError("killed")
        units.append(1)
        return read(found, named)

    monkeypatch.setattr(module, "_read", killed)
    with pytest.raises(RuntimeError, match="killed"):
        bring(spark, out, *drops, resume=True, slices=2)
    assert open_catalog(spark, out).versions.count() == 0
    monkeypatch.setattr(module, "_read", lambda found, named: units.append(1) or read(found, named))
    bring(spark, out, *drops, resume=True, slices=2)
    assert len(units) == 6  # three bundles in two slices, each once
    assert state(open_catalog(spark, out)) == state(open_catalog(spark, whole))
    assert not list((tmp_path / "out" / "_journal").iterdir())
    assert bring(spark, out, *drops, resume=True) == {"versions": 0, "files": 0, "symbols": 0}


def test_two_open_changes(spark, tmp_path):
    """Neither sees or harms the other's files; who commits last puts its change on top, or imports again."""
    out = f"file://{tmp_path}/out"
    bring(spark, out, ("b0", "0.1", "A", "x.h", A))
    one, two = Change(spark, out), Change(spark, out)

    def into(change, *files):
        frame = spark.createDataFrame(drop_of(*files), "bundle_name string, release string, build string, relative_path string, content binary")
        return ingest_headers(change, frame.selectExpr("bundle_name", "concat('/', relative_path) as absolute_path", "content"), frame.select("bundle_name", "release", "build").distinct())

    into(one, ("b1", "1.0", "A", "x.h", B))
    into(two, ("b2", "2.0", "A", "x.h", C), ("b2", "2.0", "A", "n.h", C))
    assert files_of(spark, out) == [(1, "/x.h", A), (2, "/x.h", B), (3, "/n.h", C), (3, "/x.h", C)]
    assert owners_of(spark, out) == {"A": [1], "B": [2], "C": [3]}
    truth = state(open_catalog(spark, out))
    vacuum(spark, out, keep=1, older_than_s=0)
    assert state(open_catalog(spark, out)) == truth
    # Changes of different tables do not disturb each other; of one table, the later fails.
    one, two, three = (Change(spark, out) for _ in range(3))
    one.write("versions", one.before.versions)
    two.write("name_grams", spark.createDataFrame([("abc", 1, 2)], "gram string, path_id long, shelf int"))
    three.write("versions", three.before.versions.limit(0))
    one.commit()
    two.commit()
    with pytest.raises(catalog.Conflict):
        three.commit()
    three.abandon()
    assert state(open_catalog(spark, out)) == truth and open_catalog(spark, out).name_grams.count() == 1


def test_an_import_gives_up_after_its_attempts(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/out"
    bring(spark, out, ("b1", "1.0", "A", "x.h", A))
    before, tries = state(open_catalog(spark, out)), []
    monkeypatch.setattr(Change, "on_top_of", lambda self, held: tries.append(1) or (_ for _ in ()).throw(catalog.Conflict("busy")))
    with pytest.raises(catalog.Conflict):
        bring(spark, out, ("b2", "2.0", "A", "x.h", B), attempts=2)
    monkeypatch.undo()
    assert len(tries) == 2 and state(open_catalog(spark, out)) == before
    left = {p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_") and p.name != "_manifest"}
    assert not left


def test_an_empty_bundle_gets_its_version(spark, tree):
    out = f"file://{tree}/out3"
    (tree / "headers" / "19D__x").mkdir()
    (tree / "files" / "19D__x").mkdir()
    (tree / "files" / "19D__x" / "SystemVersion.plist").write_bytes(plistlib.dumps({"ProductVersion": "15.3"}))
    ingest(spark, f"{tree}/headers", f"{tree}/files", out)
    assert [r["version_id"] for r in open_catalog(spark, out).versions.orderBy("version_num").collect()] == ["15.1|19B", "15.2|19C56", "15.3|19D"]


def test_range_reads(spark):
    objects = spark.createDataFrame([("o", bytearray(b"abcdef"))], "pack_object_key string, body binary")
    refs = spark.createDataFrame([("o", 2, 3), ("o", 0, 0)], "pack_object_key string, pack_offset long, pack_length long")
    assert sorted(bytes(r["body"]) for r in search.read_range(objects, refs).collect()) == [b"", b"cde"]
