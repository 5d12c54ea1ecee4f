"""Hand fixtures: paths, versions, search, paging, presence."""

import pytest

from verdex.functions.paths import with_path_columns
from verdex.operators import lookups, presence, search, versioning, view
from verdex.plans.pages import run_search, search_page
from verdex.sources.catalog import Catalog, with_symbol_columns, with_version_columns

VERSIONS = [(1, "15.1|19B74"), (2, "15.2|19C56"), (3, "16.0|20A362")]
PATHS = [(1, "/S/Frameworks/UIKit.framework/UIView.h"), (2, "/S/Frameworks/UIKit.framework/UIWindow.h"), (3, "/T/UIKit.framework/UIViewX.h"), (4, "/root.h"), (5, "/S/orphan/never.h")]
IN = [(1, 1), (2, 1), (3, 1), (2, 2), (3, 2), (1, 3), (3, 4)]


@pytest.fixture(scope="module")
def c(spark):
    versions = with_version_columns(spark.createDataFrame([(n, i, f"b{n}") for n, i in VERSIONS], "version_num long, version_id string, bundle_name string"))
    paths = with_path_columns(spark.createDataFrame(PATHS, "path_id long, absolute_path string"))
    instances = spark.createDataFrame([(v, p, v * 100 + p) for v, p in IN], "version_num long, path_id long, content_id long")
    contents = spark.createDataFrame([(v * 100 + p, "k", 0, 10 * p) for v, p in IN if p != 4], "content_id long, pack_object_key string, pack_offset long, pack_length long")
    rows = [(101, "interface", "UIView", "property", "k1", 3), (201, "category", "UIView", "property", "k1", 3), (301, "interface", "UIView", "ivar", "k2", 4), (103, "protocol", "Other", "ivar", "x", 1)]
    symbols = with_symbol_columns(spark.createDataFrame(rows, "content_id long, owner_kind string, owner_name string, symbol_type string, symbol_key string, line_no long"))
    made = Catalog(versions, paths, contents, instances, symbols, None)
    made.symbol_presence = presence.build(made)
    return made


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_directories(c):
    assert rows(search.search_directories(c, "uik")) == [("UIKit.framework", "/S/Frameworks/UIKit.framework")]
    assert rows(search.count_distinct_directories(c)) == [(3,)]
    assert rows(search.count_paths_in_directory(c, "UIKit.framework")) == [(3,)]


def test_latest(c):
    assert rows(search.latest_version(c)) == [(3, "16.0|20A362")]
    assert rows(search.latest_for_path(c, PATHS[2][1])) == [(1, "15.1|19B74", 3, PATHS[2][1])]
    assert rows(search.latest_for_path(c, PATHS[4][1])) == []
    assert rows(search.version_num_by_id(c, "15.2|19c56")) == [(2,)]


def test_empty_catalogue(c):
    empty = Catalog(*(t.limit(0) for t in (c.versions, c.paths, c.contents, c.file_instances, c.symbols, c.symbol_presence)))
    assert rows(search.latest_version(empty)) == []
    assert rows(search.search_owner_candidates(empty, "x")) == []
    page = rows(search.files_page(empty, 1, "d", 10))
    assert len(page) == 1 and page[0][4] is None and not page[0][6] and not page[0][7]


def test_file_name_search(c):
    hits = rows(search.search_owner_candidates(c, "uiview.h"))
    assert [(h[0], h[3]) for h in hits] == [(0, 1)]
    hits = rows(search.search_owner_candidates(c, "UIView"))
    # The owner match ranks path 1 first; path 3 matches by file name only.
    assert [(h[0], h[1], h[3]) for h in hits] == [(1, 3, 1), (10, 1, 3)]
    assert run_search(c, "  ") is None


def test_wildcards_are_literal(c):
    assert rows(search.search_owner_candidates(c, "%")) == []
    assert rows(search.search_owner_candidates(c, "_")) == []


def test_unknown_version_hides_a_path(c):
    fewer = Catalog(c.versions.where("version_num < 3"), c.paths, c.contents, c.file_instances, c.symbols, c.symbol_presence)
    assert [h[3] for h in rows(search.search_owner_candidates(fewer, "uiview"))] == [3]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_pages_cover_all_rows_once_each_way(c, size):
    expected = [r[3] for r in rows(search.files_in_directory(c, 3, "UIKit.framework"))]
    seen, cursor = [], None
    while True:
        page = rows(search.files_page(c, 3, "UIKit.framework", size, cursor))
        seen += [r[4] for r in page if r[4]]
        assert page[0][6] == bool(cursor)
        cursor = page[0][9]
        if not cursor:
            break
    assert seen == expected
    back, cursor = [], "~"
    while cursor:
        page = rows(search.files_page(c, 3, "UIKit.framework", size, cursor, "prev"))
        back = [r[4] for r in page if r[4]] + back
        cursor = page[0][8]
    assert back == expected


def test_missing_content_has_no_size(c):
    assert rows(search.files_in_directory(c, 3, ""))[0][4] is None


def sets_of(table):
    return {r[:5]: r[5] for r in rows(presence.sets(table))}


def test_presence(c):
    table = sets_of(c.symbol_presence)
    assert table[(1, "interface", "UIView", "property", "k1")] == [1] and table[(1, "category", "UIView", "property", "k1")] == [2]
    assert {tuple(r[:3]): r[3] for r in rows(search.presence_map(c, 1))} == {("UIView", "property", "k1"): [1, 2], ("UIView", "ivar", "k2"): [3]}
    again = presence.merge(c.symbol_presence, presence.build(c, c.versions.where("version_num = 2").select("version_num")))
    assert sets_of(again) == table
    assert rows(presence.row_count(c.symbol_presence)) == [(4,)]


@pytest.mark.parametrize("top", [3, 10, 63, 64, 128, 5000])
def test_bitmaps_are_sets(spark, top):
    """Union, greatest member, membership and sorted array, by one path at any number of versions."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(top)
    held = {(k, v) for k in range(30) for v in rng.sample(range(1, top + 1), min(top, rng.randint(1, 40)))} | {(0, top), (0, 1), (0, min(top, 63)), (0, min(top, 64))}
    instances = spark.createDataFrame([(v, 1, v * 100) for v in {v for _, v in held}], "version_num long, path_id long, content_id long")
    symbols = spark.createDataFrame([(v * 100, "interface", "A", "ivar", str(k), 1) for k, v in held] * 2, "content_id long, owner_kind string, owner_name string, symbol_type string, symbol_key string, line_no long")
    none = spark.createDataFrame([], "x int")
    c = Catalog(none, none, none, instances, symbols, none)
    expected = {str(k): sorted(v for j, v in held if j == k) for k in range(30)}

    def by_key(table):
        return {r["symbol_key"]: r["versions"] for r in presence.sets(table).collect()}

    whole = presence.build(c)
    assert by_key(whole) == expected
    low, high = (presence.build(c, spark.range(a, b).withColumnRenamed("id", "version_num")) for a, b in ((0, top // 2 + 2), (top // 3, top + 1)))
    assert by_key(presence.merge(low, high)) == expected
    # Rows of several parts are one set without a merge, too.
    assert by_key(low.unionByName(high)) == expected
    assert {r["symbol_key"]: r["v"] for r in whole.groupBy("symbol_key").agg(F.max(presence.greatest()).alias("v")).collect()} == {k: v[-1] for k, v in expected.items()}
    some = expected["0"][len(expected["0"]) // 2]
    assert {r["symbol_key"] for r in whole.where(presence.has(some)).collect()} == {k for k, v in expected.items() if some in v}
    assert whole.count() == sum(len({v >> 6 for v in vs}) for vs in expected.values())


def test_version_numbers(spark):
    found = spark.createDataFrame([("15.2.1", "19C63", "d"), ("9.3", "13E233", "a"), ("15.b", "X", "b"), ("15.2", "19C56", "c")], "release string, build string, bundle_name string")
    none = spark.createDataFrame([], "version_num long, version_id string")
    assert sorted(rows(versioning.assign_numbers(found, none).select("version_num", "release"))) == [(1, "9.3"), (2, "15.b"), (3, "15.2"), (4, "15.2.1")]
    held = spark.createDataFrame([(1, "15.2|19C56")], "version_num long, version_id string")
    newer = found.where("release in ('15.2', '15.2.1')")
    assert sorted(rows(versioning.assign_numbers(newer, held).select("version_num", "release"))) == [(1, "15.2"), (2, "15.2.1")]
    with pytest.raises(Exception, match="older than the newest"):
        versioning.assign_numbers(found, held).collect()
    assert sorted(r[0] for r in rows(versioning.assign_numbers(found, held, allow_old=True).select("version_num"))) == [1, 2, 3, 4]


def test_tables_are_made_when_asked_for():
    made = []

    def table(name):
        return lambda: made.append(name) or name

    class Whole(Catalog):
        pass

    c = Whole(versions=table("v"), paths=table("p"))
    assert c.paths == "p" and made == ["p"]
    with pytest.raises(AttributeError):
        c.nothing


def test_lookup_never_multiplies(spark):
    facts = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "k long, v string")
    assert sorted(rows(lookups.inner(facts, dim, "k", ["v"]))) == [(1, "b"), (1, "b")]
    assert lookups.left(facts, dim, "k", ["v"]).count() == 4


def test_matrix_and_lines(c):
    matrix = rows(view.availability_matrix(c, 1, 101))
    assert [(r[2], r[4], r[6]) for r in matrix] == [("k1", 3, False), ("k1", 2, True), ("k1", 1, True)]
    lines = view.line_versions(view.symbols_with_versions(c, 1, 101))
    assert rows(lines) == [(3, [1, 2])]
    assert rows(view.line_labels(lines, c.versions)) == [(3, ["15.2", "15.1"])]


def test_import_links(spark, c):
    text = '#import "UIWindow.h"\n#import <X/UIWindow.h>\n#import "Gone.h"\nint a<b;'
    files = spark.createDataFrame([(v, i, PATHS[0][1], text) for v, i in VERSIONS[:2]], "version_num long, version_id string, absolute_path string, text string")
    present = c.file_instances.join(c.paths, "path_id")
    got = {(r["version_num"], r["line_no"]): r["linked"] for r in view.resolve_imports(files, present).collect()}
    assert got == {(2, 1): True, (2, 2): True, (2, 3): False, (1, 1): False, (1, 2): False, (1, 3): False}
    html = {r["version_num"]: r["html"] for r in view.render(files, present).collect()}
    link = '<a href="/v/15.2_19C56/S/Frameworks/UIKit.framework/UIWindow.h">'
    assert html[2].split("\n")[0] == f"#import &quot;{link}UIWindow.h</a>&quot;" and html[2].endswith("int a&lt;b;") and link not in html[1]


def test_search_page(c):
    page = search_page(c, directory="UIKit.framework", page_size=1)
    assert rows(page.n_paths) == [(3,)]
    entry = page.entries.first()
    assert (entry["file_name"], entry["framework_name"], entry["path_depth"], entry["version_ids"]) == ("UIView.h", "UIKit", 4, ["16.0|20A362", "15.2|19C56", "15.1|19B74"])
    page = search_page(c, keyword="uiview")
    assert {r["path_id"]: len(r["version_ids"]) for r in page.owner_versions.collect()} == {1: 3, 3: 1}


def test_plans(spark, c, small):
    from verdex.plans import testviews

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    ranked = plan(search.search_owner_candidates(testviews.catalog(spark, small), "brand#1"))
    assert "WindowGroupLimit" in ranked and "TakeOrderedAndProject" in ranked
    assert "CartesianProduct" not in ranked
    listing = plan(search.search_directories(testviews.catalog(spark, small), "b"))
    assert "TakeOrderedAndProject" in listing and listing.count("Exchange") == 1


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A stored catalogue whose tables no plan would broadcast."""
    from pyspark.sql import functions as F

    from verdex.sources.catalog import Change, open_catalog

    out = f"file://{tmp_path_factory.mktemp('wide')}/c"
    change, n = Change(spark, out), 600_000
    ids = spark.range(n).select(F.xxhash64("id").alias("path_id"), F.concat(F.lit("/S/some/long/directory/of/many/F"), F.col("id") % 97, F.lit(".framework/File"), "id", F.lit(".h")).alias("absolute_path"))
    change.write("versions", with_version_columns(spark.createDataFrame([(1, "1.0|A", "1.0", "A", "b", None)], "version_num long, version_id string, release string, build string, bundle_name string, created_at timestamp")))
    change.write("paths", with_path_columns(ids).withColumn("created_at", F.current_timestamp()))
    instances = ids.select(F.lit(1).cast("long").alias("version_num"), "path_id", (F.col("path_id") + 1).alias("content_id"), F.lit("b").alias("bundle_name"), F.current_timestamp().alias("updated_at"))
    change.write("file_instances", instances)
    none = F.lit(None).cast("string")
    change.write("contents", instances.select("version_num", "content_id", none.alias("content_hash"), none.alias("blob_key"), F.lit("k").alias("pack_object_key"), F.lit(0).cast("long").alias("pack_offset"), F.lit(1).cast("long").alias("pack_length"), F.lit(1).cast("long").alias("byte_size"), "updated_at").withColumnRenamed("updated_at", "created_at"))
    change.commit()
    return open_catalog(spark, out)


@pytest.mark.parametrize("query", ["latest_for_path", "file_content_ref"])
def test_point_lookups_push_the_id(spark, wide, query):
    """One pruned scan finds the id, and the filter on it reaches the scan of the large table, which is not shuffled."""
    path = wide.paths.where("path_id % 1000 = 7").first()["absolute_path"]
    found = search.latest_for_path(wide, path) if query == "latest_for_path" else search.file_content_ref(wide, 1, path)
    assert found.collect()[0]["absolute_path"] == path
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(path_id" not in plan and "hashpartitioning(content_id" not in plan
    formatted = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    scans = [part for part in formatted.split("\n\n") if "Scan parquet" in part and "file_instances" in part]
    assert scans and all("path_id" in part.split("DataFilters")[-1].split("ReadSchema")[0] for part in scans)


def parts_read(spark, frame):
    """{table: partitions read} of a query that has run, from Spark's own metrics."""
    frame.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    run = store.executionsList().last().executionId()
    values, nodes, out = store.executionMetrics(run), store.planGraph(run).allNodes(), {}
    for i in range(nodes.size()):
        node = nodes.apply(i)
        if not node.name().startswith("Scan parquet"):
            continue
        for k in range(node.metrics().size()):
            metric = node.metrics().apply(k)
            if metric.name() == "number of partitions read" and values.contains(metric.accumulatorId()):
                read = node.desc().partition("[")[2].partition("]")[0]
                table = next((t for t, column in (("symbol_presence", "owner_name_lc"), ("paths", "file_name_lc"), ("name_grams", "gram#")) if column in read), "other")
                out.setdefault(table, []).append(int(values.apply(metric.accumulatorId())))
    return out


def test_a_search_reads_the_buckets_that_the_index_names(spark, tmp_path):
    from pyspark.sql import functions as F

    from verdex.operators import grams
    from verdex.sources.catalog import BUCKETS, Change, open_catalog

    out = f"file://{tmp_path}/c"
    change = Change(spark, out)
    change.write("versions", with_version_columns(spark.createDataFrame([(1, "1.0|A", "1.0", "A", "b", None)], "version_num long, version_id string, release string, build string, bundle_name string, created_at timestamp")))
    ids = spark.range(500).select(F.col("id").alias("path_id"), F.concat(F.lit("/S/F"), F.col("id") % 7, F.lit(".framework/File"), "id", F.when(F.col("id") % 100 == 3, "Rare").otherwise(""), F.lit(".h")).alias("absolute_path"))
    change.write("paths", with_path_columns(ids).withColumn("created_at", F.current_timestamp()))
    change.write("file_instances", ids.select(F.lit(1).cast("long").alias("version_num"), "path_id", (F.col("path_id") + 1).alias("content_id"), F.lit("b").alias("bundle_name"), F.current_timestamp().alias("updated_at")))
    owner = F.when(F.col("path_id") == 42, "NSRareOwner").when(F.col("path_id") == 43, "xyz").otherwise(F.concat(F.lit("Own"), F.col("path_id").cast("string")))
    rows = ids.select("path_id", F.lit("interface").alias("owner_kind"), owner.alias("owner_name"), F.lower(owner).alias("owner_name_lc"), F.lit("ivar").alias("symbol_type"), F.lit("k").alias("symbol_key"), F.lit(0).alias("word"), F.lit(2).cast("long").alias("bits"), F.current_timestamp().alias("updated_at"))
    change.write("symbol_presence", rows, versions=[1])
    change.commit()
    plain = open_catalog(spark, out)
    grams.rebuild(spark, out)
    c = open_catalog(spark, out)
    for keyword in ("RAREown", "le", "%", "file1"):
        assert rows_of(search.search_owner_candidates(c, keyword)) == rows_of(search.search_owner_candidates(plain, keyword))
        for call in (search.count_paths_in_directory, lambda c, d, k: search.files_page(c, 1, d, 5, keyword=k)):
            assert rows_of(call(c, "F1.framework", f" {keyword} ")) == rows_of(call(plain, "F1.framework", f" {keyword} "))
    few = parts_read(spark, search.search_owner_candidates(c, "RareOwner"))
    assert few["symbol_presence"] == [1] and few["paths"] == [1] and max(few["name_grams"]) <= 7
    assert parts_read(spark, search.search_owner_candidates(plain, "RareOwner"))["symbol_presence"][0] > 40
    assert BUCKETS == 64


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_lookups_of_unique_tables_do_not_aggregate(spark, wide):
    plan = search.latest_for_all_paths(wide)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "max(struct" not in plan
