"""A tree of header files written from the star-schema test data, for the queries that read files.

Parts fall into five bundles by size; a bundle has a header for each brand and thousand
part keys, with one method a part.  Tasks write the files.  A bundle's release and build
count its parts.  The metadata of every third bundle is whole; the next one's first source
is broken; the next has no build.  The last bundle has no headers, only another file.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.functions.paths import absolute
from verdex.plans.ingest import Options, ingest, ingest_headers
from verdex.sources import headers
from verdex.sources.catalog import Catalog, Change, open_catalog
from verdex.sources.objects import write_objects
from verdex.streaming.ingest import receive

BUNDLES, BLOCK = 5, 1000


def folder(spark: SparkSession) -> str:
    """A new folder that all nodes share; a temporary one only in local mode without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        holder = tempfile.TemporaryDirectory(prefix="verdex-tree-")
        atexit.register(holder.cleanup)
        base = f"file://{holder.name}"
    return f"{base.rstrip('/')}/verdex-tree-{uuid.uuid4().hex}"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    bundle = F.col("p_size") % BUNDLES
    return part.select(bundle.cast("long").alias("bundle"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"), F.floor(F.col("p_partkey") / BLOCK).alias("block"), "p_partkey")


def bundle_name() -> Column:
    return F.concat(F.lit("B"), F.col("bundle").cast("string"), F.lit("__x"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle, block, relative_path, text), a row a header."""
    methods = F.array_join(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda k: F.concat(F.lit("- (void)m"), k.cast("string"), F.lit(";\n"))), "")
    # Headers of an odd brand have no owner, and some repeat their first line.
    head = F.concat(F.lit("@interface "), F.col("brand"), F.lit("\n"))
    head = F.when(F.col("brand") == "Brand11", "int x;\n").when(F.col("brand").endswith("3"), F.concat(head, head)).otherwise(head)
    whole = parts(spark, sf_dir).where(F.col("bundle") < BUNDLES - 1).groupBy("bundle", "brand", "block").agg(methods.alias("m"))
    path = F.format_string("F/%s.framework/%s_%d.h", "brand", "brand", "block")
    return whole.select("bundle", "block", path.alias("relative_path"), F.concat(head, "m", F.lit("@end\n")).alias("text"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, content) of the bundles' metadata files."""
    counted = parts(spark, sf_dir).groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))

    def entry(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"<key>{key}</key><string>"), value, F.lit("</string>"))

    kind = F.col("bundle") % 3
    release = F.concat_ws(".", (F.col("bundle") + 1).cast("string"), (F.col("n") % 7).cast("string"))
    build = F.when(kind < 2, entry("ProductBuildVersion", F.concat(F.lit("U"), F.col("n").cast("string")))).otherwise("")
    whole = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<plist version="1.0"><dict>'), entry("ProductVersion", release), build, F.lit("</dict></plist>"))
    made = F.array(F.struct(F.when(kind == 0, "SystemVersion.plist").otherwise("Restore.plist").alias("name"), whole.alias("text")), F.when(kind == 1, F.struct(F.lit("SystemVersion.plist").alias("name"), F.lit("no property list").alias("text"))))
    each = counted.select("bundle", F.explode(F.array_compact(made)).alias("f"))
    return each.select(F.concat(F.lit("files/"), bundle_name(), F.lit("/"), F.col("f.name")).alias("key"), F.col("f.text").cast("binary").alias("content"))


def write(spark: SparkSession, sf_dir: str) -> str:
    """Write the tree; returns its folder, with ``headers`` and ``files`` in it."""
    root = folder(spark)
    texts = files(spark, sf_dir).select(F.concat(F.lit("headers/"), bundle_name(), F.lit("/"), "relative_path").alias("key"), F.col("text").cast("binary").alias("content"))
    other = parts(spark, sf_dir).where(F.col("bundle") == BUNDLES - 1).select("bundle").distinct()
    other = other.select(F.concat(F.lit("headers/"), bundle_name(), F.lit("/F/about.txt")).alias("key"), F.lit(b"none").alias("content"))
    write_objects(texts.unionByName(other).unionByName(metadata(spark, sf_dir)), root)
    return root


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle_name, absolute_path, n_bytes, md5) of all header files."""
    found = headers.scan(spark, f"{write(spark, sf_dir)}/headers")
    return found.select("bundle_name", "absolute_path", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("md5"))


def first_files(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """(bundle_name, relative_path) of the first files of each bundle."""
    return headers.scan(spark, f"{write(spark, sf_dir)}/headers", max_files=most).select("bundle_name", "relative_path")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle_name, release, build) of all bundles, by folder and metadata."""
    root = write(spark, sf_dir)
    return headers.choose_release(headers.read_metadata(headers.metadata_files(spark, f"{root}/files")), headers.bundles_of(spark, f"{root}/headers"))


def imported(spark: SparkSession, sf_dir: str, **options: bool) -> Catalog:
    """The catalogue of the whole tree."""
    root = write(spark, sf_dir)
    ingest(spark, f"{root}/headers", f"{root}/files", f"{root}/catalogue", Options(**options))
    return open_catalog(spark, f"{root}/catalogue")


def imported_again(spark: SparkSession, sf_dir: str) -> Catalog:
    """The same, after the first bundle has come again with its first headers alone."""
    root = write(spark, sf_dir)
    out = f"{root}/catalogue"
    ingest(spark, f"{root}/headers", f"{root}/files", out)
    less = files(spark, sf_dir).where("bundle = 0 and block = 0")
    found = less.select(bundle_name().alias("bundle_name"), absolute(F.col("relative_path")).alias("absolute_path"), F.col("text").cast("binary").alias("content"))
    known = open_catalog(spark, out).versions.select("bundle_name", "release", "build").where("bundle_name = 'B0__x'")
    ingest_headers(Change(spark, out), found, known)
    return open_catalog(spark, out)


def streamed(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalogue after three micro-batches with a third of each bundle's headers; odd bundles say that there is one more."""
    root = folder(spark)
    whole = files(spark, sf_dir)
    sizes = whole.groupBy("bundle").agg((F.count(F.lit(1)) + F.col("bundle") % 2).alias("n_files"))
    release, build = (F.col("bundle") + 1).cast("string"), F.lit("A")
    drops = whole.join(F.broadcast(sizes), "bundle").select(bundle_name().alias("bundle_name"), release.alias("release"), build.alias("build"), "relative_path", F.col("text").cast("binary").alias("content"), "n_files")  # a row a bundle
    third = F.pmod(F.xxhash64("relative_path"), F.lit(3))
    for epoch in range(3):
        receive(drops.where(third == epoch), epoch, f"{root}/catalogue", Options(allow_old=True))
    return open_catalog(spark, f"{root}/catalogue")


#: The same as SQL: files (bundle_name, absolute_path, text) and releases.
TREE_SQL = f"""
part0 as (select p_size % {BUNDLES} bundle, replace(p_brand,'#','') brand, p_partkey // {BLOCK} block, p_partkey from part),
releases as (select 'B' || cast(bundle as varchar) || '__x' bundle_name, cast(bundle + 1 as varchar) || '.' || cast(count(*) % 7 as varchar) release,
    case when bundle % 3 < 2 then 'U' || cast(count(*) as varchar) else 'B' || cast(bundle as varchar) end build, row_number() over (order by bundle) version_num from part0 group by bundle),
tree as (select 'B' || cast(bundle as varchar) || '__x' bundle_name, block, '/F/' || brand || '.framework/' || brand || '_' || cast(block as varchar) || '.h' absolute_path, brand,
    case when brand='Brand11' then 'int x;' || chr(10) else '@interface ' || brand || chr(10) end head, brand like '%3' as doubled,
    string_agg('- (void)m' || cast(p_partkey as varchar) || ';' || chr(10), '' order by p_partkey) || '@end' || chr(10) as tail from part0 where bundle < {BUNDLES - 1} group by bundle, brand, block),
texts as (select *, case when doubled then head || head else head end || tail as text, head || tail as body from tree join releases using (bundle_name)),
good as (select * from texts where brand<>'Brand11')
"""


def with_tree(body: str, *more: str) -> str:
    return "with " + ",\n".join([TREE_SQL.strip(), *(m.strip() for m in more)]) + "\n" + body
