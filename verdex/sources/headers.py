"""Sources: header trees, release metadata, executable detection."""

from __future__ import annotations

import plistlib
import struct
from collections.abc import Iterator
from xml.parsers.expat import ExpatError

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from verdex import schemas
from verdex.functions.paths import absolute
from verdex.sources.catalog import Storage


def scan(spark: SparkSession, root: str, bundles: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """(bundle_name, relative_path, absolute_path, content) of all headers under bundle directories.

    ``max_files`` keeps the first files of each bundle by path.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.h").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
    place = F.regexp_extract("path", rf"^(?:[a-z0-9]+:(?://[^/]*)?)?{_quoted(prefix)}/+(.*)$", 1)
    rows = files.select(F.regexp_extract(place, "^([^/]+)/", 1).alias("bundle_name"), F.regexp_extract(place, "^[^/]+/(.*)$", 1).alias("relative_path"), "content").where("bundle_name <> ''")
    if bundles:
        rows = rows.where(F.col("bundle_name").isin(bundles))
    if max_files is not None:
        first = Window.partitionBy("bundle_name").orderBy("relative_path")
        keep = rows.select("bundle_name", "relative_path").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= max_files).drop("rn")
        rows = rows.join(keep, ["bundle_name", "relative_path"], "left_semi")
    return rows.withColumn("absolute_path", absolute(F.col("relative_path"))).select("bundle_name", "relative_path", "absolute_path", "content")


def _quoted(text: str) -> str:
    return r"\Q" + text.rstrip("/").replace(r"\E", r"\E\\E\Q") + r"\E"


def bundles_of(spark: SparkSession, root: str, bundles: list[str] | None = None) -> DataFrame:
    """(bundle_name) of the folders under ``root``, also of those without headers; ``bundles`` picks some."""
    names = [n for n in Storage(spark, root).folders() if not bundles or n in set(bundles)]
    return spark.createDataFrame([(n,) for n in names], "bundle_name string")


#: Places of release metadata in a bundle, in order of trust.
METADATA = ["SystemVersion.plist", "System/Library/CoreServices/SystemVersion.plist", "Restore.plist"]


def read_metadata(files: DataFrame) -> DataFrame:
    """(bundle_name, source, content) property lists to (…, product_version, product_build, error)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for bundle, source, content in zip(batch["bundle_name"], batch["source"], batch["content"]):
                try:
                    data = plistlib.loads(bytes(content))
                    if not isinstance(data, dict):
                        raise ValueError("the root is no dictionary")
                    build = data.get("ProductBuildVersion")
                    rows.append((bundle, source, str(data.get("ProductVersion", "")).strip(), None if build is None else str(build), None))
                except (plistlib.InvalidFileException, ExpatError, ValueError, TypeError) as problem:
                    rows.append((bundle, source, None, None, str(problem) or type(problem).__name__))
            yield pd.DataFrame(rows, columns=schemas.PLIST_META.names)

    return files.select("bundle_name", "source", "content").mapInPandas(parse, schemas.PLIST_META)


def metadata_files(spark: SparkSession, root: str) -> DataFrame:
    """(bundle_name, source, content) of the known metadata places under bundle directories."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.plist").option("recursiveFileLookup", "true").load(root)
    choice = "|".join(_quoted(m) for m in METADATA)
    rows = files.select(F.regexp_extract("path", rf"/([^/]+)/(?:{choice})$", 1).alias("bundle_name"), F.regexp_extract("path", rf"/[^/]+/({choice})$", 1).alias("source"), "content")
    return rows.where("source <> ''")


def choose_release(metadata: DataFrame, bundles: DataFrame) -> DataFrame:
    """(bundle_name, release, build): each bundle's first readable metadata.

    A bundle without readable metadata, or whose metadata has a blank product
    version, is an error when the result is computed.  A missing build is the
    bundle's name before ``__``.
    """
    ranks = F.create_map(*[F.lit(x) for i, m in enumerate(METADATA) for x in (m, i)])
    readable = metadata.where("error is null").groupBy("bundle_name").agg(F.min_by(F.struct("product_version", "product_build"), ranks[F.col("source")]).alias("m"))
    rows = bundles.select("bundle_name").distinct().join(readable, "bundle_name", "left")
    problem = F.when(F.col("m").isNull(), F.lit("no readable release metadata: ")).when(F.col("m.product_version") == "", F.lit("no product version: "))
    release = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.col("bundle_name"))).cast("string")).otherwise(F.col("m.product_version"))
    return rows.select("bundle_name", release.alias("release"), F.coalesce("m.product_build", F.element_at(F.split("bundle_name", "__"), 1)).alias("build"))


# Fixed values of the Mach-O format: magic numbers as hex of the first four bytes.
THIN_LITTLE, THIN_BIG = ["CEFAEDFE", "CFFAEDFE"], ["FEEDFACE", "FEEDFACF"]
FAT = {"CAFEBABE": (">", 20), "CAFEBABF": (">", 24), "BEBAFECA": ("<", 20), "BFBAFECA": ("<", 24)}
EXECUTE = 2
MOST_SLICES = 4096


def thin_executable(content: Column) -> Column:
    """Is a binary a thin executable?  Native: magic number and file type."""
    magic = F.hex(F.substring(content, 1, 4))
    kind = F.hex(F.substring(content, 13, 4))
    little, big = f"{EXECUTE:02X}000000", f"000000{EXECUTE:02X}"
    return (magic.isin(THIN_LITTLE) & (kind == little)) | (magic.isin(THIN_BIG) & (kind == big))


@F.pandas_udf(BooleanType())
def fat_executable(content: pd.Series) -> pd.Series:
    """Does a universal binary hold an executable slice?"""

    def one(data: bytes | None) -> bool:
        order, entry = FAT.get((data or b"")[:4].hex().upper(), ("", 0))
        if not entry or len(data) < 8:
            return False
        (slices,) = struct.unpack_from(order + "I", data, 4)
        if not 0 < slices <= MOST_SLICES or len(data) < 8 + slices * entry:
            return False
        for at in range(8, 8 + slices * entry, entry):
            (start,) = struct.unpack_from(order + ("Q" if entry == 24 else "I"), data, at + 8)
            head = data[start : start + 16]
            magic = head[:4].hex().upper()
            if len(head) == 16 and (magic in THIN_LITTLE and head[12:] == bytes([EXECUTE, 0, 0, 0]) or magic in THIN_BIG and head[12:] == bytes([0, 0, 0, EXECUTE])):
                return True
        return False

    return content.map(one).astype("boolean")


def executables(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``is_executable``; Python sees only universal binaries."""
    body = F.col(content)
    universal = F.coalesce(F.hex(F.substring(body, 1, 4)).isin(list(FAT)), F.lit(False))
    rows = files.withColumn("is_executable", F.coalesce(thin_executable(body), F.lit(False)))
    return rows.where(~universal).unionByName(rows.where(universal).withColumn("is_executable", fat_executable(body)))


def run_counters(results: DataFrame) -> DataFrame:
    """(total, succeeded, skipped, failed) of a batch of external jobs by their ``status``."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return results.agg(F.count(F.lit(1)).alias("total"), count("succeeded"), count("skipped"), count("failed"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text; null is ``\\N``, and backslash, tab and line ends are escaped."""
    escaped = [F.col(c).cast("string").alias(c) for c in df.columns]
    for was, now in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        escaped = [F.replace(e, F.lit(was), F.lit(now)) for e in escaped]
    df.select(F.concat_ws("\t", *[F.coalesce(e, F.lit("\\N")) for e in escaped]).alias("value")).write.mode("overwrite").text(path)
