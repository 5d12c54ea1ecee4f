"""Catalogue queries: each takes a catalogue and returns a DataFrame.

Substring tests are literal (``contains``); ids that must exist are inner lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdex.functions.text import normalise_keyword
from verdex.operators import grams, lookups, presence
from verdex.sources import objects
from verdex.sources.catalog import Catalog, bucket_of, in_packs

DIRECTORY_HITS, OWNER_HITS, LISTING_HITS = 30, 50, 2000


def _lit_lower(text: str):
    return F.lower(F.lit(text))


def latest_version(c: Catalog) -> DataFrame:
    """(version_num, version_id) of the greatest number; no row for an empty table."""
    return c.versions.groupBy().agg(F.max_by(F.struct("version_num", "version_id"), F.struct("version_num", "version_id")).alias("v")).where("v is not null").select("v.*")


def version_num_by_id(c: Catalog, version_id: str) -> DataFrame:
    """The number of an id, whatever its letter case; the greatest of several."""
    return c.versions.where(F.col("version_id_lc") == _lit_lower(version_id)).agg(F.max("version_num").alias("version_num")).where("version_num is not null")


def version_id_by_num(c: Catalog, version_num: int) -> DataFrame:
    return c.versions.where(F.col("version_num") == version_num).agg(F.max("version_id").alias("version_id")).where("version_id is not null")


def instances_with_versions(c: Catalog) -> DataFrame:
    return lookups.inner(c.file_instances, c.versions, "version_num", ["version_id"], unique=True)


def id_of_path(c: Catalog, absolute_path: str | Column) -> Column:
    """The id of a path as a scalar subquery: it is found before the other tables are scanned, whose filters it reaches."""
    return c.paths.where(F.col("absolute_path") == absolute_path).agg(F.max("path_id")).scalar()


def _text(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def latest_for_path(c: Catalog, absolute_path: str | Column) -> DataFrame:
    """The newest known version that holds a path."""
    here = c.file_instances.where(F.col("path_id") == id_of_path(c, absolute_path)).select("version_num", "path_id")
    named = lookups.inner(here, c.versions, "version_num", ["version_id"], unique=True)
    return named.select("version_num", "version_id", "path_id", _text(absolute_path).alias("absolute_path")).orderBy(F.desc("version_num"), "path_id").limit(1)


def latest_for_all_paths(c: Catalog) -> DataFrame:
    """The same for every path at once."""
    newest = lookups.known(c.file_instances, c.versions, "version_num").groupBy("path_id").agg(F.max("version_num").alias("version_num"))
    # The upsert keeps one row a path, so the large dimension is joined as it is.
    named = lookups.inner(newest, c.versions, "version_num", ["version_id"], unique=True).join(c.paths.select("path_id", "absolute_path"), "path_id")
    return named.select("version_num", "version_id", "path_id", "absolute_path")


def file_content_ref(c: Catalog, version_num: int, absolute_path: str | Column) -> DataFrame:
    """Where the bytes of a path in a version lie; the smallest content of several."""
    at = c.file_instances.where((F.col("version_num") == version_num) & (F.col("path_id") == id_of_path(c, absolute_path))).select("version_num", "path_id", "content_id")
    # The ids found are few and known before the contents are scanned.
    wanted = at.agg(F.min("content_id")).scalar()
    contents = c.contents.where(F.col("content_id") == wanted)
    if "version_num" in c.contents.columns:
        contents = contents.where(F.col("version_num") == version_num)
    contents = contents.select("content_id", "pack_object_key", "pack_offset", "pack_length")
    known = c.versions.where(F.col("version_num") == version_num).select("version_num", "version_id")
    found = contents.join(F.broadcast(at.distinct()), "content_id").join(F.broadcast(known), "version_num")  # a row each
    return found.select("version_num", "version_id", "path_id", "content_id", _text(absolute_path).alias("absolute_path"), "pack_object_key", "pack_offset", "pack_length").orderBy("content_id").limit(1)


def read_blob(c: Catalog, version_num: int, content_id: int) -> DataFrame:
    """The bytes of a content in a version; of a pack only these are read."""
    here = (F.col("version_num") == version_num) & (F.col("content_id") == content_id)
    if c.objects is None:
        return c.blobs.where(here).select("pack_object_key", "pack_offset", "body").limit(1)
    ref = in_packs(c.contents.where(here)).select("pack_object_key", "pack_offset", "pack_length").limit(1)
    return objects.read_ranges(ref, c.objects).drop("pack_length")


def read_range(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """Byte ranges of whole pack objects (pack_object_key, body)."""
    return objects.join(refs, "pack_object_key").withColumn("body", F.substring("body", F.col("pack_offset").cast("int") + 1, F.col("pack_length").cast("int")))


def search_directories(c: Catalog, prefix: str, limit: int = DIRECTORY_HITS) -> DataFrame:
    """Directory names with a prefix, each with its first full path."""
    hits = c.paths.where(F.col("dir_name_lc").startswith(_lit_lower(prefix)))
    return hits.groupBy("dir_name").agg(F.min("dir_path").alias("sample_dir_path")).orderBy("dir_name").limit(limit)


#: Ranks of owner hits by kind: an exact name, and a name that contains the keyword.
EXACT_RANKS = {"interface": 1, "protocol": 2, "category": 3}
EXACT_OTHER, PARTIAL_OTHER, PARTIAL_STEP = 4, 14, 10
FILE_EXACT, FILE_PARTIAL = 0, 10


def search_owner_candidates(c: Catalog, keyword: str, limit: int = OWNER_HITS) -> DataFrame:
    """Paths whose file name or owners match, best first.

    A path's rank is the best of its matches; the version of an owner match is the
    newest of all its matched owners.  A path whose best match is in an unknown version is left out.
    """
    kw, few = _lit_lower(keyword), grams.found(c, keyword)
    name = grams.narrowed(c.paths, few).where(F.col("file_name_lc").contains(kw)).select("path_id", F.when(F.col("file_name_lc") == kw, FILE_EXACT).otherwise(FILE_PARTIAL).alias("priority_rank"))
    by_name = name.join(c.latest_by_path, "path_id").select("priority_rank", F.col("latest_version_num").alias("matched_version_num"), "path_id")
    kinds = F.create_map(*[F.lit(x) for pair in EXACT_RANKS.items() for x in pair])
    exact = F.col("owner_name_lc") == kw
    rank = F.when(exact, F.coalesce(kinds[F.col("owner_kind")], F.lit(EXACT_OTHER))).otherwise(F.coalesce(kinds[F.col("owner_kind")] + PARTIAL_STEP, F.lit(PARTIAL_OTHER)))
    owners = grams.narrowed(c.symbol_presence, few).where(F.col("owner_name_lc").contains(kw))
    by_owner = owners.groupBy("path_id").agg(F.min(rank).alias("priority_rank"), F.max(presence.greatest()).alias("matched_version_num")).select("priority_rank", "matched_version_num", "path_id")
    all_hits = by_name.unionByName(by_owner).where("matched_version_num > 0")
    # Best hit a path before its text is fetched: numbers alone are grouped.
    order = Window.partitionBy("path_id").orderBy("priority_rank", F.desc("matched_version_num"))
    best = all_hits.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    named = lookups.inner(best.withColumnRenamed("matched_version_num", "version_num"), c.versions, "version_num", ["version_id"], unique=True)
    placed = named.join(c.paths.select("path_id", "absolute_path"), "path_id")
    out = placed.select(F.col("priority_rank").cast("long").alias("best_priority_rank"), F.col("version_num").alias("max_version_num"), F.col("version_id").alias("max_version_id"), "path_id", "absolute_path")
    return out.orderBy("best_priority_rank", F.desc("max_version_num"), "absolute_path", "path_id").limit(limit)


def count_distinct_directories(c: Catalog) -> DataFrame:
    return c.paths.agg(F.count_distinct("dir_name").alias("n_directories"))


def count_distinct_owners(c: Catalog) -> DataFrame:
    return c.symbol_presence.where("owner_name_lc <> ''").agg(F.count_distinct("owner_name_lc").alias("n_owners"))


def version_ids_for_paths(c: Catalog, path_ids: list[int]) -> DataFrame:
    """(path_id, version_ids) newest first, for the given paths."""
    held = instances_with_versions(c).where(F.col("path_id").isin(sorted(set(path_ids)))).select("path_id", "version_num", "version_id")
    ordered = F.sort_array(F.collect_set(F.struct("version_num", "version_id")), asc=False)
    return held.groupBy("path_id").agg(F.transform(ordered, lambda v: v["version_id"]).alias("version_ids"))


def _files(c: Catalog, keyword: str) -> DataFrame:
    """Paths that may match a keyword as users type it."""
    return grams.narrowed(c.paths, grams.found(c, keyword.strip()) if keyword.strip() else None)


def count_paths_in_directory(c: Catalog, directory: str, keyword: str = "") -> DataFrame:
    """Over the paths of all versions."""
    kw = normalise_keyword(F.lit(keyword))
    return _files(c, keyword).where((F.col("dir_name") == directory) & ((kw == "") | F.col("file_name_lc").contains(kw))).agg(F.count(F.lit(1)).alias("n_paths"))


def _listing(c: Catalog, version_num: int, directory: str, keyword: str = "") -> DataFrame:
    kw = normalise_keyword(F.lit(keyword))
    paths = _files(c, keyword).where((F.col("dir_name") == directory) & ((kw == "") | F.col("file_name_lc").contains(kw)))
    here = c.file_instances.where(F.col("version_num") == version_num).select("version_num", "path_id", "content_id").distinct()
    here = lookups.inner(here, paths, "path_id", ["absolute_path"], unique=True)
    here = here.join(F.broadcast(c.versions.where(F.col("version_num") == version_num).select("version_num", "version_id")), "version_num")  # one row
    sizes = c.contents.where(F.col("version_num") == version_num) if "version_num" in c.contents.columns else c.contents
    return here.join(sizes.select("content_id", "pack_length"), "content_id", "left").select("version_num", "version_id", "path_id", "absolute_path", F.col("pack_length").alias("file_size_bytes"))


def files_page(c: Catalog, version_num: int, directory: str, page_size: int, cursor: str | None = None, direction: str = "next", keyword: str = "") -> DataFrame:
    """One page of a listing by path, with its flags and cursors on every row.

    ``is_row`` rows are the page in ascending order; a page without rows has one
    row with nulls that still tells whether there are pages around it.
    """
    size, back = max(1, page_size), direction == "prev"
    rows = _listing(c, version_num, directory, keyword)
    if cursor:
        rows = rows.where(F.col("absolute_path") < cursor if back else F.col("absolute_path") > cursor)
    order = [F.desc("absolute_path"), F.desc("path_id")] if back else [F.asc("absolute_path"), F.asc("path_id")]
    fetched = rows.orderBy(*order).limit(size + 1)
    # At most page_size + 1 rows from here on.
    one = F.sort_array(F.collect_list(F.struct("absolute_path", "path_id", "version_num", "version_id", "file_size_bytes")))
    page = fetched.agg(one.alias("files"))
    more = F.size("files") > size
    start = F.when(more & F.lit(back), 2).otherwise(1)
    page = page.select(F.slice("files", start, F.lit(size)).alias("files"), (F.lit(bool(cursor)) if not back else more).alias("has_prev"), (more if not back else F.lit(bool(cursor))).alias("has_next"))
    page = page.withColumn("prev_cursor", F.when(F.col("has_prev") & (F.size("files") > 0), F.try_element_at("files", F.lit(1))["absolute_path"]))
    page = page.withColumn("next_cursor", F.when(F.col("has_next") & (F.size("files") > 0), F.try_element_at("files", F.lit(-1))["absolute_path"]))
    out = page.select(F.posexplode_outer("files").alias("pos", "file"), "has_prev", "has_next", "prev_cursor", "next_cursor")
    return out.select(F.col("pos").cast("long").alias("pos"), "file.version_num", "file.version_id", "file.path_id", "file.absolute_path", "file.file_size_bytes", "has_prev", "has_next", "prev_cursor", "next_cursor")


def files_in_directory(c: Catalog, version_num: int, directory: str, limit: int | None = LISTING_HITS) -> DataFrame:
    """The first files by path; all of them where there is no limit."""
    rows = _listing(c, version_num, directory).orderBy("absolute_path", "path_id")
    return rows if limit is None else rows.limit(limit)


def versions_for_path(c: Catalog, path_id: int) -> DataFrame:
    return instances_with_versions(c).where(F.col("path_id") == path_id).select("version_num", "version_id").distinct().orderBy(F.desc("version_num"))


def symbols_for_content(c: Catalog, content_id: int) -> DataFrame:
    keys = ["owner_name", "symbol_type", "symbol_key", "line_no"]
    return c.symbols.where(F.col("content_id") == content_id).select(*keys).distinct().orderBy(*keys)


def presence_map(c: Catalog, path_id: int) -> DataFrame:
    """(owner_name, symbol_type, symbol_key, versions), merged over owner kinds."""
    rows = c.symbol_presence.where(F.col("path_id") == path_id)
    if "bucket" in rows.columns:
        rows = rows.where(F.col("bucket") == bucket_of(F.lit(path_id)))
    return presence.sets(rows, ["owner_name", "symbol_type", "symbol_key"])


def paths_in_directory(c: Catalog, version_num: int, directory_path: str) -> DataFrame:
    here = c.file_instances.where(F.col("version_num") == version_num)
    return lookups.inner(here, c.paths.where(F.col("dir_path") == directory_path), "path_id", ["absolute_path"], unique=True).select("absolute_path").distinct()
