"""Page compositions: each returns the DataFrames a page is made of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdex.operators import search, view
from verdex.sources.catalog import Catalog


@dataclass
class SearchPage:
    directories: DataFrame | None = None
    owners: DataFrame | None = None
    owner_versions: DataFrame | None = None
    listing: DataFrame | None = None
    entries: DataFrame | None = None
    n_directories: DataFrame | None = None
    n_owners: DataFrame | None = None
    n_paths: DataFrame | None = None


def run_search(c: Catalog, keyword: str) -> tuple[DataFrame, DataFrame] | None:
    """Directory and owner hits; none for a blank keyword."""
    keyword = keyword.strip()
    return (search.search_directories(c, keyword), search.search_owner_candidates(c, keyword)) if keyword else None


def search_page(c: Catalog, keyword: str = "", directory: str = "", cursor: str | None = None, direction: str = "next", page_size: int = 100) -> SearchPage:
    """A global search without a directory; with one, a page of its files in the latest version."""
    page = SearchPage(n_directories=search.count_distinct_directories(c), n_owners=search.count_distinct_owners(c))
    if directory:
        latest = search.latest_version(c).first()
        page.n_paths = search.count_paths_in_directory(c, directory, keyword)
        if latest:
            page.listing = search.files_page(c, latest["version_num"], directory, page_size, cursor, direction, keyword)
            rows = page.listing.where("path_id is not null")
            held = search.instances_with_versions(c).join(F.broadcast(rows.select("path_id")), "path_id", "left_semi")
            page.entries = view.file_entries(rows, version_ids(held))
    elif hits := run_search(c, keyword):
        page.directories, page.owners = hits
        # At most the limit of hits: their versions are a broadcast join away.
        held = search.instances_with_versions(c).join(F.broadcast(page.owners.select("path_id")), "path_id", "left_semi")
        page.owner_versions = version_ids(held)
    return page


def version_ids(held: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_set(F.struct("version_num", "version_id")), asc=False)
    return held.groupBy("path_id").agg(F.transform(ordered, lambda v: v["version_id"]).alias("version_ids"))


@dataclass
class ViewPage:
    ref: DataFrame
    versions: DataFrame
    matrix: DataFrame
    labels: DataFrame
    source: DataFrame


def view_page(c: Catalog, version_id: str, absolute_path: str) -> ViewPage | None:
    """Everything about one file in one version; none where it does not exist."""
    number = search.version_num_by_id(c, version_id).first()
    if number is None:
        return None
    ref = search.file_content_ref(c, number["version_num"], absolute_path)
    row = ref.first()
    if row is None:
        return None
    versions = search.versions_for_path(c, row["path_id"])
    symbols = view.symbols_with_versions(c, row["path_id"], row["content_id"])
    body = search.read_blob(c, row["version_num"], row["content_id"]).select(F.lit(row["version_num"]).alias("version_num"), F.lit(row["version_id"]).alias("version_id"), F.lit(absolute_path).alias("absolute_path"), F.make_valid_utf8(F.col("body").cast("string")).alias("text"))
    folder = absolute_path.rpartition("/")[0] or "/"
    present = search.paths_in_directory(c, row["version_num"], folder).withColumn("version_num", F.lit(row["version_num"]))
    return ViewPage(ref, versions, view.availability_matrix(c, row["path_id"], row["content_id"]), view.line_labels(view.line_versions(symbols), versions), view.render(body, present))
