"""Every registered query against its SQL, on whole small tables."""

import duckdb
import pytest

from verdex.operators import search
from verdex.plans import registry, testviews


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, small, duck, name):
    frame = registry.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    got = sorted((plain(tuple(r)) for r in frame.select(*columns).collect()), key=repr)
    expected = duck.sql(registry.ORACLES[name])
    assert sorted(expected.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted((plain(r) for r in duck.sql(f"select {names} from ({registry.ORACLES[name]})").fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def write_parts(duck, folder, part, lineitem):
    """The tables of a folder; ``part`` and ``lineitem`` are SQL over the small ones.  Returns a connection that has them."""
    own = duckdb.connect()
    own.sql("set timezone='UTC'")
    for name, rows in (("part", part), ("lineitem", lineitem)):
        duck.execute(f"copy ({rows}) to '{folder}/{name}.parquet' (format parquet)")
        own.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return own


def same_as_sql(spark, folder, own, name):
    frame = registry.QUERIES[name](spark, str(folder))
    names = ", ".join(f'"{c}"' for c in sorted(frame.columns))
    got = sorted((plain(tuple(r)) for r in frame.select(*sorted(frame.columns)).collect()), key=repr)
    expected = sorted((plain(r) for r in own.execute(f"select {names} from ({registry.ORACLES[name]})").fetchall()), key=repr)
    assert got == expected
    return got


@pytest.fixture(scope="module")
def shared_contents(duck, tmp_path_factory):
    """Parts again with keys past the factor of content ids, so that versions share contents of parts that differ."""
    folder, shift = tmp_path_factory.mktemp("shared_contents"), testviews.FACTOR + 3
    twice = "select * replace ({0} + k * {1} as {0}) from {2}, range(2) r(k)"
    return folder, write_parts(duck, folder, twice.format("p_partkey", shift, "part"), twice.format("l_partkey", shift, "lineitem"))


@pytest.mark.parametrize(
    "name",
    [
        "availability_matrix", "gram_candidates", "line_labels", "line_versions", "name_grams", "presence_merge", "presence_row_count", "presence_updated_at", "view_page_matrix",
        "search_owner_candidates", "search_owner_candidates_indexed", "search_page_owner_versions", "search_service_owners", "symbol_presence_build", "symbol_presence_map",
    ],
)
def test_versions_that_share_contents(spark, shared_contents, name):
    assert same_as_sql(spark, *shared_contents, name)


def test_entries_of_a_directory_beyond_the_listings_limit(spark, duck, tmp_path):
    copies = "select * replace ({0} + k * 1000 as {0}) from {1}, range(400) r(k) where {0} in (select p_partkey from part where p_brand = 'Brand#12')"
    own = write_parts(duck, tmp_path, copies.format("p_partkey", "part"), copies.format("l_partkey", "lineitem"))
    assert len(same_as_sql(spark, tmp_path, own, "file_entries")) > search.LISTING_HITS
