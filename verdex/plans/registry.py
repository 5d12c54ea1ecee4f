"""One query for each operator, over whole test tables, and its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.functions import formatting, ids, paths, text, versions
from verdex.operators import grams, lookups, parser, presence, search, versioning, view
from verdex.plans import ingest, pages, testviews, treeviews
from verdex.plans.blake2 import hash_ctes
from verdex.plans.testviews import HEADERS_SQL, PARSE_SQL, catalog, headers, with_headers, with_views
from verdex.plans.treeviews import with_tree
from verdex.sources import headers as sources
from verdex.sources import objects
from verdex.sources.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
L = "cast({} as bigint)".format


def query(name: str, oracle: str | None = None):
    """Register a query of (spark, sf_dir), with its SQL."""
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def on_catalog(name: str, oracle: str, *more: str):
    """A query that takes the catalogue."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(catalog(spark, sf_dir))
        ORACLES[name] = with_views(oracle, *more)
        return f

    return put


#: Arguments of the parameterised queries.
PATH_ID, VERSION, DIRECTORY, KEYWORD, PAGE = 17, 3, "Brand12.framework", "brand1", 10
PATH_IDS = [3, 17, 17, 91, 150]


def _path_of(c, path_id: int = PATH_ID):
    """The path of an id as a scalar subquery."""
    return c.paths.where(F.col("path_id") == path_id).agg(F.max("absolute_path")).scalar()


_PATH = f"(select absolute_path from paths where path_id={PATH_ID})"
_CONTENT = VERSION * 1_000_000 + PATH_ID

on_catalog("latest_version", "select version_num, version_id from versions order by 1 desc limit 1")(search.latest_version)
on_catalog("version_num_by_id_ci", "select version_num from versions where version_id_lc=lower('1998.0|b4')")(lambda c: search.version_num_by_id(c, "1998.0|b4"))
on_catalog("version_id_by_num", f"select version_id from versions where version_num={VERSION}")(lambda c: search.version_id_by_num(c, VERSION))
on_catalog("resolve_latest_for_path", f"select version_num, version_id, path_id, absolute_path from file_instances join versions using (version_num) join paths using (path_id) where absolute_path={_PATH} order by 1 desc limit 1")(lambda c: search.latest_for_path(c, _path_of(c)))
on_catalog("latest_for_all_paths", "select latest_version_num version_num, version_id, path_id, absolute_path from latest_by_path join versions on version_num=latest_version_num join paths using (path_id)")(search.latest_for_all_paths)
on_catalog("file_content_ref", f"select version_num, version_id, path_id, content_id, absolute_path, pack_object_key, pack_offset, pack_length from file_instances join versions using (version_num) join paths using (path_id) join contents using (content_id) where version_num={VERSION} and absolute_path={_PATH} order by content_id limit 1")(lambda c: search.file_content_ref(c, VERSION, _path_of(c)))
on_catalog("search_directories", "select dir_name, min(dir_path) sample_dir_path from paths where starts_with(dir_name_lc,'brand1') group by 1 order by 1 limit 30")(lambda c: search.search_directories(c, "bRAND1"))
_HITS = """hits as (select case when file_name_lc='brand#1' then 0 else 10 end r, latest_version_num v, path_id from paths join latest_by_path using (path_id) where contains(file_name_lc,'brand#1')
  union all select min(case when owner_name_lc='brand#1' then case owner_kind when 'interface' then 1 when 'protocol' then 2 when 'category' then 3 else 4 end else case owner_kind when 'interface' then 11 when 'protocol' then 12 when 'category' then 13 else 14 end end), max(list_max(versions)), path_id from presence where contains(owner_name_lc,'brand#1') group by path_id),
ranked as (select *, row_number() over (partition by path_id order by r, v desc) rn from hits where v>0),
owners as (select cast(r as bigint) best_priority_rank, v max_version_num, version_id max_version_id, path_id, absolute_path from ranked join versions on version_num=v join paths using (path_id) where rn=1 order by r, v desc, absolute_path, path_id limit 50)"""
on_catalog("search_owner_candidates", "select * from owners", _HITS)(lambda c: search.search_owner_candidates(c, "Brand#1"))


def _indexed(c):
    """The catalogue with an index of its names."""
    return Catalog(**{n: c._given[n] for n in Catalog.TABLES} | {"symbol_presence": lambda: c.symbol_presence, "name_grams": lambda: grams.of_catalog(c)})


_GRAMS = "select distinct substr(name, cast(i as bigint), 3) gram, path_id from (select path_id, name, unnest(range(1, length(name)-1)) i from (select path_id, file_name_lc name from paths union select path_id, owner_name_lc from presence))"
on_catalog("name_grams", _GRAMS)(grams.of_catalog)
on_catalog("search_owner_candidates_indexed", "select * from owners", _HITS)(lambda c: search.search_owner_candidates(_indexed(c), "Brand#1"))
on_catalog("gram_candidates", f"select path_id from ({_GRAMS}) where gram in ('bra','ran','and','nd#','d#1','#12') group by path_id having count(*)=6")(lambda c: grams.found(_indexed(c), "Brand#12"))
on_catalog("count_distinct_directories", "select count(distinct dir_name) n_directories from paths")(search.count_distinct_directories)
on_catalog("count_distinct_owners", "select count(distinct owner_name_lc) n_owners from presence where owner_name_lc<>''")(search.count_distinct_owners)
on_catalog("version_ids_for_paths", f"select path_id, list(version_id order by version_num desc) version_ids from (select distinct path_id, version_num, version_id from file_instances join versions using (version_num) where path_id in {tuple(PATH_IDS)}) group by 1")(lambda c: search.version_ids_for_paths(c, PATH_IDS))
on_catalog("count_paths_in_directory", f"select count(*) n_paths from paths where dir_name='{DIRECTORY}' and contains(file_name_lc,'1')")(lambda c: search.count_paths_in_directory(c, DIRECTORY, " 1 "))

_LISTING = f"select distinct version_num, version_id, path_id, absolute_path, pack_length file_size_bytes from file_instances join versions using (version_num) join paths using (path_id) left join contents using (content_id) where version_num={VERSION} and dir_name='{DIRECTORY}'"
_CURSOR = "/LARGE/Brand12.framework/n"


def _page(where: str = "", back: bool = False, cursor: bool = False) -> str:
    """SQL of a page of the listing."""
    order, flag = ("desc" if back else "asc"), str(cursor).lower()
    return f"""got as (select *, row_number() over (order by absolute_path {order}, path_id {order}) rn from ({_LISTING} {where})),
shape as (select count(*)>{PAGE} more, min(absolute_path) filter (rn<={PAGE}) low, max(absolute_path) filter (rn<={PAGE}) high from got where rn<={PAGE + 1})
select row_number() over (order by absolute_path, path_id)-1 pos, version_num, version_id, path_id, absolute_path, file_size_bytes,
 {'more' if back else flag} has_prev, {flag if back else 'more'} has_next, case when {'more' if back else flag} then low end prev_cursor, case when {flag if back else 'more'} then high end next_cursor
from got, shape where rn<={PAGE}"""


def _pages(name: str, where: str, back: bool, cursor: str | None, keyword: str = "") -> None:
    """Register one page of the listing."""
    QUERIES[name] = lambda spark, sf_dir: search.files_page(catalog(spark, sf_dir), VERSION, DIRECTORY, PAGE, cursor, "prev" if back else "next", keyword)
    ORACLES[name] = with_views("", _page(where, back, bool(cursor)))


_pages("files_page_next", "", False, None)
_pages("files_page_next_cursor", f"and absolute_path>'{_CURSOR}'", False, _CURSOR)
_pages("files_page_prev", f"and absolute_path<'{_CURSOR}'", True, _CURSOR)
_pages("files_page_keyword", "and contains(file_name_lc,'1')", False, None, " 1 ")
on_catalog("files_in_directory", f"select * from ({_LISTING}) order by absolute_path, path_id limit 2000")(lambda c: search.files_in_directory(c, VERSION, DIRECTORY))
on_catalog("versions_for_path", f"select distinct version_num, version_id from file_instances join versions using (version_num) where path_id={PATH_ID}")(lambda c: search.versions_for_path(c, PATH_ID))
on_catalog("symbols_for_content", f"select distinct owner_name, symbol_type, symbol_key, line_no from symbols where content_id={_CONTENT}")(lambda c: search.symbols_for_content(c, _CONTENT))
on_catalog("symbol_presence_build", "select path_id, owner_kind, owner_name, owner_name_lc, symbol_type, symbol_key, versions from presence")(lambda c: presence.sets(c.symbol_presence, [*presence.KEY, "owner_name_lc"]))
on_catalog("symbol_presence_map", f"select owner_name, symbol_type, symbol_key, list_sort(list_distinct(flatten(list(versions)))) versions from presence where path_id={PATH_ID} group by 1,2,3")(lambda c: search.presence_map(c, PATH_ID))


@on_catalog("presence_merge", "select path_id, owner_kind, owner_name, symbol_type, symbol_key, versions from presence")
def _merge(c):
    """Presence of two overlapping ranges of versions, merged."""
    low, high = (c.versions.where(x).select("version_num") for x in ("version_num <= 4", "version_num >= 3"))
    return presence.sets(presence.merge(presence.build(c, low), presence.build(c, high)))


on_catalog("presence_row_count", "select count(*) n_keys from presence")(lambda c: presence.row_count(c.symbol_presence))
on_catalog("presence_version_filter", "select version_num from versions where bundle_name in ('bundle2','bundle3','bundle5') and version_id in ('1997.0|B3','1999.0|B5','2000.0|B6')")(lambda c: presence.target_versions(c, ["bundle2", "bundle3", "bundle5"], ["1997.0|B3", "1999.0|B5", "2000.0|B6"]))
on_catalog("paths_in_directory", f"select distinct absolute_path from file_instances join paths using (path_id) where version_num={VERSION} and dir_path='/LARGE/{DIRECTORY}'")(lambda c: search.paths_in_directory(c, VERSION, f"/LARGE/{DIRECTORY}"))
on_catalog("latest_by_path_projection", "select path_id, latest_version_num from latest_by_path")(lambda c: c.latest_by_path)

_FEW = "(select * from versions where version_num<=4)"
on_catalog("dict_inner_lookup", f"select path_id, version_num, version_id from file_instances join {_FEW} using (version_num)")(lambda c: lookups.inner(c.file_instances, c.versions.where("version_num <= 4"), "version_num", ["version_id"]).select("path_id", "version_num", "version_id"))
on_catalog("dict_left_lookup", f"select path_id, version_num, version_id from file_instances left join {_FEW} using (version_num)")(lambda c: lookups.left(c.file_instances, c.versions.where("version_num <= 4"), "version_num", ["version_id"]).select("path_id", "version_num", "version_id"))
on_catalog("dict_semi", f"select path_id, version_num from file_instances where version_num in (select version_num from {_FEW})")(lambda c: lookups.known(c.file_instances, c.versions.where("version_num <= 4"), "version_num").select("path_id", "version_num"))
on_catalog("new_paths_antijoin", "select path_id, absolute_path from paths where path_id in (select path_id from file_instances where version_num=7) and path_id not in (select path_id from file_instances where version_num=1)")(lambda c: versioning.new_paths(c.paths.join(c.file_instances.where("version_num = 7").select("path_id"), "path_id", "left_semi"), c.file_instances.where("version_num = 1")))
on_catalog("new_versions_antijoin", "select version_num, version_id from versions where version_num not in (2,5)")(lambda c: versioning.new_versions(c.versions, c.versions.where("version_num in (2, 5)")).select("version_num", "version_id"))
_TWICE = "select path_id, absolute_path p from paths union all select path_id, '/a' || absolute_path from paths"


@on_catalog("paths_upsert", f"select path_id, max(p) absolute_path from ({_TWICE}) where path_id % 3 <> 0 group by 1")
def _upsert(c):
    """Paths that the table lacks, one row an id of several."""
    rows = c.paths.select("path_id", "absolute_path")
    twice = rows.unionByName(rows.select("path_id", F.concat(F.lit("/a"), "absolute_path").alias("absolute_path")))
    return versioning.new_paths(twice, rows.where("path_id % 3 = 0"))


on_catalog("path_derived_columns", "select path_id, path_lc, file_name, file_name_lc, dir_path, dir_name, dir_name_lc from paths")(lambda c: c.paths.drop("absolute_path"))
on_catalog("path_depth", "select path_id, cast(len(list_filter(string_split(absolute_path,'/'), lambda s: s<>'')) as bigint) depth from paths")(lambda c: c.paths.select("path_id", paths.depth(F.col("absolute_path")).alias("depth")))


def _read(spark, sf_dir, name):
    """One table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("url_path_columns", r"select page_id, lower(url) path_lc, regexp_extract(url,'[^/]+$') file_name, lower(regexp_extract(url,'[^/]+$')) file_name_lc, regexp_replace(url,'/[^/]+$','') dir_path, regexp_extract(regexp_replace(url,'/[^/]+$',''),'[^/]+$') dir_name, lower(regexp_extract(regexp_replace(url,'/[^/]+$',''),'[^/]+$')) dir_name_lc from pages")
def _url_paths(spark, sf_dir):
    """Path columns of whole urls."""
    return paths.with_path_columns(_read(spark, sf_dir, "pages").select("page_id", "url"), "url").drop("url")


_FW = "case p_size % 4 when 0 then '/S/Frameworks/' || p_brand || '.framework/' || p_type || '.h' when 1 then '/S/Private/' || p_type || '.h' when 2 then '/S/Frameworks' else '/S/Frameworks/' || p_brand || '/Frameworks/x.h' end"


@query("framework_name", f"with p as (select p_partkey path_id, {_FW} p from part), s as (select path_id, list_filter(string_split(p,'/'), lambda x: x<>'') parts from p) select path_id, case when list_position(parts,'Frameworks')>0 then regexp_replace(parts[list_position(parts,'Frameworks')+1],'\\.framework$','') end framework from s")
def _framework(spark, sf_dir):
    """Framework names of composed paths."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path_id"), paths.framework_name(F.expr(_FW)).alias("framework"))


_REL = "case p_size % 5 when 0 then cast(p_size as {t}) when 1 then cast(p_size as {t}) || '.' || cast(p_partkey % 10 as {t}) when 2 then cast(p_size as {t}) || '.b' when 3 then cast(p_size as {t}) || '.2.' || cast(p_partkey % 3 as {t}) else p_type || '.1' end"


@query("version_sort_key", f"select p_partkey id, list_transform(string_split({_REL.format(t='varchar')},'.'), lambda x: case when regexp_full_match(x,'[0-9]+') then cast(x as bigint) else -1 end) sort_key from part")
def _sort_key(spark, sf_dir):
    """Sort keys of composed releases."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), versions.sort_key(F.expr(_REL.format(t="string"))).alias("sort_key"))


_FOUND = "select distinct cast(p_size as {t}) || '.' || cast(p_partkey % 4 as {t}) release_, 'B' || p_brand build, 'b' || cast(p_size as {t}) bundle_name from part"
_EXISTING = "select 7 version_num, '10.0|BBrand#11' version_id union all select 9, '1.5|X'"


@query("assign_version_numbers", f"""with found as (select *, release_ || '|' || build version_id, list_transform(string_split(release_,'.'), lambda x: cast(x as bigint)) k from ({_FOUND.format(t='varchar')})),
held as ({_EXISTING}), j as (select found.*, held.version_num known from found left join held using (version_id))
select {L("coalesce(known, 9 + row_number() over (partition by known is null order by k, build, bundle_name))")} version_num, version_id, bundle_name from j""")
def _assign(spark, sf_dir):
    """Numbers of composed releases beside two existing ones."""
    part = _read(spark, sf_dir, "part")
    found = part.select(F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string")).alias("release"), F.concat(F.lit("B"), "p_brand").alias("build"), F.concat(F.lit("b"), F.col("p_size").cast("string")).alias("bundle_name")).distinct()
    existing = spark.createDataFrame([(7, "10.0|BBrand#11"), (9, "1.5|X")], "version_num long, version_id string")
    return versioning.assign_numbers(found, existing, allow_old=True).select("version_num", "version_id", "bundle_name")


_IDS = "p_brand || '|' || replace(p_name,' ','_') || '|' || p_type"
@query("version_url_codec", f"select p_partkey id, replace(replace({_IDS},'_','__'),'|','_') encoded, {_IDS} decoded from part")  # noqa: E302
def _codec(spark, sf_dir):
    """Version ids to their URL form and back."""
    encoded = versions.encode_for_url(F.expr(_IDS))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), encoded.alias("encoded")).withColumn("decoded", versions.decode_from_url(F.col("encoded")))


_SHOWN = "case p_size % 4 when 0 then p_brand || ' | ' || p_type when 1 then p_brand when 2 then '|' || p_type else p_brand || '|' end"


@query("version_display", f"with v as (select p_partkey id, trim({_SHOWN}) v from part), h as (select id, v, instr(v,'|') bar, trim(split_part(v,'|',1)) a, trim(substr(v, instr(v,'|')+1)) b from v) select id, case when bar=0 then v when a<>'' and b<>'' then a || ' · ' || b when a<>'' then a else b end shown, case when bar=0 or a='' then v else a end label from h")
def _display(spark, sf_dir):
    """Version ids as shown, and their labels."""
    v = F.expr(_SHOWN)
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), versions.display(v).alias("shown"), versions.label(v).alias("label"))


_SIZE = "case when o_orderkey % 11 = 0 then null else cast(o_orderkey as bigint) * o_orderkey * (o_orderkey % 97) end"


@query("human_bytes", f"with s as (select o_orderkey id, {_SIZE} n from orders) select id, case when n is null then 'Size unknown' when n<1024 then cast(n as varchar) || ' B' when n<1048576 then printf('%.0f KB', round_even(n/1024.0,0)) when n<1073741824 then printf('%.1f MB', round_even(n/1048576.0,1)) when n<1099511627776 then printf('%.1f GB', round_even(n/1073741824.0,1)) else printf('%.1f TB', round_even(n/1099511627776.0,1)) end size_text from s")
def _bytes(spark, sf_dir):
    """Sizes as text."""
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), formatting.human_bytes(F.expr(_SIZE)).alias("size_text"))


@query("pills_first_n", f"with c as (select o_custkey id, list_sort(list(o_orderkey)) ks from orders group by 1) select id, ks[1:15] shown, {L('greatest(len(ks)-15,0)')} remaining from c")
def _pills(spark, sf_dir):
    """The first items of a list and how many are left."""
    held = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"))
    return held.select("id", formatting.first_pills(F.col("ks")).alias("shown"), formatting.more_pills(F.col("ks")).alias("remaining"))


_RAW = "case o_orderkey % 5 when 0 then cast(o_orderkey as {t}) when 1 then ' 250 ' when 2 then 'many' when 3 then '-3' else '' end"

_SIDE = "case o_orderkey % 3 when 0 then ' PREV ' when 1 then 'previous' else '' end"


@query("page_arguments", f"with a as (select o_orderkey id, {_RAW.format(t='varchar')} r, {_SIDE} d from orders) select id, {L('case when try_cast(trim(r) as bigint) is null then 100 else least(greatest(try_cast(trim(r) as bigint),10),1000) end')} page_size, case when lower(trim(d))='prev' then 'prev' else 'next' end direction from a")
def _page_args(spark, sf_dir):
    """Page sizes and directions from texts."""
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), formatting.page_size(F.expr(_RAW.format(t="string"))).alias("page_size"), formatting.direction(F.expr(_SIDE)).alias("direction"))


@query("html_escape", "select page_id, replace(replace(replace(replace(replace(url,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;') escaped from pages")
def _escape(spark, sf_dir):
    """Urls with HTML characters escaped."""
    return _read(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("url")).alias("escaped"))


@query("search_cache_key", "select page_id, 'html:search:' || sha1('q=' || url || '|dir=|dcursor=|ddir=next|dsize=100') cache_key from pages")
def _cache_key(spark, sf_dir):
    """Cache keys of searches for urls."""
    return _read(spark, sf_dir, "pages").select("page_id", formatting.search_key(F.col("url"), F.lit(""), F.lit(None).cast("string"), F.lit("next"), F.lit(100)).alias("cache_key"))


_PIECES = "p as (select doc_id, list_filter(list_transform(string_split(text,chr(10)), lambda x, i: case when i<len(string_split(text,chr(10))) then x || chr(10) else x end), lambda x: x<>'') a from documents), u as (select doc_id, unnest(a) s, generate_subscripts(a,1) i from p), k as (select *, lag(s) over (partition by doc_id order by i) before from u), t as (select d.doc_id, coalesce(string_agg(s,'' order by i) filter (before is null or before<>s),'') body from documents d left join k using (doc_id) group by 1)"


def _collapsed(spark, sf_dir):
    """(doc_id, body) without consecutive duplicate lines."""
    return lookups.spread(_read(spark, sf_dir, "documents")).select("doc_id", text.collapse_duplicate_lines(F.col("text").cast("binary")).alias("body"))


@query("collapse_duplicate_lines", f"with {_PIECES} select doc_id, body from t")
def _collapse(spark, sf_dir):
    """Texts without consecutive duplicate lines."""
    return _collapsed(spark, sf_dir).select("doc_id", F.col("body").cast("string").alias("body"))


@query("content_md5", f"with {_PIECES} select doc_id, md5(body) content_hash from t")
def _md5(spark, sf_dir):
    """Hashes of collapsed texts."""
    return _collapsed(spark, sf_dir).select("doc_id", text.content_hash(F.col("body")).alias("content_hash"))


@query("byte_size", f"with {_PIECES} select doc_id, {L('strlen(body)')} byte_size from t")
def _size(spark, sf_dir):
    """Byte sizes of collapsed texts."""
    return _collapsed(spark, sf_dir).select("doc_id", text.byte_size(F.col("body")).alias("byte_size"))


@query("line_split", f"with l as (select doc_id, string_split(text,chr(10)) a from documents), m as (select doc_id, case when a[-1]='' then a[:-2] else a end a from l) select doc_id, {L('generate_subscripts(a,1)')} line_no, unnest(a) line from m")
def _split(spark, sf_dir):
    """All lines of all texts."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_lines(F.col("text"))).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


@query("line_count", f"with l as (select doc_id, string_split(text,chr(10)) a from documents) select doc_id, {L('len(a) - case when a[-1]=chr(0) or len(a[-1])=0 then 1 else 0 end')} line_count from l")
def _lines(spark, sf_dir):
    """Numbers of lines."""
    return _read(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).alias("line_count"))


def _header_lines(spark, sf_dir):
    """(path_id, line_no, line) of composed headers."""
    return headers(spark, sf_dir).select("path_id", F.posexplode(text.split_lines(F.col("text"))).alias("pos", "line")).select("path_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


@query("owner_detect", with_headers("select path_id, line_no, kind owner_kind, owner_name0 owner_name from named where kind is not null", PARSE_SQL))
def _owners(spark, sf_dir):
    """Lines that name an owner."""
    return _header_lines(spark, sf_dir).select("path_id", "line_no", parser.owner_kind(F.col("line")).alias("owner_kind"), parser.owner_name(F.col("line")).alias("owner_name")).where("owner_kind is not null")


@query("property_extract", with_headers("select path_id, line_no, property_name from named where property_name is not null", PARSE_SQL))
def _properties(spark, sf_dir):
    """Lines that declare a property."""
    return _header_lines(spark, sf_dir).select("path_id", "line_no", parser.property_name(F.col("line")).alias("property_name")).where("property_name is not null")


@query("ivar_extract", with_headers("select path_id, line_no, ivar_name from named where ivar_name is not null", PARSE_SQL))
def _ivars(spark, sf_dir):
    """Lines that read as an instance variable."""
    return _header_lines(spark, sf_dir).select("path_id", "line_no", parser.ivar_name(F.col("line")).alias("ivar_name")).where("ivar_name is not null")


@query("selector_extract", with_headers("select path_id, line_no, selector from named where selector is not null", PARSE_SQL))
def _selectors(spark, sf_dir):
    """Lines that declare a method."""
    return _header_lines(spark, sf_dir).select("path_id", "line_no", parser.selector(text.strip(F.col("line"))).alias("selector")).where("selector is not null")


@query("parse_header_symbols", with_headers("select path_id, split_part(held,'|',1) owner_kind, split_part(held,'|',2) owner_name, symbol_type, symbol_key, line_no from declared where not orphaned", PARSE_SQL))
def _parse(spark, sf_dir):
    """All symbols of composed headers."""
    return parser.parse(headers(spark, sf_dir), ["path_id"])


@query("orphan_file_skip", with_headers("select distinct path_id from declared where orphaned", PARSE_SQL))
def _orphans(spark, sf_dir):
    """Headers that are skipped."""
    return parser.orphans(headers(spark, sf_dir), ["path_id"])


_TARGET = 20_000


_KEYED = "src as (select doc_id id, hex(encode('doc/' || cast(doc_id as varchar))) msg from documents)"
_PACKED = f"""sized as (select doc_id, cast(hashed.key % 16 as bigint) shard, strlen(text) n, row_number() over (partition by hashed.key % 16 order by 'doc/' || cast(doc_id as varchar)) rn from documents join hashed on id=doc_id),
walk as (select shard, rn, doc_id, n, 1 pack, 0 at_, case when n>={_TARGET} then 2 else 1 end pack2, case when n>={_TARGET} then 0 else n end used from sized where rn=1
  union all select shard, rn, doc_id, n, pack, at_, case when at_+n>={_TARGET} then pack+1 else pack end, case when at_+n>={_TARGET} then 0 else at_+n end from (
    select s.shard, s.rn, s.doc_id, s.n, case when w.used>0 and w.used+s.n>{_TARGET} then w.pack2+1 else w.pack2 end pack, case when w.used>0 and w.used+s.n>{_TARGET} then 0 else w.used end at_ from walk w join sized s on s.shard=w.shard and s.rn=w.rn+1))"""


@query("pack_offsets", f"with recursive {_KEYED}, {hash_ctes('src', 'msg')}, {_PACKED} select doc_id, printf('packs/v000001/s%03d/p%09d.bin', shard, pack) pack_object_key, cast(at_ as bigint) pack_offset, cast(n as bigint) pack_length from walk")
def _packs(spark, sf_dir):
    """Places of all texts in packs."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.lit(1).cast("long").alias("version_num"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("blob_key"), text.byte_size(F.col("text").cast("binary")).alias("byte_size"))
    return ingest.pack_places(docs, shards=16, pack_bytes=_TARGET).select("doc_id", "pack_object_key", "pack_offset", "pack_length")


@query("shard_assign", f"with {_KEYED}, {hash_ctes('src', 'msg')} select id doc_id, cast(key % 64 as bigint) shard from hashed")
def _shards(spark, sf_dir):
    """Shards of all texts."""
    return _read(spark, sf_dir, "documents").select("doc_id", ids.shard(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).alias("shard"))


@query("blake2b_ids", with_views("select id path_id, cast(case when key >= 9223372036854775808::hugeint then key - 18446744073709551616::hugeint else key end as bigint) hashed_id, cast(key as varchar) unsigned_id from hashed", "src as (select path_id id, hex(encode('path')) || '00' || hex(encode(absolute_path)) msg from paths)", hash_ctes("src", "msg")))
def _ids(spark, sf_dir):
    """Hashed ids of all paths."""
    c = catalog(spark, sf_dir)
    return c.paths.select("path_id", ids.path_id(F.col("absolute_path")).alias("hashed_id")).withColumn("unsigned_id", ids.unsigned(F.col("hashed_id")))


_MATRIX = f"select s.owner_name, s.symbol_type, s.symbol_key, s.line_no, v.version_num, v.version_id, coalesce(list_contains(m.versions, v.version_num), false) as \"exists\", row_number() over (order by lower(s.owner_name), lower(s.symbol_key), s.owner_name, s.symbol_type, s.symbol_key, s.line_no, v.version_num desc) as position from (select distinct owner_name, symbol_type, symbol_key, line_no from symbols where content_id={_CONTENT}) s left join (select owner_name, symbol_type, symbol_key, list_distinct(flatten(list(versions))) versions from presence where path_id={PATH_ID} group by 1,2,3) m using (owner_name, symbol_type, symbol_key), (select distinct version_num, version_id from file_instances join versions using (version_num) where path_id={PATH_ID}) v"
on_catalog("availability_matrix", _MATRIX)(lambda c: view.availability_matrix(c, PATH_ID, _CONTENT))

_LINES = f"lv as (select line_no, list_sort(list_distinct(flatten(list(versions)))) versions from (select distinct owner_name, symbol_type, symbol_key, line_no from symbols where content_id={_CONTENT}) s join (select owner_name, symbol_type, symbol_key, list_distinct(flatten(list(versions))) versions from presence where path_id={PATH_ID} group by 1,2,3) using (owner_name, symbol_type, symbol_key) where line_no>0 group by 1)"


def _line_versions(c):
    """Versions by line of one content."""
    return view.line_versions(view.symbols_with_versions(c, PATH_ID, _CONTENT), types=["a", "n", "r"])


ORACLES["line_versions"] = with_views("select line_no, versions from lv", _LINES)
QUERIES["line_versions"] = lambda spark, sf_dir: _line_versions(catalog(spark, sf_dir))
ORACLES["line_labels"] = with_views("select line_no, list(split_part(version_id,'|',1) order by version_num desc) labels from (select line_no, unnest(versions) version_num from lv) join versions using (version_num) group by 1", _LINES)


@query("line_labels", ORACLES["line_labels"])
def _labels(spark, sf_dir):
    """Release labels by line of one content."""
    c = catalog(spark, sf_dir)
    return view.line_labels(_line_versions(c), search.versions_for_path(c, PATH_ID))


#: A file imports one of the first seven parts (same directory or not) and one that does not exist.
_IMPORTS_SQL = r"""files as (select version_num, version_id, path_id, absolute_path, dir_path, '#import "' || other || '"' || chr(10) || '#include <X/' || file_name || '>' || chr(10) || 'int x;' as text
  from file_instances join versions using (version_num) join paths using (path_id) join (select path_id - 1 rest, file_name other from paths where path_id <= 7) on rest = path_id % 7),
l as (select *, unnest(string_split(text,chr(10))) line, cast(generate_subscripts(string_split(text,chr(10)),1) as bigint) line_no from files),
i as (select *, regexp_extract(line,'^\s*#\s*(?:import|include)\s*[<"]([^>"]+)[>"].*$',1) token from l),
t as (select *, case when token<>'' then dir_path || '/' || regexp_extract(token,'[^/]*$') end target from i),
there as (select distinct version_num, absolute_path target, true as there from file_instances join paths using (path_id)),
linked as (select t.*, coalesce(there, false) linked, '/v/' || url_encode(replace(replace(version_id,'_','__'),'|','_')) || replace(url_encode(target),'%2F','/') link from t left join there using (version_num, target))"""


def _importing(c):
    """Files of all versions with imports, and what there is to import."""
    here = search.instances_with_versions(c).join(c.paths, "path_id")
    names = c.paths.where("path_id <= 7").select((F.col("path_id") - 1).alias("rest"), F.col("file_name").alias("other"))
    files = here.withColumn("rest", F.col("path_id") % 7).join(F.broadcast(names), "rest")  # seven rows
    body = F.concat(F.lit('#import "'), "other", F.lit('"\n#include <X/'), "file_name", F.lit(">\nint x;"))
    return files.select("version_num", "version_id", "absolute_path", body.alias("text")), here


@on_catalog("import_links", "select version_num, absolute_path, line_no, token, target, linked, case when linked then link end href from linked where token<>''", _IMPORTS_SQL)
def _imports(c):
    """Import lines with their targets and links."""
    return view.resolve_imports(*_importing(c)).select("version_num", "absolute_path", "line_no", "token", "target", "linked", "href")


_ESCAPED = "replace(replace(replace(replace(replace({},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;')".format


@on_catalog("render_imports", f"""select version_num, absolute_path, string_agg(case when linked then replace({_ESCAPED('line')}, token, '<a href="' || link || '">' || token || '</a>') else {_ESCAPED('line')} end, chr(10) order by line_no) html, count(*) line_count from linked group by version_num, absolute_path""", _IMPORTS_SQL)
def _render(c):
    """Escaped texts whose imports are links."""
    return view.render(*_importing(c))


@query("utf8_repair", "select doc_id, chr(65533) || text || chr(65533) as text from documents")
def _utf8(spark, sf_dir):
    """Texts with broken bytes around, repaired."""
    docs = _read(spark, sf_dir, "documents")
    broken = F.concat(F.lit(bytes([0xE2, 0x82])), F.col("text").cast("binary"), F.lit(bytes([0xFF])))
    return docs.select("doc_id", text.repair_utf8(broken).alias("text"))


@query("macho_detect", "select p_partkey, (p_partkey % 4 = 0 and p_size % 2 = 0) or (p_partkey % 4 = 1 and p_size % 2 = 1) is_executable from part")
def _macho(spark, sf_dir):
    """Composed binaries: which are executable?"""
    magic = F.element_at(F.array(*[F.unhex(F.lit(m)) for m in ["CFFAEDFE", "FEEDFACF", "7F454C46", "CAFEBABE"]]), (F.col("p_partkey") % 4 + 1).cast("int"))
    kind = F.unhex(F.when(F.col("p_size") % 2 == 0, "02000000").otherwise("00000002"))
    files = _read(spark, sf_dir, "part").select("p_partkey", F.concat(magic, F.unhex(F.lit("00" * 8)), kind).alias("content"))
    return sources.executables(files).select("p_partkey", "is_executable")


_ALL_IDS = "ids as (select path_id, list(version_id order by version_num desc) version_ids from (select distinct path_id, version_num, version_id from file_instances join versions using (version_num)) group by 1)"
_ENTRIES = "select path_id, absolute_path, file_name, dir_path parent_path, dir_name parent_name, cast(null as varchar) framework_name, cast(3 as bigint) path_depth, case when file_size_bytes is null then 'Size unknown' when file_size_bytes<1024 then cast(file_size_bytes as varchar) || ' B' else printf('%.0f KB', round_even(file_size_bytes/1024.0,0)) end file_size_text, version_ids[1:15] version_ids, cast(greatest(len(version_ids)-15,0) as bigint) remaining_versions from files join paths using (path_id, absolute_path) join ids using (path_id)"


@on_catalog("file_entries", _ENTRIES, f"files as ({_LISTING})", _ALL_IDS)
def _entries(c):
    """Listing entries of a whole directory."""
    return view.file_entries(search.files_in_directory(c, VERSION, DIRECTORY, limit=None), pages.version_ids(search.instances_with_versions(c)))


on_catalog("search_service_directories", "select dir_name, min(dir_path) sample_dir_path from paths where starts_with(dir_name_lc,'brand1') group by 1 order by 1 limit 30")(lambda c: pages.run_search(c, " Brand1 ")[0])
on_catalog("search_service_owners", "select * from owners", _HITS)(lambda c: pages.run_search(c, " Brand#1 ")[1])
on_catalog("search_page_owner_versions", "select path_id, version_ids from ids where path_id in (select path_id from owners)", _HITS, _ALL_IDS)(lambda c: pages.search_page(c, keyword="Brand#1").owner_versions)
_LAST_FILES = f"files as (select distinct path_id, absolute_path, pack_length file_size_bytes from file_instances join paths using (path_id) left join contents using (content_id) where version_num=(select max(version_num) from versions) and dir_name='{DIRECTORY}' order by absolute_path limit {PAGE})"
on_catalog("search_page_entries", _ENTRIES, _LAST_FILES, _ALL_IDS)(lambda c: pages.search_page(c, directory=DIRECTORY, page_size=PAGE).entries)


@on_catalog("search_page_counts", f"select (select count(distinct dir_name) from paths) n_directories, (select count(distinct owner_name_lc) from presence where owner_name_lc<>'') n_owners, (select count(*) from paths where dir_name='{DIRECTORY}') n_paths")
def _page_counts(c):
    """The counts of a search page in directory mode."""
    page = pages.search_page(c, directory=DIRECTORY, page_size=PAGE)
    return page.n_directories.join(page.n_owners).join(page.n_paths)  # one row each


def _view(c):
    """The page of one file in one version."""
    return pages.view_page(c, "1997.0|B3", testviews.path_text(c, PATH_ID))


on_catalog("view_page_versions", f"select distinct version_num, version_id from file_instances join versions using (version_num) where path_id={PATH_ID}")(lambda c: _view(c).versions)
on_catalog("view_page_matrix", _MATRIX)(lambda c: _view(c).matrix)
on_catalog("view_page_source", f"select cast({VERSION} as bigint) version_num, absolute_path, {_ESCAPED('text')} html, cast(len(string_split(text, chr(10))) as bigint) line_count from headers join paths using (path_id) where path_id={PATH_ID}", HEADERS_SQL)(lambda c: _view(c).source)


@query("url_quote", "select page_id, url_encode(url) quoted from pages")
def _quote(spark, sf_dir):
    """Percent-encoding of whole urls."""
    return _read(spark, sf_dir, "pages").select("page_id", paths.quote(F.col("url")).alias("quoted"))


_LOOSE = "case p_size % 4 when 0 then '  /' || p_type when 1 then p_type || '/' || p_brand || {tab} when 2 then ' ///' || p_brand || ' ' else p_type end"


@query("path_normalise", f"select p_partkey id, '/' || ltrim(trim({_LOOSE.format(tab='chr(9)')}, ' ' || chr(9)), '/') path from part")
def _normalise(spark, sf_dir):
    """One leading slash, no white space around."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), paths.absolute(F.expr(_LOOSE.format(tab="char(9)"))).alias("path"))


_STAMP = "2024-01-0{} 00:00:00"


@on_catalog("presence_updated_at", f"select path_id, owner_kind, owner_name, symbol_type, symbol_key, case when list_max(versions)>=3 then timestamp '{_STAMP.format(2)}' else timestamp '{_STAMP.format(1)}' end updated_at from presence")
def _updated(c):
    """Merged rows keep the later time."""
    made = [presence.build(c, c.versions.where(x).select("version_num")).withColumn("updated_at", F.lit(_STAMP.format(day)).cast("timestamp_ntz")) for day, x in ((1, "version_num <= 4"), (2, "version_num >= 3"))]
    return presence.merge(*made).drop("word", "bits", "owner_name_lc")


@query("tree_scan", with_tree("select bundle_name, absolute_path, cast(strlen(text) as bigint) n_bytes, md5(text) md5 from texts"))
def _tree_scan(spark, sf_dir):
    """All headers of a written tree."""
    return treeviews.scanned(spark, sf_dir)


@query("tree_first_files", with_tree("select bundle_name, substr(absolute_path, 2) relative_path from (select *, row_number() over (partition by bundle_name order by absolute_path) rn from texts) where rn<=4"))
def _tree_first(spark, sf_dir):
    """The first four headers of each bundle, by path."""
    return treeviews.first_files(spark, sf_dir, 4)


@query("tree_releases", with_tree("select bundle_name, release, build from releases"))
def _tree_releases(spark, sf_dir):
    """Bundles by folder, and their metadata by the chain of fallbacks."""
    return treeviews.releases(spark, sf_dir)


@query("ingest_files", with_tree("select version_num, release || '|' || build version_id, bundle_name, absolute_path, md5(body) content_hash, cast(strlen(body) as bigint) byte_size, max(version_num) over (partition by absolute_path) latest_version_num, body from good"))
def _ingest_files(spark, sf_dir):
    """What an import of the tree has stored of each file."""
    c = treeviews.imported(spark, sf_dir)
    rows = search.instances_with_versions(c).join(c.paths.select("path_id", "absolute_path"), "path_id").join(c.latest_by_path.select("path_id", "latest_version_num"), "path_id")
    rows = rows.join(c.contents.select("version_num", "content_id", "content_hash", "byte_size"), ["version_num", "content_id"]).join(c.blobs.select("version_num", "content_id", "body"), ["version_num", "content_id"])
    return rows.select("version_num", "version_id", "bundle_name", "absolute_path", "content_hash", "byte_size", "latest_version_num", F.col("body").cast("string").alias("body"))


@query("ingest_symbols", with_tree("select version_num, absolute_path, 'interface' owner_kind, brand owner_name, 'instance_method' symbol_type, regexp_extract(line, '(m[0-9]+);', 1) symbol_key, cast(line_no as bigint) line_no, [version_num] versions from (select *, unnest(string_split(body, chr(10))) line, generate_subscripts(string_split(body, chr(10)), 1) line_no from good) where starts_with(line, '-')"))
def _ingest_symbols(spark, sf_dir):
    """What an import of the tree has stored of each symbol, with its presence."""
    c = treeviews.imported(spark, sf_dir)
    rows = c.symbols.join(c.file_instances.select("version_num", "content_id", "path_id"), ["version_num", "content_id"]).join(c.paths.select("path_id", "absolute_path"), "path_id")
    rows = rows.join(presence.sets(c.symbol_presence), presence.KEY)
    return rows.select("version_num", "absolute_path", "owner_kind", "owner_name", "symbol_type", "symbol_key", "line_no", "versions")


@query("ingest_again", with_tree("select absolute_path, owner_name, symbol_key, list_sort(list(version_num)) versions, max(max(version_num)) over (partition by absolute_path) latest_version_num from (select version_num, absolute_path, brand owner_name, regexp_extract(unnest(string_split(body, chr(10))), '(m[0-9]+);', 1) symbol_key from good where bundle_name <> 'B0__x' or block = 0) where symbol_key <> '' group by 1, 2, 3"))
def _ingest_again(spark, sf_dir):
    """What is left of each symbol and path when a bundle has come again with fewer files."""
    c = treeviews.imported_again(spark, sf_dir)
    rows = presence.sets(c.symbol_presence).join(c.paths.select("path_id", "absolute_path"), "path_id").join(c.latest_by_path.select("path_id", "latest_version_num"), "path_id")
    return rows.select("absolute_path", "owner_name", "symbol_key", "versions", "latest_version_num")


@query("view_blob", with_tree("select version_num, absolute_path, body from good where absolute_path = (select min(absolute_path) from good)"))
def _view_blob(spark, sf_dir):
    """The bodies of one path in all its versions, read from their packs by range."""
    c = treeviews.imported(spark, sf_dir)
    first = c.paths.join(c.file_instances.select("path_id"), "path_id", "left_semi").groupBy().agg(F.min_by("path_id", "absolute_path").alias("path_id"))
    refs = c.file_instances.join(F.broadcast(first), "path_id").join(c.contents, ["version_num", "content_id"]).join(c.paths.select("path_id", "absolute_path"), "path_id")
    bodies = objects.read_ranges(refs.select("version_num", "absolute_path", "pack_object_key", "pack_offset", "pack_length"), c.objects)
    return bodies.select("version_num", "absolute_path", F.col("body").cast("string").alias("body"))


@query("ingest_versions", with_tree("select cast(version_num as bigint) version_num, release || '|' || build version_id, lower(release || '|' || build) version_id_lc, release, build, bundle_name from releases"))
def _ingest_versions(spark, sf_dir):
    """The releases that an import of the tree has numbered."""
    return treeviews.imported(spark, sf_dir).versions.drop("created_at")


@query("parse_table_function", with_headers("select path_id, split_part(held,'|',1) owner_kind, split_part(held,'|',2) owner_name, symbol_type, symbol_key, line_no from declared where not orphaned", PARSE_SQL))
def _parse_udtf(spark, sf_dir):
    """All symbols of composed headers, by the table function."""
    text_of = headers(spark, sf_dir)
    return text_of.lateralJoin(parser.ParseHeader(F.col("text").outer())).drop("text")


_TSV = "case when {c} is null then '\\N' else replace(replace(replace(replace({c}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') end".format


@query("tsv_lines", f"select {_TSV(c='cast(doc_id as varchar)')} || chr(9) || {_TSV(c='lang')} || chr(9) || {_TSV(c='text')} as line from documents")
def _tsv(spark, sf_dir):
    """All documents as tab-separated lines, written and read again."""
    out = f"{treeviews.folder(spark)}/tsv"
    sources.write_tsv(_read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), out)
    return spark.read.text(out).select(F.col("value").alias("line"))


@query("skip_upload_places", with_tree("select version_num, release || '|' || build || '/' || substr(absolute_path, 2) pack_object_key, cast(0 as bigint) pack_offset, cast(strlen(body) as bigint) pack_length from good"))
def _skip_upload(spark, sf_dir):
    """Where contents of an import without packs say that they lie."""
    return treeviews.imported(spark, sf_dir, skip_upload=True).contents.select("version_num", "pack_object_key", "pack_offset", "pack_length")


@query("run_counters", "select count(*) total, count(*) filter (l_linestatus='F') succeeded, count(*) filter (l_returnflag='A' and l_linestatus<>'F') skipped, count(*) filter (l_returnflag<>'A' and l_linestatus<>'F') failed from lineitem")
def _counters(spark, sf_dir):
    """Outcomes of jobs, counted."""
    status = F.when(F.col("l_linestatus") == "F", "succeeded").when(F.col("l_returnflag") == "A", "skipped").otherwise("failed")
    return sources.run_counters(_read(spark, sf_dir, "lineitem").select(status.alias("status")))


@query("stream_import", with_tree("select version_num, absolute_path, md5(body) content_hash from good where bundle_name in ('B0__x', 'B2__x')"))
def _stream(spark, sf_dir):
    """What a stream of bundles in parts has imported: two bundles are whole, of the others a part is missing."""
    c = treeviews.streamed(spark, sf_dir)
    rows = c.file_instances.join(c.contents.select("version_num", "content_id", "content_hash"), ["version_num", "content_id"]).join(c.paths.select("path_id", "absolute_path"), "path_id")
    named = c.versions.select("version_num", F.substring("bundle_name", 2, 1).cast("long").alias("bundle"))
    return rows.join(F.broadcast(named), "version_num").select((F.col("bundle") + 1).alias("version_num"), "absolute_path", "content_hash")
