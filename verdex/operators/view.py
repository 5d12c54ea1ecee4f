"""What a page about one file shows: availability, line annotations, import links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdex import schemas
from verdex.functions import paths as P
from verdex.functions import versions as V
from verdex.functions.formatting import first_pills, human_bytes, more_pills
from verdex.functions.text import html_escape, split_lines, strip
from verdex.operators import search
from verdex.sources.catalog import Catalog

#: Order of symbol types in the matrix.  The method kinds are spelt with a space,
#: stored with an underscore, and so share the last place unless that is mended.
TYPE_ORDER = {"ivar": 0, "property": 1, "class method": 2, "instance method": 3}


def type_rank(symbol_type: Column, mend_methods: bool = False) -> Column:
    ranks = F.create_map(*[F.lit(x) for kind, at in TYPE_ORDER.items() for x in (kind, at)])
    kind = F.lower(strip(symbol_type))
    return F.coalesce(ranks[F.replace(kind, F.lit("_"), F.lit(" ")) if mend_methods else kind], F.lit(len(TYPE_ORDER)))


def symbols_with_versions(c: Catalog, path_id: int, content_id: int) -> DataFrame:
    """The content's symbols, each with the versions of the path that have it."""
    return search.symbols_for_content(c, content_id).join(search.presence_map(c, path_id), ["owner_name", "symbol_type", "symbol_key"], "left")


def availability_matrix(c: Catalog, path_id: int, content_id: int, mend_methods: bool = False) -> DataFrame:
    """A row for each symbol and version of the path: does the version have it?  Rows are numbered in display order."""
    held = F.sort_array(F.collect_list(F.struct("version_num", "version_id")), asc=False)
    states = search.versions_for_path(c, path_id).agg(held.alias("held"))
    order = [type_rank(F.col("symbol_type"), mend_methods), F.lower("owner_name"), F.lower("symbol_key"), F.col("owner_name"), F.col("symbol_type"), F.col("symbol_key"), F.col("line_no")]
    rows = symbols_with_versions(c, path_id, content_id).crossJoin(F.broadcast(states))  # states is one row
    rows = rows.select("owner_name", "symbol_type", "symbol_key", "line_no", "versions", F.explode("held").alias("v"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    exists = F.coalesce(F.array_contains("versions", F.col("v.version_num")), F.lit(False))
    rows = rows.select("owner_name", "symbol_type", "symbol_key", "line_no", F.col("v.version_num").alias("version_num"), F.col("v.version_id").alias("version_id"), exists.alias("exists"), "o0", "o1", "o2")
    # The symbols of one content: a page's worth of rows in one window.
    shown = Window.orderBy("o0", "o1", "o2", "owner_name", "symbol_type", "symbol_key", "line_no", F.desc("version_num"))
    return rows.withColumn("position", F.row_number().over(shown).cast("long")).drop("o0", "o1", "o2").orderBy("position")


def line_versions(symbols: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(line_no, versions): the union over the symbols of each line."""
    kinds = schemas.SYMBOL_TYPES if types is None else types
    rows = symbols.where((F.col("line_no") > 0) & F.lower(strip(F.col("symbol_type"))).isin(kinds) & (F.size("versions") > 0))
    return rows.groupBy("line_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("versions")))).alias("versions"))


def line_labels(lines: DataFrame, versions: DataFrame) -> DataFrame:
    """(line_no, labels): release labels of the line's versions, newest first, each once; only given versions count."""
    held = lines.select("line_no", F.explode("versions").alias("version_num")).join(versions.select("version_num", "version_id"), "version_num")
    ordered = F.sort_array(F.collect_list(F.struct("version_num", V.label(F.col("version_id")).alias("label"))), asc=False)
    labels = F.filter(F.array_distinct(F.transform(ordered, lambda v: v["label"])), lambda x: x != "")
    return held.groupBy("line_no").agg(labels.alias("labels")).where(F.size("labels") > 0)


#: Fixed pattern of an import line.
IMPORT = r"""^(\s*#\s*(?:import|include)\s*[<"])([^>"]+)([>"].*)$"""


def import_lines(files: DataFrame, key: list[str], path: str = "absolute_path", text: str = "text", only: bool = False) -> DataFrame:
    """(key..., line_no, line, prefix, token, suffix, target): the target is the imported file's name in the same directory.

    ``only`` leaves out other lines; those without a number sign go before they become rows.
    """
    each = F.transform(split_lines(F.col(text)), lambda line, at: F.struct(at.alias("pos"), line.alias("line")))
    if only:
        each = F.filter(each, lambda x: F.contains(x["line"], F.lit("#")))
    directory = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    directory = F.when((directory == "") & F.col(path).startswith("/"), "/").otherwise(directory)  # once a file
    lines = files.select(*key, directory.alias("__dir"), F.explode(each).alias("at"))
    part = [F.nullif(F.regexp_extract("line", IMPORT, i), F.lit("")) for i in (1, 2, 3)]
    lines = lines.select(*key, "__dir", (F.col("at.pos") + 1).cast("long").alias("line_no"), F.col("at.line").alias("line"))
    if only:
        lines = lines.where(F.col("line").rlike(IMPORT))
    lines = lines.select(*key, "__dir", "line_no", "line", part[0].alias("prefix"), part[1].alias("token"), part[2].alias("suffix"))
    base = P.base_name(strip(F.col("token")))
    return lines.withColumn("target", F.when(F.col("token").isNotNull(), F.when(F.col("__dir") != "", F.concat("__dir", F.lit("/"), base)).otherwise(F.concat(F.lit("/"), base)))).drop("__dir")


def view_link(version_id: Column, absolute_path: Column) -> Column:
    return F.concat(F.lit("/v/"), P.quote(V.encode_for_url(version_id)), F.lit("/"), P.quote_path(absolute_path))


def resolve_imports(files: DataFrame, present: DataFrame) -> DataFrame:
    """Import lines of (version_num, version_id, absolute_path, text) files with the link of those whose target is in the same version.

    ``present`` has each (version_num, absolute_path) once.
    """
    lines = import_lines(files, ["version_num", "version_id", "absolute_path"], only=True)
    there = present.select("version_num", F.col("absolute_path").alias("target"), F.lit(True).alias("linked"))
    out = lines.join(there, ["version_num", "target"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return out.withColumn("href", F.when(F.col("linked"), view_link(F.col("version_id"), F.col("target"))))


def render(files: DataFrame, present: DataFrame) -> DataFrame:
    """(version_num, absolute_path, html, line_count): escaped text whose resolvable imports are links; ``present`` as above."""
    key = ["version_num", "version_id", "absolute_path"]
    lines = import_lines(files, key)
    there = present.select("version_num", F.col("absolute_path").alias("target"), F.lit(True).alias("linked"))
    lines = lines.join(there, ["version_num", "target"], "left")
    link = F.concat(html_escape(F.col("prefix")), F.lit('<a href="'), html_escape(view_link(F.col("version_id"), F.col("target"))), F.lit('">'), html_escape(F.col("token")), F.lit("</a>"), html_escape(F.col("suffix")))
    lines = lines.withColumn("html", F.when(F.col("linked"), link).otherwise(html_escape(F.col("line"))))
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "html")))
    return lines.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["html"]), "\n").alias("html"), F.count(F.lit(1)).alias("line_count")).drop("version_id")


def file_entries(refs: DataFrame, version_ids: DataFrame) -> DataFrame:
    """Listing entries of file references: names, framework, depth, size text and version pills."""
    bare = F.regexp_replace("absolute_path", "/+$", "")
    rows = refs.join(version_ids, "path_id", "left").withColumn("__p", bare)
    ids = F.coalesce("version_ids", F.array().cast("array<string>"))
    above = P.parent(F.col("__p"))
    name = P.base_name(F.col("__p"))
    return rows.select(
        "path_id",
        "absolute_path",
        F.when(name != "", name).otherwise(F.col("absolute_path")).alias("file_name"),
        F.when(above != "", above).otherwise("/").alias("parent_path"),
        F.when(F.coalesce(P.base_name(F.regexp_replace(above, "/+$", "")), F.lit("")) != "", P.base_name(F.regexp_replace(above, "/+$", ""))).otherwise("/").alias("parent_name"),
        P.framework_name(F.col("__p")).alias("framework_name"),
        P.depth(F.col("__p")).alias("path_depth"),
        human_bytes(F.col("file_size_bytes")).alias("file_size_text"),
        first_pills(ids).alias("version_ids"),
        more_pills(ids).alias("remaining_versions"),
    )
