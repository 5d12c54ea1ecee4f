"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdex.functions.text import strip


def absolute(path: Column) -> Column:
    """One leading slash, no surrounding white space."""
    return F.concat(F.lit("/"), F.regexp_replace(strip(path), "^/+", ""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def dir_path(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]+$", "")


def dir_name(path: Column) -> Column:
    return F.regexp_extract(dir_path(path), "[^/]+$", 0)


def with_path_columns(df: DataFrame, path: str = "absolute_path") -> DataFrame:
    """Add the columns that the paths table stores beside each path."""
    p = F.col(path)
    df = df.withColumns({"path_lc": F.lower(p), "file_name": file_name(p), "dir_path": dir_path(p)})
    df = df.withColumns({"file_name_lc": F.lower("file_name"), "dir_name": F.regexp_extract("dir_path", "[^/]+$", 0)})
    return df.withColumn("dir_name_lc", F.lower("dir_name"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def depth(path: Column) -> Column:
    return F.size(segments(path)).cast("long")


def base_name(path: Column) -> Column:
    """What follows the last slash; the empty text for a path that ends in one."""
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """What precedes the last slash, without slashes at its end; ``/`` for files of the root."""
    head = F.regexp_extract(path, r"^(?s)(.*/)[^/]*$", 1)
    bare = F.regexp_replace(head, "/+$", "")
    return F.when(F.length(bare) == 0, head).otherwise(bare)


def framework_name(path: Column) -> Column:
    """The segment after the first ``Frameworks``, without ``.framework``; null if there is none."""
    parts = segments(path)
    at = F.array_position(parts, "Frameworks")
    return F.when(at > 0, F.regexp_replace(F.try_element_at(parts, (at + 1).cast("int")), r"\.framework$", ""))


def quote(col: Column) -> Column:
    """Percent-encoding that leaves letters, digits and ``_.-~`` alone."""
    out = F.url_encode(col)
    for was, now in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def quote_path(path: Column) -> Column:
    return F.array_join(F.transform(segments(path), quote), "/")
