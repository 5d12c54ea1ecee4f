"""Presentation values: sizes, lists of pills, page arguments, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PILLS = 15
PAGE_SIZE, PAGE_LEAST, PAGE_MOST = 100, 10, 1000


def human_bytes(size: Column) -> Column:
    """A size in its largest unit up to TB; halves round to even."""
    out = F.when(size.isNull(), F.lit("Size unknown")).when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    value = size.cast("double")
    out = out.when(size < 1024**2, F.concat(F.format_string("%.0f", F.bround(value / 1024, 0)), F.lit(" KB")))
    out = out.when(size < 1024**3, F.concat(F.format_string("%.1f", F.bround(value / 1024**2, 1)), F.lit(" MB")))
    out = out.when(size < 1024**4, F.concat(F.format_string("%.1f", F.bround(value / 1024**3, 1)), F.lit(" GB")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(value / 1024**4, 1)), F.lit(" TB")))


def first_pills(items: Column, most: int = PILLS) -> Column:
    return F.slice(items, 1, most)


def more_pills(items: Column, most: int = PILLS) -> Column:
    return F.greatest(F.size(items) - most, F.lit(0)).cast("long")


def page_size(raw: Column) -> Column:
    """A page size from text: the default where it is no number, clamped otherwise."""
    number = F.when(F.regexp_like(raw, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(raw).try_cast("long"))
    # greatest() passes over nulls, so a missing number is told apart first.
    return F.when(number.isNull(), F.lit(PAGE_SIZE)).otherwise(F.least(F.greatest(number, F.lit(PAGE_LEAST)), F.lit(PAGE_MOST))).cast("long")


def direction(raw: Column) -> Column:
    return F.when(F.lower(F.trim(raw)) == "prev", "prev").otherwise("next")


def search_key(query: Column, directory: Column, cursor: Column, way: Column, size: Column) -> Column:
    """A stable key of a search page's arguments."""
    payload = F.concat(F.lit("q="), query, F.lit("|dir="), directory, F.lit("|dcursor="), F.coalesce(cursor, F.lit("")), F.lit("|ddir="), way, F.lit("|dsize="), size.cast("string"))
    return F.concat(F.lit("html:search:"), F.sha1(payload.cast("binary")))
