"""Version ids (``release|build``): ordering, URL form, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdex.functions.text import strip


def sort_key(release: Column) -> Column:
    """The dotted parts as numbers, -1 for parts that are not digits; arrays order like tuples."""
    return F.transform(F.split(release, r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.expr("0") + x.try_cast("long")).otherwise(F.lit(-1).cast("long")))


def encode_for_url(version_id: Column) -> Column:
    return F.replace(F.replace(version_id, F.lit("_"), F.lit("__")), F.lit("|"), F.lit("_"))


def decode_from_url(encoded: Column) -> Column:
    """Read from the left: two underscores are one, a single one is the bar."""
    held = F.replace(encoded, F.lit("__"), F.lit("\u0000"))
    return F.replace(F.replace(held, F.lit("_"), F.lit("|")), F.lit("\u0000"), F.lit("_"))


def _halves(value: Column) -> tuple[Column, Column]:
    at = F.instr(value, "|")
    return strip(F.substring(value, F.lit(1), at - 1)), strip(F.substring(value, at + 1, F.length(value)))


def display(version_id: Column) -> Column:
    """``release · build``, or the half that is there."""
    value = strip(version_id)
    release, build = _halves(value)
    both = F.when((release != "") & (build != ""), F.concat(release, F.lit(" · "), build)).when(release != "", release).otherwise(build)
    return F.when(value.contains("|"), both).otherwise(value)


def label(version_id: Column) -> Column:
    """The release, or the whole id where there is none."""
    value = strip(version_id)
    release, _ = _halves(value)
    return F.when(value.contains("|") & (release != ""), release).otherwise(value)
