"""Text normalisation: native column expressions, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of lines as str.splitlines knows them.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


#: The characters that count as white space in Unicode, and the four information separators.
WHITE = "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Unicode-aware trim."""
    return F.btrim(col, F.lit(WHITE))


def normalise_keyword(col: Column) -> Column:
    return F.lower(strip(col))


#: At the start of a line (not between CR and LF): the line with its end, then the same line again.
REPEATED = r"(?<![^\r\n])(?!(?<=\r)\n)([^\r\n]*+(?:\r\n|\n|\r(?!\n)))(?:\1(?!(?<=\r)\n))++"


def collapse_duplicate_lines(content: Column) -> Column:
    """Drop each line of a binary that equals the line before it, line end included.

    Bytes are read as ISO-8859-1, which maps them one to one.  One pass: a whole line
    with its end, and as often as it follows itself; possessive, so nothing is retried.
    """
    return F.encode(F.regexp_replace(F.decode(content, "ISO-8859-1"), REPEATED, "$1"), "ISO-8859-1")


def split_lines(text: Column) -> Column:
    """The lines of a text without their ends; no empty line after a final end."""
    lines = F.split(text, LINE_ENDS)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def line_count(text: Column) -> Column:
    return F.size(split_lines(text)).cast("long")


def repair_utf8(content: Column) -> Column:
    """Decode a binary; each maximal invalid part becomes one U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def content_hash(content: Column) -> Column:
    return F.md5(content)


def byte_size(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def html_escape(col: Column) -> Column:
    """The five characters that HTML reserves; the ampersand goes first."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(char), F.lit(name))
    return col
