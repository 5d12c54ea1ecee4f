"""Declaration headers to symbols.

Each line is first read on its own: does it name an owner, end one, open or close a
block, declare something?  Only lines that do any of that go on, as narrow rows.
An owner or a block holds until the next event, so two running windows over the
lines of a file give every declaration its context, and a third sees whether some
declaration of the file has no owner, in which case the whole file yields nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from verdex.functions.text import WHITE, split_lines, strip
from verdex.operators.lookups import spread

#: Fixed patterns of the declaration language; \s is Unicode-aware by (?U), names are ASCII.
NAME = "[A-Za-z_][A-Za-z0-9_]*"
CATEGORY = rf"(?U)^\s*@interface\s+({NAME})\s*\(\s*[^)]*\s*\)"
INTERFACE = rf"(?U)^\s*@interface\s+({NAME})"
OWNER = rf"(?U)^\s*@(?:interface|protocol)\s+({NAME})"
PROTOCOL = rf"(?U)^\s*@protocol\s+({NAME})"
PROPERTY = rf"(?U)^\s*@property\b.*\b({NAME})\s*;\s*$"
IVAR = rf"({NAME})$"
METHOD = r"(?U)^[+-]\s*\([^)]*\)\s*(.*);\s*$"
PART = rf"(?U)({NAME})\s*:"


def owner_kind(line: Column) -> Column:
    """category, interface or protocol where the line names one."""
    interface = line.contains("@interface")
    return F.when(interface & line.rlike(CATEGORY), "category").when(interface & line.rlike(INTERFACE), "interface").when(line.contains("@protocol") & line.rlike(PROTOCOL), "protocol")


def owner_name(line: Column) -> Column:
    """The name after @interface or @protocol."""
    return F.nullif(F.regexp_extract(line, OWNER, 1), F.lit(""))


def property_name(line: Column) -> Column:
    """The last name before the semicolon that ends a property line."""
    return F.when(line.contains("@property") & line.contains(";"), F.nullif(F.regexp_extract(line, PROPERTY, 1), F.lit("")))


def ivar_name(line: Column) -> Column:
    """The last name before the last semicolon; comments and methods have none."""
    tail = F.substring_index(line, ";", -1)
    before = F.rtrim(F.left(line, F.length(line) - F.length(tail) - 1), F.lit(WHITE))
    lead = F.ltrim(line, F.lit(WHITE))
    method = line.contains("(") & line.contains(")") & (lead.startswith("+") | lead.startswith("-"))
    return F.when(line.contains(";") & ~lead.startswith("/*") & ~method, F.nullif(F.regexp_extract(before, IVAR, 1), F.lit("")))


def selector(line: Column) -> Column:
    """``a:b:`` for a method with arguments, else its first name; null if there is no return type."""
    tail = F.regexp_extract(line, METHOD, 1)
    parts = F.regexp_extract_all(tail, F.lit(PART), 1)
    joined = F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit(":"))), "")
    head = F.nullif(F.regexp_extract(tail, rf"^({NAME})", 1), F.lit(""))
    return F.when(line.rlike(METHOD), F.when(F.size(parts) > 0, joined).otherwise(head))


def line_facts(headers: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., line_no, owner, block, property, ivar, method...) of the lines that say anything.

    Cheap tests on the trimmed line come first: only a line that starts with ``@``, is
    a brace or holds a semicolon can say anything, and patterns run on the lines that fit them.
    """
    lines = spread(headers.select(*key, text)).select(*key, F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    line, bare = F.col("line"), F.col("bare")
    brace, at = bare.isin("{", "}"), bare.startswith("@")
    lines = lines.withColumn("bare", strip(line)).where(at | brace | bare.contains(";"))
    lines = lines.withColumn("kind", F.when(at, owner_kind(line))).withColumn("ends", F.col("kind").isNull() & bare.startswith("@end"))
    event = F.col("kind").isNotNull() | F.col("ends") | brace
    marks = lines.select(
        *key,
        (F.col("pos") + 1).cast("long").alias("line_no"),
        # An owner event with null fields clears the owner.
        F.when(F.col("kind").isNotNull(), F.struct(F.col("kind").alias("kind"), owner_name(line).alias("name"))).when(F.col("ends"), F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"))).alias("owner"),
        F.when(F.col("kind").isNotNull(), line.contains("{")).when(F.col("ends"), F.lit(False)).when(brace, bare == "{").alias("block"),
        F.when(~event & at, property_name(line)).alias("property"),
        F.when(~event, ivar_name(line)).alias("ivar"),
        F.when(~event & F.substring(bare, 1, 1).isin("+", "-") & bare.endswith(";"), selector(bare)).alias("method"),
        F.when(bare.startswith("+"), "class_method").otherwise("instance_method").alias("method_type"),
    )
    return marks.where("owner is not null or block is not null or property is not null or ivar is not null or method is not null")


def declarations(headers: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Every declaration with its owner (null if it has none) and whether its file has one without."""
    so_far = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = line_facts(headers, key, text)
    rows = rows.withColumn("held", F.last("owner", True).over(so_far)).withColumn("inside", F.coalesce(F.last("block", True).over(so_far), F.lit(False)))
    found = F.when(F.col("property").isNotNull(), F.struct(F.lit("property").alias("type"), F.col("property").alias("name")))
    found = found.when(F.col("inside") & F.col("ivar").isNotNull(), F.struct(F.lit("ivar").alias("type"), F.col("ivar").alias("name")))
    found = found.when(F.col("method").isNotNull(), F.struct(F.col("method_type").alias("type"), F.col("method").alias("name")))
    rows = rows.withColumn("found", found).where("found is not null")
    rows = rows.select(*key, F.col("held.kind").alias("owner_kind"), F.col("held.name").alias("owner_name"), F.col("found.type").alias("symbol_type"), F.col("found.name").alias("symbol_key"), "line_no")
    return rows.withColumn("orphaned", F.max(F.col("owner_kind").isNull()).over(Window.partitionBy(*key)))


def parse(headers: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., owner_kind, owner_name, symbol_type, symbol_key, line_no) of files without ownerless declarations."""
    return declarations(headers, key, text).where("not orphaned").drop("orphaned")


def orphans(headers: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Keys of the files that are skipped."""
    return declarations(headers, key, text).where("orphaned").select(*key).distinct()


@udtf(returnType="owner_kind string, owner_name string, symbol_type string, symbol_key string, line_no bigint")
class ParseHeader:
    """The same parse as a table function over one text, one line after the other; tests hold both against each other."""

    def eval(self, text: str):
        owner, inside, rows = None, False, []
        for number, line in enumerate((text or "").splitlines(), 1):
            bare = line.strip()
            named = next(((k, m[1]) for k, p in (("category", CATEGORY), ("interface", INTERFACE), ("protocol", PROTOCOL)) if (m := re.match(p[4:], line))), None)
            if named:
                owner, inside = named, "{" in line
            elif bare.startswith("@end"):
                owner, inside = None, False
            elif bare in ("{", "}"):
                inside = bare == "{"
            elif found := self.declared(line, bare, inside):
                if owner is None:
                    return
                rows.append((*owner, *found, number))
        yield from rows

    @staticmethod
    def declared(line: str, bare: str, inside: bool):
        if m := re.match(PROPERTY[4:], line):
            return "property", m[1]
        method = bare[:1] in ("+", "-")
        if inside and ";" in line and not bare.startswith("/*") and not (method and "(" in line and ")" in line):
            if m := re.search(IVAR, line.rpartition(";")[0].rstrip()):
                return "ivar", m[1]
        if method and bare.endswith(";") and (m := re.match(METHOD[4:], bare)):
            parts = re.findall(PART[4:], m[1])
            head = re.match(NAME, m[1])
            name = "".join(f"{p}:" for p in parts) or (head[0] if head else None)
            if name:
                return ("class_method" if bare[0] == "+" else "instance_method"), name
        return None
