"""Column expressions against Python's own functions."""

import html
import os
from urllib.parse import quote

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdex.functions import formatting, ids, paths, text, versions

PARTS = st.lists(st.sampled_from(["a", "b", "\n", "\r", "\r\n", "a\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " "]), max_size=12).map("".join)
ONCE = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(spark, values, expression, kind="string"):
    return [r[1] for r in column(spark, values, kind).select("i", expression(F.col("v"))).orderBy("i").collect()]


@ONCE
@given(st.lists(PARTS, min_size=20, max_size=40))
def test_split_lines(spark, values):
    assert evaluate(spark, values, text.split_lines) == [v.splitlines() for v in values]


def collapsed(data):
    out = []
    for line in data.splitlines(keepends=True):
        if not out or out[-1] != line:
            out.append(line)
    return b"".join(out)


@ONCE
@given(st.lists(st.lists(st.sampled_from([b"a", b"\n", b"\r", b"\xff", b"a\n", b"b\r\n"]), max_size=10).map(b"".join), min_size=20, max_size=40))
def test_collapse_lines(spark, values):
    got = evaluate(spark, [bytearray(v) for v in values], text.collapse_duplicate_lines, "binary")
    assert [bytes(g) for g in got] == [collapsed(v) for v in values]


def test_collapse_keeps_a_last_line_without_end(spark):
    assert bytes(evaluate(spark, [bytearray(b"a\na\nb\na\na")], text.collapse_duplicate_lines, "binary")[0]) == b"a\nb\na\na"


def test_repair_utf8(spark):
    values = [b"\xe2\x82a", b"ok", b"\xff\xfe", b"\xf0\x9f\x98\x80"]
    assert evaluate(spark, [bytearray(v) for v in values], text.repair_utf8, "binary") == [v.decode("utf-8", "replace") for v in values]


def test_html_escape(spark):
    values = ["<a href=\"x\">'&amp;", ""]
    assert evaluate(spark, values, text.html_escape) == [html.escape(v) for v in values]


def test_paths(spark):
    values = ["/a/b/", "/x.h", "/a/b/c.h", "/S/Frameworks/UIKit.framework/UIView.h", "/S/Frameworks", "/S/Frameworks/Plain/x.h"]
    assert evaluate(spark, values, paths.file_name) == ["", "x.h", "c.h", "UIView.h", "Frameworks", "x.h"]
    assert evaluate(spark, values, paths.dir_path) == ["/a/b/", "", "/a/b", "/S/Frameworks/UIKit.framework", "/S", "/S/Frameworks/Plain"]
    assert evaluate(spark, values, paths.base_name) == [os.path.basename(v) for v in values]
    assert evaluate(spark, values, paths.parent) == [os.path.dirname(v) for v in values]
    assert evaluate(spark, values, paths.framework_name) == [None, None, None, "UIKit", None, "Plain"]
    assert evaluate(spark, ["  //a/b ", "a"], paths.absolute) == ["/a/b", "/a"]


def test_quote(spark):
    values = ["a b~*é/+%", "x_y-z.q", "日本"]
    assert evaluate(spark, values, paths.quote) == [quote(v, safe="") for v in values]


def test_version_codec(spark):
    values = ["15.2|19C56", "a_b|c", "x"]
    encoded = evaluate(spark, values, versions.encode_for_url)
    assert encoded == ["15.2_19C56", "a__b_c", "x"] and evaluate(spark, encoded, versions.decode_from_url) == values
    # Not one to one where a bar meets an underscore.
    assert len(set(evaluate(spark, ["a|_b", "a_|b"], versions.encode_for_url))) == 1


def test_version_display(spark):
    values = ["15.2|19C56", "15.2", " | b", "a|", "", "a|b|c"]
    assert evaluate(spark, values, versions.display) == ["15.2 · 19C56", "15.2", "b", "a", "", "a · b|c"]
    assert evaluate(spark, values, versions.label) == ["15.2", "15.2", "| b", "a", "", "a"]


def test_sort_key(spark):
    assert evaluate(spark, ["9.3", "15.b", "15.2.1", "", "1. 2"], versions.sort_key) == [[9, 3], [15, -1], [15, 2, 1], [-1], [1, -1]]


def test_human_bytes(spark):
    assert evaluate(spark, [None, 512, 2560, 1310720, 1 << 30, 5 << 40], formatting.human_bytes, "long") == ["Size unknown", "512 B", "2 KB", "1.2 MB", "1.0 GB", "5.0 TB"]


def test_page_arguments(spark):
    assert evaluate(spark, ["5", " 250 ", "x", "", None, "99999"], formatting.page_size) == [10, 250, 100, 100, 100, 1000]
    assert evaluate(spark, ["prev", " PREV", "up", None], formatting.direction) == ["prev", "prev", "next", "next"]


def test_ids(spark):
    import hashlib

    values = ["/a/b.h", "/é"]
    expected = [int.from_bytes(hashlib.blake2b(f"path\0{v}".encode(), digest_size=8).digest(), "big") for v in values]
    assert [int(x) for x in evaluate(spark, values, lambda c: ids.unsigned(ids.path_id(c)))] == expected
    seeds = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") % 64 for v in values]
    assert evaluate(spark, values, ids.shard) == seeds
