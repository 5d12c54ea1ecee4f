"""Operator 8: main text of web pages by equivalence classes of template tokens.

A page is cut into tags and texts.  A token is a tag in its role: its element path
with classes and ids, as a 64-bit hash.  Over the pages of a host each token has an occurrence
vector; tokens that occur once a page and have equal vectors form an equivalence
class.  Vectors are compared by their number of pages and two sums of hashed pages,
so they are summed by partial aggregates, a hot host is no larger than another, and
pages that repeat count as often as they do.
A class is valid if it has ``SIZE`` elements at least (the page itself is one) and is on
at least half of the host's pages; valid classes nest by their paths into the host's
template.  What stands between template tokens are slots.

The texts of a role on a page are a token, too, if they are the same wherever the
role occurs, and so is all text within an element.  A slot whose element has the same
text, at any depth, on all pages belongs to the template and holds no data.

Of the slots those are extracted that hold the article: if the template has an
``article`` or ``main`` token, those in it, else all that hold data.  A container's
slot without data, in an article too, is left out only if its text is shorter than the text that
varies on a page, so that crawls of one article with another counter keep it; a
heading or paragraph beside data is kept, though pages share it.  In addition slots
are left out whose tags or class names stand for menus, headers, footers, sidebars,
notices, adverts, forms or reader comments, inline elements too; class names count as a
whole.  Names of headings, paragraphs and items never do; lists and
tables of an article are text, whatever their names and though pages share them.  A part so named around an article or main element does not take it along, unless it is hidden,
holds comments or is a side part: the page has article text elsewhere, and the part
holds several articles or a shorter one.  A page whose host's template does not fit
(none of its article tokens is on the page, or no text is left) is its own template.

Block-level tags end a block; inside a block white space becomes one space.
Null and empty html give the empty text; null urls share one unnamed host.  Rows that
repeat are extracted each for itself; an empty table gives none.  Reading is linear in
the page: no pattern looks back, quotes and tags that are never closed are looked for once.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdex.llm.common import Scratch, append_columns, if_small, map_batches, materialize, slices
from verdex.llm.urlfilter import split_url
from verdex.operators.lookups import spread

TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: In a tag: its end, or a quote that opens a value.
TAG_STOP = re.compile(r">|=\s*([\"'])")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden|aria-hidden\s*=\s*[\"']?true)(?:[\s=>\"']|$)|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.IGNORECASE)

#: Element kinds of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "button", "canvas", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary",
    "svg", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "video", "audio", "object",
}
#: Elements that never hold article text, wherever they stand; headers count outside articles alone.
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "video", "audio", "head", "fieldset", "search"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: Words that make up classes and ids that stand for parts around the article.
AROUND = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "sidebar", "aside", "widget", "related", "recommended", "footer", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "newsletter", "subscribe", "signup",
    "login", "search", "share", "sharing", "social", "comment", "comments", "respond", "disqus", "pagination", "pager", "copyright", "toolbar", "toc",
}
COMMENTS = {"comment", "comments", "respond", "disqus"}
#: Words that may stand beside those in a name, as in site-footer; a name with any other word (has-sidebar, ad-free) stands for something else.
BESIDE = {
    "site", "page", "main", "top", "bottom", "left", "right", "upper", "lower", "primary", "secondary", "global", "local", "mobile", "desktop", "sticky", "header", "area", "bar", "block", "body", "box", "button", "buttons",
    "column", "container", "div", "form", "group", "icons", "inner", "outer", "item", "items", "link", "links", "list", "module", "panel", "posts", "section", "slot", "text", "thread", "title", "unit", "wrap", "wrapper",
}
#: Beside a word of AROUND alone: the header of an entry is its title.
ENTRY = {"post", "article", "entry", "story", "news"}
#: What such a name may have beside "header" to be the page's header; a section-header is a heading.
PAGE_HEADER = {"site", "page", "main", "top", "global", "primary", "sticky", "mobile", "desktop", "inner", "wrap", "wrapper", "container", "area", "bar"}
#: Elements of the text itself: their ids and classes say where they are, not what they are.
TEXTUAL = HEADINGS | {"p", "pre", "blockquote", "li", "dt", "dd", "td", "th", "tr", "caption", "figcaption"}
#: Inside an article, so do those of its lists and tables.
LISTS = {"ul", "ol", "dl", "table"}
ARTICLE = {"article", "main"}
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: Elements that can be a whole part of a page; their slots can be left out.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "center", "address", "details", "figure"}
#: Elements that a valid class has at least.
SIZE = 2
#: Tags that end an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such a tag looks through for them; each can be open once below the next other element.
OPEN_ENDED = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
#: Attributes longer than this are read each time.
CACHED_CHARS = 1_000


def stands_for(names: set[str], kinds: set[str], beside: set[str]) -> bool:
    """Whether a whole class name or id is made of words of ``kinds`` and, at most, words ``beside`` them."""
    return any(words & kinds and words <= kinds | beside for words in (set(WORDS.findall(n)) for n in names))


class Kind:
    """What a tag's name and attributes say: its label in paths, and what it stands for."""

    __slots__ = ("label", "article", "comments", "around", "by_name", "header", "hidden")

    def __init__(self, name: str, attributes: str):
        label, names, roles = name, set(), set()
        for m in NAMED.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").strip().lower()
            if m[1].lower() == "role":
                roles |= set(value.split())
            else:
                names |= set(value.split())
                label += "." + "-".join(WORDS.findall(value))
        page = name in ("body", "html") or name in TEXTUAL
        self.label = label
        self.article = name in ARTICLE or bool(roles & ARTICLE)
        self.comments = not page and stands_for(names, COMMENTS, BESIDE | ENTRY | AROUND)
        known = self.comments or name in DROPPED or bool(roles & ROLES)
        self.around = known or (not page and name not in ARTICLE and stands_for(names, AROUND, BESIDE | ENTRY))
        self.by_name = self.around and not known and name in LISTS
        self.header = name == "header" or (not page and stands_for(names, {"header"}, PAGE_HEADER))
        self.hidden = name in RAW or bool(HIDDEN.search(attributes))


class Element:
    """``hidden``: never shown or reader comments; ``lost``: that, or dropped inside the innermost article around.

    ``slot`` and ``fixed``: in one of the given template tokens.  ``text`` and ``chars``: hash and length of all text in it.
    """

    __slots__ = ("name", "path", "inline", "dropped", "article", "hidden", "lost", "slot", "fixed", "text", "chars")

    def __init__(self, name: str = "", path: int = 0):
        self.name, self.path, self.text, self.chars = name, path, 0, 0
        self.inline = self.dropped = self.article = self.hidden = self.lost = self.slot = self.fixed = False

    def add(self, text: int, chars: int) -> None:
        self.text, self.chars = signed(f"{self.text},{text}"), self.chars + chars


def signed(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def tag_end(html: str, at: int) -> int:
    """Where a tag ends that has been read up to ``at``: behind the first > outside quoted values, else with the page."""
    while (m := TAG_STOP.search(html, at)) is not None:
        if m[1] is None:
            return m.end()
        close = html.find(m[1], m.end())
        at = m.end() if close < 0 else close + 1  # a quote that is never closed is a character
    return len(html)


class Parser:
    """Elements with their roles; inline elements have no part in it unless they are left out."""

    def __init__(self) -> None:
        self.kinds: dict[tuple[str, str], Kind] = {}

    def kind(self, name: str, attributes: str) -> Kind:
        if len(attributes) > CACHED_CHARS:
            return Kind(name, attributes)
        key = name, attributes
        made = self.kinds.get(key)
        if made is None:
            if len(self.kinds) > 50_000:
                self.kinds.clear()
            made = self.kinds[key] = Kind(name, attributes)
        return made

    def open(self, parent: Element, name: str, kind: Kind, slots: frozenset, fixed: frozenset) -> Element:
        made = Element(name, signed(f"{parent.path}>{kind.label}"))
        made.article = parent.article or kind.article
        drops = (kind.around and not (kind.by_name and parent.article)) or kind.hidden or (kind.header and not parent.article)
        made.hidden = kind.hidden or kind.comments or parent.hidden
        made.lost = made.hidden or (drops if kind.article else made.article and (parent.lost or drops))
        made.dropped = parent.dropped or drops
        made.slot, made.fixed = parent.slot or made.path in slots, parent.fixed or (made.path in fixed and not (parent.article and name in LISTS))
        return made

    def walk(self, html: str, slots: frozenset = frozenset(), fixed: frozenset = frozenset()) -> Iterator[tuple[str, object, Element]]:
        """("tag", opened element or None at a mere block boundary, element around), ("text", text, element around), ("end", closed element, None)."""
        stack = [Element()]
        held: Counter = Counter()  # names of open elements
        unclosed: set[str] = set()
        at, n = 0, len(html)

        def close(first: int) -> Iterator[tuple[str, object, None]]:
            while len(stack) > first:
                gone = stack.pop()
                held[gone.name] -= 1
                if gone.chars:
                    stack[-1].add(gone.text, gone.chars)
                yield "end", gone, None

        def push(made: Element) -> None:
            stack.append(made)
            held[made.name] += 1

        while at < n:
            start = html.find("<", at)
            if start < 0:
                start = n
            if start > at:
                yield "text", html[at:start], stack[-1]
            if start == n:
                break
            mark = html[start + 1 : start + 2]
            if mark in "!?" and mark:
                opening, closing = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if html.startswith(o, start)), (mark, ">"))
                end = html.find(closing, start + len(opening))
                at = n if end < 0 else end + len(closing)
                continue
            found = TAG_NAME.match(html, start + 1 + (mark == "/"))
            if found is None:
                yield "text", "<", stack[-1]
                at = start + 1
                continue
            name = found[0].lower()
            if mark == "/":
                end = html.find(">", found.end())
                at = n if end < 0 else end + 1
                if held[name] and (name in BLOCK or stack[-1].inline):
                    if name in BLOCK:
                        yield "tag", None, stack[-1]
                    yield from close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
                elif name in BLOCK:
                    yield "tag", None, stack[-1]
                continue
            at = tag_end(html, found.end())
            attributes = html[found.end() : at].removesuffix(">")
            ends = attributes.endswith("/")
            if name in RAW:
                made = self.open(stack[-1], name, self.kind(name, attributes), slots, fixed)
                yield "tag", made, stack[-1]
                if not ends or name in ("script", "style", "title", "textarea"):
                    closer = None if name in unclosed else re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(html, at)
                    if closer is not None:
                        end = html.find(">", closer.end() - 1)
                        at = n if end < 0 else end + 1
                    else:
                        unclosed.add(name)
                        if name in ("script", "style", "title", "textarea"):
                            break
                continue
            if name in VOID:
                if name in BLOCK:
                    yield "tag", None, stack[-1]
                continue
            kind = self.kind(name, attributes)
            if name not in BLOCK:
                if not ends and (stack[-1].inline or kind.around or kind.hidden):
                    made = self.open(stack[-1], name, kind, slots, fixed)
                    made.inline = True
                    push(made)
                continue
            top = stack[-1].name
            if top == "p" or (top in HEADINGS and name in HEADINGS):
                yield from close(len(stack) - 1)
            if name in CLOSES and any(held[c] for c in CLOSES[name]):
                first = i = len(stack)
                while i > 1 and stack[i - 1].name in OPEN_ENDED:
                    i -= 1
                    if stack[i].name in CLOSES[name]:
                        first = i
                yield from close(first)
            made = self.open(stack[-1], name, kind, slots, fixed)
            yield "tag", made, stack[-1]
            if not ends:
                push(made)
        yield from close(1)
        yield "end", stack[0], None


def blocks(parser: Parser, html: str, slots: frozenset | None, fixed: frozenset = frozenset()) -> list[str]:
    """Texts of the blocks in extracted slots.

    ``slots`` are template tokens that hold the article, None: the page's own;
    ``fixed`` are template tokens without data, left out if anything is left beside them.
    """
    parts: list[tuple[Element, bool, str]] = []
    inside = False
    wrapped = 0  # articles in dropped parts
    piece: list[str] = []
    where: Element | None = None

    def end() -> None:
        nonlocal piece
        if piece:
            text = SPACE.sub(" ", unescape("".join(piece))).strip()
            if text:
                parts.append((where, where.article if slots is None else where.slot, text))
            piece = []

    for kind, value, around in parser.walk(html, slots or frozenset(), fixed):
        if kind == "tag":
            end()
            if value is not None and value.article:
                inside = True
                wrapped += value.dropped and not value.lost and not (around.article and not around.lost)
        elif kind == "text" and not around.inline:
            if piece and where is not around:
                end()
            where = around
            piece.append(value)
    end()
    if any(fits and not e.fixed and not e.lost for e, fits, _ in parts):
        # Of the article, what has the same text on all pages of the host is template.
        parts = [(e, fits and not e.fixed, t) for e, fits, t in parts]
    clear = [t for e, fits, t in parts if fits and not e.dropped]
    fitting = [t for e, fits, t in parts if fits and e.article and not e.lost] if wrapped else clear
    if clear and wrapped and (wrapped > 1 or sum(map(len, fitting)) <= 2 * sum(map(len, clear))):
        fitting = clear
    if fitting or (slots is None and inside):
        return fitting
    if slots is not None:
        return blocks(parser, html, None, fixed)
    return [t for e, _, t in parts if not e.dropped and not e.fixed] or [t for e, _, t in parts if not e.dropped]


TOKENS = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("token", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("article", T.BooleanType()),
        T.StructField("dropped", T.BooleanType()),
        T.StructField("times", T.LongType()),
        T.StructField("page", T.LongType()),
        T.StructField("source", T.LongType()),
        T.StructField("text", T.LongType()),
        T.StructField("chars", T.LongType()),
        T.StructField("within", T.LongType()),
        T.StructField("held", T.LongType()),
    ]
)
KINDS = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 7]
#: Names of elements that are roles, by number: numbers keep the sums in a hash aggregate.
NAMES = ["", *sorted(BLOCK | RAW)]
NUMBER = {name: i for i, name in enumerate(NAMES)}
#: What tells occurrence vectors apart: pages, and sums over the halves of their hashes.
VECTOR = ["pages", "low", "high"]
#: The token that stands for the page.
PAGE = 0


def page_tokens(parser: Parser, html: str) -> Iterator[tuple[int, Element, int, int | None, int, int | None, int]]:
    """(token, an element of it, times, hash and length of its own texts, hash and length of all text in it) for each role."""
    roles: dict[int, list] = {}
    for kind, value, around in parser.walk(html):
        if kind == "text":
            text = " ".join(value.split())
            if text:
                around.add(signed(text), len(text))
                if not around.inline:
                    row = roles.setdefault(around.path, [around, 0, None, 0, None, 0])
                    row[2], row[3] = signed(f"{row[2]},{text}"), row[3] + len(text)
        elif kind == "tag" and value is not None:
            roles.setdefault(value.path, [value, 0, None, 0, None, 0])[1] += 1
        elif kind == "end" and value.chars and not value.inline:
            row = roles.setdefault(value.path, [value, 0, None, 0, None, 0])
            row[4], row[5] = signed(f"{row[4]},{value.text}"), row[5] + value.chars
    roles.setdefault(PAGE, [Element(), 0, None, 0, None, 0])[1] = 1
    for token, row in roles.items():
        yield token, *row


def tokens(pages: DataFrame) -> DataFrame:
    """(page, url, html) to one row for each page and distinct role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for part in itertools.chain.from_iterable(slices(b, 2) for b in batches):
            rows = []
            for page, url, html in zip(*(part.column(i).to_pylist() for i in range(3))):
                host, html = split_url(url)[0], html or ""
                source = signed(html)
                key = signed(f"{page}\0{url}\0{source}")
                for token, role, times, *texts in page_tokens(parser, html):
                    rows.append((host, token, NUMBER[role.name], role.name in ARTICLE, role.dropped, times, key, source, *texts))
            columns = list(zip(*rows)) if rows else [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=TOKENS.names)

    return map_batches(spread(pages), run, TOKENS)


def roles(pages: DataFrame) -> DataFrame:
    """One row for each host and role: its occurrence vector and whether its texts are ``fixed``, the same on all its pages.

    ``same`` says that of all text within its elements.
    """
    every, texts = F.count(F.lit(1)), F.count("text")
    half = lambda shift: F.sum(F.shiftrightunsigned("page", shift).bitwiseAND(0xFFFFFFFF))
    summed = tokens(pages).groupBy("host", "token").agg(
        F.max("kind").alias("kind"),
        F.max("article").alias("article"),
        F.min("dropped").alias("dropped"),
        every.alias("pages"),
        F.sum("times").alias("times"),
        half(0).alias("low"),
        half(32).alias("high"),
        (F.min("source") < F.max("source")).alias("differ"),
        (texts > 0).alias("holds"),
        ((texts == every) & (F.min("text") == F.max("text"))).alias("fixed"),
        F.sum("chars").alias("chars"),
        ((F.count("within") == every) & (F.min("within") == F.max("within"))).alias("same"),
        F.sum("held").alias("held"),
    )
    return materialize(summed, "roles")


def valid(vectors: DataFrame, support: float) -> DataFrame:
    """Tokens of valid equivalence classes, with ``class_size``."""
    hosts = vectors.where(F.col("token") == PAGE).select("host", F.col("pages").alias("host_pages"))
    once = vectors.where("times = pages")
    groups = once.groupBy("host", *VECTOR).agg(F.count(F.lit(1)).alias("class_size")).where(F.col("class_size") >= SIZE)
    groups = groups.join(hosts, "host").where(F.col("pages") >= support * F.col("host_pages")).drop("host_pages")
    return once.where(F.col("token") != PAGE).join(groups, ["host", *VECTOR])


def classes(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """(host, token, name, article, class_pages, class_size): tokens of valid equivalence classes."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("kind") + 1).alias("name")
    return valid(roles(pages), support).select("host", "token", name, "article", F.col("pages").alias("class_pages"), "class_size")


def without_data(vectors: DataFrame, template: DataFrame) -> DataFrame:
    """(host, token): containers of the template whose whole text is the same on all pages, and less than varies on a page."""
    # Characters of data on a page, outside the parts that names stand for.
    data = vectors.where("holds and not fixed and not dropped").groupBy("host").agg(F.sum("chars").alias("data"))
    data = data.join(vectors.where(F.col("token") == PAGE).select("host", F.col("pages").alias("host_pages")), "host")
    data = data.select("host", (F.col("data") / F.col("host_pages")).alias("data"))
    slots = template.where(F.col("differ") & F.col("same") & F.col("kind").isin(*sorted(NUMBER[c] for c in CONTAINERS)))
    return slots.join(data, "host").where("held / pages < data").select("host", "token")


def templates(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """(host, slots, fixed): article tokens of each host's template, and its containers without data, in articles too."""
    vectors = roles(pages)
    template = materialize(valid(vectors, support), "template")
    slots = template.where("article").groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("slots"))
    fixed = without_data(vectors, template).groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("fixed"))
    return slots.join(fixed, "host", "full").select("host", "slots", "fixed")


def extract(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", text: str = "text", support: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Add the main text of each page."""
    pages = df.select(F.col(page).cast("string").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    with Scratch(df.sparkSession) as scratch:
        slots = scratch.keep(templates(pages, support).withColumnRenamed("host", "__host"), "templates")
    key = F.coalesce(F.translate(F.regexp_extract(F.col(url), r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != text.lower()]
    size = F.coalesce(F.size("slots"), F.lit(0)) + F.coalesce(F.size("fixed"), F.lit(0)) + 8
    sides = df.select(*[F.col(f"`{c}`") for c in kept], F.struct(F.col(html).alias("h")).alias("__page"), key.alias("__host"))
    with_slots = spread(sides).join(if_small(slots, weight=size), "__host", "left")
    listed = [F.coalesce(F.concat_ws(" ", F.col(c).cast("array<string>")), F.lit("")) for c in ("slots", "fixed")]
    packed = with_slots.select(*[F.col(f"`{c}`") for c in kept], F.concat(listed[0], F.lit("\0"), listed[1], F.lit("\0"), F.coalesce(F.col("__page.h"), F.lit(""))).alias("__packed"))

    def make():
        parser = Parser()

        def apply(values: list) -> list[pa.Array]:
            out = []
            for v in values:
                slots, fixed, source = v.split("\0", 2)
                out.append("\n".join(blocks(parser, source, frozenset(map(int, slots.split())) if slots else None, frozenset(map(int, fixed.split())))))
            return [pa.array(out, pa.string())]

        return apply

    return append_columns(packed, make, [T.StructField(text, T.StringType())], on="__packed", keep=kept)
