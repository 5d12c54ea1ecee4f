"""HTML extraction and URL rules."""

import random
import time

import duckdb
import pytest

from verdex.llm import htmlextract, queries, urlfilter

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div><nav><ul><li><a href="/x">Menu{n}</a></li></ul></nav><!-- ad -->
<div class="ad">Buy{n}</div><article><h1>Head&amp;line</h1><p>One  <b>bold</b>
 line &lt;x&gt;<p>Two&nbsp;{n}<br>three</p><form><input><button>Send</button></form><ul><li>item<li>other</ul></article>
<aside>side</aside><section id="comments"><p>reader {n}</p></section><footer>&copy; 2020</footer></body></html>"""
TEXT = "Head&line\nOne bold line <x>\nTwo {n}\nthree\nitem\nother"


def extract(spark, rows, schema="page_id long, url string, html string"):
    return {r["page_id"]: r["text"] for r in htmlextract.extract(spark.createDataFrame(rows, schema)).collect()}


def test_article_of_a_template(spark):
    rows = [(n, f"http://h{n % 2}.example/{n}", PAGE.format(n=n)) for n in range(12)]
    assert extract(spark, rows) == {n: TEXT.format(n=n) for n in range(12)}


def test_pages_that_are_all_copies_keep_their_text(spark):
    rows = [(n, "http://same.example/", PAGE.format(n=1)) for n in range(5)]
    assert set(extract(spark, rows).values()) == {TEXT.format(n=1)}


def test_page_that_does_not_fit_its_host(spark):
    rows = [(n, "http://h.example/", PAGE.format(n=n)) for n in range(4)] + [(9, "http://h.example/", "<div><p>Plain page</p><div class=sidebar>no</div></div>")]
    assert extract(spark, rows)[9] == "Plain page"


def test_hosts_without_article_elements(spark):
    page = '<body><div id="nav">m{n}</div><div class="content"><h1>H{n}</h1><p>Body {n}.</div><div class="footer">f</div></body>'
    rows = [(n, "https://other.example/a", page.format(n=n)) for n in range(4)]
    assert extract(spark, rows) == {n: f"H{n}\nBody {n}." for n in range(4)}


def test_boilerplate_in_unlisted_classes(spark):
    page = '<body><div class="crumbs"><a>Home</a><ul><li>Trail<li>Start</ul></div><div class="post"><h1>Head {n}</h1><h2>Summary</h2><p>The body text of number {n}.<p>More on {n}.</div><div class="legalese">Rights reserved</div></body>'
    other = '<body><div class="post"><h1>Head 9</h1><p>Rights reserved</div></body>'
    kept = "Head {n}\nSummary\nThe body text of number {n}.\nMore on {n}."
    rows = [(n, "http://plain.example/", page.format(n=n)) for n in range(6)] + [(9, "http://plain.example/", other)]
    assert extract(spark, rows) == {n: kept.format(n=n) for n in range(6)} | {9: "Head 9\nRights reserved"}


def test_crawls_of_one_article_keep_it(spark):
    page = '<body><div class="post"><p>An article that is the same in all.</div><div class="views">{n}</div></body>'
    rows = [(n, "http://again.example/", page.format(n=n)) for n in range(4)] + [(n, "http://copy.example/", page.format(n=1)) for n in range(4, 8)]
    assert extract(spark, rows) == {n: f"An article that is the same in all.\n{n if n < 4 else 1}" for n in range(8)}


def test_a_class_needs_size_and_support(spark):
    page = '<body><div class="a">x{n}</div>{more}</body>'
    rows = [(str(n), "http://h.example/", page.format(n=n, more="<h3>lone</h3>" * (n < 4) + "<div class=b><p>two</div>" * (n > 0) + "<h4>rare</h4>" * (n == 0))) for n in range(6)]
    rows += rows[1:3]  # pages that repeat count each
    found = htmlextract.classes(spark.createDataFrame(rows, "page string, url string, html string")).collect()
    assert sorted(r["name"] for r in found) == ["body", "div", "div", "p"]


WRAPPERS = ['<div class="site has-sidebar">', '<div class="layout no-sidebar">', '<div id="page" class="with-banner">', '<div class="content ad-free">']


def test_wrappers_whose_class_holds_a_listed_word(spark):
    inner = '<div class="site-footer">f</div><div class="post-comments">c</div><div class="sidebar">s</div>'
    rows = [(n, f"http://w{n}.example/", f"{w}<article><h1>Head</h1><p>Text.</p></article>{inner}</div>") for n, w in enumerate(WRAPPERS)]
    rows += [(10 + n, f"http://v{n}.example/", f"{w}<div><h1>Head</h1><p>Text.</p></div>{inner}</div>") for n, w in enumerate(WRAPPERS)]
    assert extract(spark, rows) == {r[0]: "Head\nText." for r in rows}


def test_a_listed_part_around_the_article(spark):
    around = {
        1: '<div class="sidebar"><main><p>Text.</p><nav>n</nav></main></div>',
        2: '<form id="aspnet"><header>h</header><article><p>Text.</p><div class="share">s</div></article></form>',
        3: '<main>Home<div class="widget"><article><p>A text in a widget.</p></article></div></main>',
        4: '<article class="post comments-open"><p>Text.</p></article><div class="related"><article>Tease</article></div>',
        5: '<article><p>Text.</p></article><div class="related"><article>Teaser one, long</article><article>Teaser two, long</article></div>',
        6: '<article><p>Text.</p></article><section id="comments"><article class="comment-body"><p>A reader wrote all of this.</p></article><article>Another reader</article></section>',
        7: '<section id="comments"><article><p>reader</p></article></section><div hidden><article>h</article></div>',
    }
    rows = [(10 * n + k, f"http://a{n}.example/{k}", f"<body>{html}</body>") for n, html in around.items() for k in range(3)]
    expected = {n: "Text." for n in around} | {3: "Home\nA text in a widget.", 7: ""}
    assert extract(spark, rows) == {r[0]: expected[r[0] // 10] for r in rows}


def test_edges(spark):
    rows = [(1, None, None), (2, "http://x/", ""), (3, None, "just text &amp; more"), (4, "http://x/", "<script>only()"), (5, "http://x/", "<p>a<p>b</p></p>c"), (6, "http://x/", "<article>" + "<p>word " * 20_000), (7, "http://x/", "a < b and <3"), (8, "http://x/", "<p title='a>b'>kept</p>")]
    got = extract(spark, rows)
    assert got[1] == got[2] == got[4] == "" and got[3] == "just text & more" and got[5] == "a\nb\nc" and got[7] == "a < b and <3" and got[8] == "kept"
    assert got[6].count("word") == 20_000
    clash = spark.createDataFrame([(1, "u", "<p>x", "old")], "page_id long, url string, html string, TEXT string")
    assert htmlextract.extract(clash).columns == ["page_id", "url", "html", "text"]
    assert extract(spark, [], "page_id long, url string, html string") == {}


def test_equivalence_classes(spark):
    pages = spark.createDataFrame([(str(n), "http://h.example/", PAGE.format(n=n)) for n in range(6)], "page string, url string, html string")
    rows = htmlextract.classes(pages).collect()
    names = {r["name"] for r in rows}
    assert {"article", "nav", "h1", "footer"} <= names
    assert sum(r["name"] == "li" for r in rows) == 1  # the article's occur twice a page
    assert len({r["class_size"] for r in rows}) == 1


def test_classes_equal_grouped_vectors(spark):
    """Classes by sums of hashed pages are those of the vectors written out."""
    rng = random.Random(4)
    rows = [(str(n % 30), f"http://h{n % 3}.example/{n % 30}", "<body>" + "".join(f'<div class="{c}">{rng.randint(0, 2)}</div>' for c in "abcdefgh" if rng.random() < 0.8 or c in "ab") + "</body>") for n in range(40)]
    rows += rows[:6]
    parser, vectors = htmlextract.Parser(), {}
    for at, (_, url, html) in enumerate(rows):
        for token, _, times, *_ in htmlextract.page_tokens(parser, html):
            vectors.setdefault((urlfilter.split_url(url)[0], token), {})[at] = times
    groups = {}
    for (host, token), v in vectors.items():
        if set(v.values()) == {1}:
            groups.setdefault((host, frozenset(v)), []).append(token)
    pages = {h: len(v) for (h, t), v in vectors.items() if t == htmlextract.PAGE}
    expected = {(h, t, len(v), len(ts)) for (h, v), ts in groups.items() if len(ts) >= 2 and 2 * len(v) >= pages[h] for t in ts if t != htmlextract.PAGE}
    got = {(r["host"], r["token"], r["class_pages"], r["class_size"]) for r in htmlextract.classes(spark.createDataFrame(rows, "page string, url string, html string")).collect()}
    assert got == expected and len({s for *_, s in got}) > 1


def test_the_template_decides(spark):
    """Neutral class names: without the host's other pages nothing tells the frame from the text."""
    page = '<body><div class="xa"><span>Home</span> <ul><li>One<li>Two</ul></div><div class="xb"><p>Body of {n}.</p><p>And more of {n}.</p></div><div class="xc">All rights</div></body>'
    rows = [(n, "http://frame.example/", page.format(n=n)) for n in range(5)]
    assert extract(spark, rows) == {n: f"Body of {n}.\nAnd more of {n}." for n in range(5)}
    assert extract(spark, rows[:1]) == {0: "Home\nOne\nTwo\nBody of 0.\nAnd more of 0.\nAll rights"}


def test_names_of_headings_and_inline_adverts(spark):
    html = '<article><h2 id="related-work">Related</h2><p id="share-prices">Prices</p><h2 id="search-algorithms">Search</h2><p>Before <span class="ad">buy <b>now</b> <span>!</span></span>after</p><p>x <span hidden>no</span><i>y</i></p></article>'
    assert extract(spark, [(1, "http://n.example/", html)]) == {1: "Related\nPrices\nSearch\nBefore after\nx y"}


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<a " * 1_700_000 + '"', ""),
        ("<div>" * 100_000 + "x", "x"),
        ("<div>" * 50_000 + "</p>" * 50_000 + "x", "x"),
        ("<iframe>" * 100_000, ""),
        ("<blockquote>" * 50_000 + "<dt></dt>" * 50_000 + "x", "x"),
        ("<dt><div>" + "<tbody>" * 50_000 + "<dt></dt>" * 50_000 + "x", "x"),
        ("<table>" + "<tr><td>c" * 50_000, "\n".join("c" * 50_000)),
        ("<h1><p>" * 30_000 + "<li></li>" * 30_000 + "x", "x"),
        ("<p title='" * 100_000, ""),
        ("<" * 500_000 + " x", "<" * 500_000 + " x"),
        ("<p a=" + " " * 500_000 + ">x", "x"),
        ("<span class=ad>" * 50_000 + "</i>" * 50_000, ""),
        ("<!--" * 200_000, ""),
    ],
)
def test_reading_is_linear(html, expected):
    began = time.perf_counter()
    parser = htmlextract.Parser()
    assert "\n".join(htmlextract.blocks(parser, html, None)) == expected
    assert sum(1 for _ in htmlextract.page_tokens(parser, html))
    assert time.perf_counter() - began < 20


def test_html_query(spark, small):
    rows = queries.op8_html_extract(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"].replace("< ", "") for r in rows)


URLS = [None, "", "example.com/en/", "http://example.com/en/1?x#y", "http://WWW.Example.com/en/a", "https://a.b.example.com/en/", "http://example.com", "http://example.com?/en/", "x://net/es/", "http://a.net/fr/b", "http://anet/fr/b", "http://evil-casino.example.org/p", "http://casinos.example.org/", "a://b://c.com/d", "http://user@x.com:80/", "http://com/", "http://.com/", "http://spam.net/es/", "http://net/ES/"]


def test_site_rules(spark):
    rows = urlfilter.judge(spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)], "page_id long, url string, Host string")).orderBy("page_id").collect()
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[None] == ("", "", None, "allow") and got["example.com/en/"] == ("", "", None, "allow")
    assert got["http://example.com/en/1?x#y"] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got["http://WWW.Example.com/en/a"] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got["http://example.com"] == ("example.com", "", None, "allow")
    assert got["x://net/es/"][2:] == ("net/es/", "block") and got["http://anet/fr/b"][2] is None and got["http://net/ES/"][2] is None
    assert got["http://evil-casino.example.org/p"][2:] == (None, "block") and got["http://casinos.example.org/"][3] == "allow"
    assert got["a://b://c.com/d"][:2] == ("b:", "//c.com/d") and got["http://user@x.com:80/"][2] is None


def test_index_finds_what_all_rules_find():
    rng = random.Random(1)
    rules = urlfilter.SITE_RULES + urlfilter.WORD_RULES + [urlfilter.site_rule("block", "/ads"), urlfilter.site_rule("block", "a.com/x"), urlfilter.site_rule("allow", "b.org")]
    index, every = urlfilter.Index(rules), urlfilter.Index([])
    every.always = [(p, r) for entries in [*index.by_token.values(), index.always] for p, r in entries]
    for _ in range(3000):
        subject = ".".join(rng.choice(["www", "a", "b", "example", "casino", "my-ads", "x"]) for _ in range(rng.randint(0, 3))) + rng.choice([".com", ".net", "net", ".org", ""]) + rng.choice(["", "/", "/en/", "/es/1", "/xyz", "/fr", "/ads/2"])
        assert index.best(subject) == every.best(subject)
    assert len(index.candidates("plain.org/page")) < 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, small, duck, name):
    frame = queries.QUERIES[name](spark, small)
    columns = ", ".join(sorted(frame.columns))
    assert sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr) == sorted(duck.sql(f"select {columns} from ({queries.ORACLE_SQL[name]})").fetchall(), key=repr)


def test_url_sql_on_odd_urls(spark):
    frame = urlfilter.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), keep=["page_id"]).drop("pattern")
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar)")
    db.executemany("insert into pages values (?, ?)", list(enumerate(URLS)))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    expected = db.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL['op9_url_filter']})").fetchall()
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(expected)


def extracted(spark, pages):
    frame = spark.createDataFrame([(i, f"http://h{host}.org/{i}", html) for i, (host, html) in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in htmlextract.extract(frame).collect()}


def test_the_template_decides_inside_articles_too(spark, monkeypatch):
    """An advert in an unlisted class, the same on all pages, goes; without the template it stays."""
    advert = '<div class="zq1">Buy our shoes now</div>'
    pages = [("a", f"<html><body><nav>Home</nav><article><h1>Title {n}</h1><p>The text number {n} of this page has some words.</p>{advert}<ul><li>point {n}</li></ul><p>Shared closing words.</p></article></body></html>") for n in range(6)]
    pages += [("b", f"<html><body><div class=q>{advert}<p>Only words {n} here and there, quite some of them.</p></div></body></html>") for n in range(4)]
    got = extracted(spark, pages)
    assert all(got[n] == f"Title {n}\nThe text number {n} of this page has some words.\npoint {n}\nShared closing words." for n in range(6))
    assert all(got[6 + n] == f"Only words {n} here and there, quite some of them." for n in range(4))
    parser = htmlextract.Parser()
    assert "Buy our shoes" in "\n".join(htmlextract.blocks(parser, pages[0][1], None))
    # Crawls of one article with another counter keep what is long in it.
    copies = [("c", f"<html><body><article><h1>One</h1><div class=k>{'long words of the article ' * 9}</div></article><p>seen {n}</p></body></html>") for n in range(3)]
    assert all("long words" in t for t in extracted(spark, copies).values())


def test_names_of_headings_and_paragraphs_drop_nothing():
    parser = htmlextract.Parser()

    def read(html):
        return "|".join(htmlextract.blocks(parser, html, None))

    assert read('<main><h2 id="advertising">Advertising in 0</h2><p>x</p><h2 id="search">Search</h2><p>y</p></main>') == "Advertising in 0|x|Search|y"
    assert read('<article><p>one</p><p id="navigation">two</p><h2 id="related">three</h2><h2 id="comments">Comments on the text</h2><p class="social">four</p><ul class="menu"><li>five</li></ul></article>') == "one|two|three|Comments on the text|four|five"
    assert read('<body><div class="section-header"><h2>Part 0</h2></div><p>text</p><div class="site-header">Site</div><ul class="menu"><li>Home</li></ul></body>') == "Part 0|text"
    assert read('<article><p>one</p><div class="comments"><p>me too</p></div><div class="share">tell</div><nav>up</nav></article>') == "one"
