import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.functions import pages, porter, robots, text, urls
from trawl.operators import query

SITE = "https://shop.example.org"


@pytest.mark.parametrize(
    ("raw", "base", "expected"),
    [
        # Scheme, host and port.
        ("HTTPS://Shop.Example.ORG:443/Cart", None, f"{SITE}/Cart"),
        ("http://shop.example.org:443/", None, "http://shop.example.org:443/"),
        ("https://me:secret@shop.example.org./x", None, f"{SITE}/x"),
        ("https://shop.example.org", None, f"{SITE}/"),
        # Paths: dots, runs of slashes, escapes.
        (f"{SITE}/a/../../b/./c", None, f"{SITE}/b/c"),
        (f"{SITE}/shelf/..", None, f"{SITE}/"),
        (f"{SITE}/shelf/box/.", None, f"{SITE}/shelf/box/"),
        (f"{SITE}///one////two", None, f"{SITE}/one/two"),
        (f"{SITE}/%41%2Fz", None, f"{SITE}/A%2Fz"),
        # Queries are sorted, blanks stay, tracking goes whatever its case; fragments go.
        (f"{SITE}/?z=&y=2&y=1", None, f"{SITE}/?y=1&y=2&z="),
        (f"{SITE}/p?utm_campaign=spring&Utm_Term=q&id=7", None, f"{SITE}/p?id=7"),
        (f"{SITE}/p#reviews", None, f"{SITE}/p"),
        # Relative to a page.
        ("../b?c", f"{SITE}/d/e/f", f"{SITE}/d/b?c="),
        ("//cdn.example.org/i", f"{SITE}/", "https://cdn.example.org/i"),
        ("?page=2", f"{SITE}/list", f"{SITE}/list?page=2"),
        # No pages.
        ("tel:+100", f"{SITE}/", None),
        ("ftp://shop.example.org/f", None, None),
        ("https://", None, None),
        ("https://[::1", f"{SITE}/", None),
        ("https://shop.example.org:port/", None, None),
        (None, None, None),
    ],
)
def test_normalize(raw, base, expected):
    assert urls.normalize(raw, base) == expected


def test_normalize_is_stable():
    for raw in (f"{SITE}/a%20b/?q=%2B&r=x y", "http://[2001:db8::1]:8080/é?ü=ö", f"{SITE}/%7e%2f..%2f"):
        once = urls.normalize(raw)
        assert once and urls.normalize(once) == once


LIBRARY = """
Disallow: /before-any-agent
Sitemap: https://shop.example.org/map-1.xml
User-agent: Reader   # the first of two
a line without its mark
User-agent: indexer
Allow: /books/
Disallow: /books/drafts
Disallow: /*?print=
crawl-delay: 0.5
Crawl-Delay: soon

User-agent: *
Disallow: /
Allow: /$
User-agent: reader
Disallow: /attic
crawl-delay: 4
"""


@pytest.mark.parametrize(
    ("agent", "path", "expected"),
    [
        ("Reader/3.1", "/books/novel", True), ("reader", "/books/drafts/2", False), ("reader", "/books/x?print=1", False), ("indexer", "/attic", True),
        ("READER", "/attic/box", False), ("reader", "/before-any-agent", True), ("stranger", "/", True), ("stranger", "/books/", False),
        ("stranger", "/robots.txt", True), ("rea", "/books/", False),
    ],
)
def test_robots(agent, path, expected):
    assert robots.parse(LIBRARY).can_fetch(agent, path) is expected


def test_robots_sections():
    p = robots.parse(LIBRARY)
    assert [g.agents for g in p.groups] == [["reader", "indexer"], ["*"], ["reader"]] and p.sitemaps == [f"{SITE}/map-1.xml"]
    assert p.crawl_delay("reader") == 4.0 and p.crawl_delay("indexer") == 0.5 and p.crawl_delay("other") is None
    assert robots.parse("").can_fetch("x", "/y") and robots.parse("User-agent: a\nSitemap: s\nUser-agent: b\nDisallow: /").can_fetch("a", "/y")


def test_robots_matching():
    allowed = lambda rules, path: robots.parse("User-agent: *\n" + rules).can_fetch("x", path)
    assert allowed("Disallow: /same\nAllow: /same", "/same") and allowed("Disallow:", "/x")
    assert not allowed("Disallow: /stra%C3%9Fe", "/straße/1") and not allowed("Disallow: /*.zip$", "/a/b.zip") and allowed("Disallow: /*.zip$", "/b.zip?x")
    assert not allowed("Disallow: /a.b", "/a.b") and allowed("Disallow: /a.b", "/axb")


@pytest.mark.parametrize(("status", "expected"), [(200, False), (204, False), (301, False), (404, True), (429, True), (500, False), (None, False)])
def test_robots_status(status, expected):
    assert robots.from_status(status, "User-agent: *\nDisallow: /").can_fetch("x", "/page") is expected


RECIPE = """<!doctype html><title> Bean
 soup </title><base href="/kitchen/"><link rel="stylesheet" href="s.css"><link rel="Canonical" href="soup">
<meta name="ROBOTS" content="NoFollow"><meta name="otherbot" content="noindex">
<div class="top-menu x"><p>Start</p></div><h1>Bean soup</h1><p>Soak &frac12; cup<br>of beans.<script>"<p>not this</p>"</script>
<p>Boil <b>them</b> in <a href="pot?size=2">a pot</a> or <a href="/kitchen/pot?size=2#lid">pan</a>.
<a href="//ads.example.org/" rel="sponsored NOFOLLOW">offer</a><a name="x">anchor</a><a href="mailto:c@example.org">write</a>
<aside>Serves four</aside><footer id="sidebar-notes"><a href="../about">About</a></footer>"""


def test_page():
    p = pages.parse_html(RECIPE, f"{SITE}/soups/bean")
    assert p.title == "Bean soup" and p.canonical == f"{SITE}/kitchen/soup" and (p.noindex, p.nofollow) == (False, True)
    assert p.links == [f"{SITE}/kitchen/pot?size=2", f"{SITE}/about"]
    assert p.main_text == "Bean soup\nSoak ½ cup\nof beans.\nBoil them in a pot or pan.\nofferanchorwrite"
    assert p.text.split("\n")[0] == "Start" and "Serves four" in p.text and "not this" not in p.text and p.text.endswith("About")
    assert pages.parse_html(RECIPE, robot="otherbot").noindex and pages.parse_html('<meta name=robots content="none">').nofollow


def test_elements_that_nobody_closes():
    main = lambda source: pages.parse_html(source).main_text
    assert main("<nav><ul><li>one<li>two</nav>three</p>") == "three"
    assert main("</aside></nav>kept<br></br>too") == "kept\ntoo"
    assert main("<div id=footer_links>away<div>away</div>away</div>here<header>never closed") == "here"
    assert main("<div class='headers inside'>in</div>") == "in" and main("<i class='page header'>out</i>in") == "in"
    assert pages.parse_html(None) == pages.Page() and pages.parse_html("") == pages.Page()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<nav>", "</nav>", "<b>", "</b>", "<br>", "</div>", "<div class=menu>", "<svg>", "</svg>", "x", " "]), max_size=12))
def test_masks_against_a_walk(parts):
    """Text is main when no open element around it is chrome or hidden, by brute force over the open elements."""
    stack, want = [], []
    for part in parts:
        name = part.strip("</>").split()[0] if part.startswith("<") else ""
        if part.startswith("</"):
            if name in stack:
                while stack.pop() != name:
                    pass
        elif name and name != "br":
            stack.append(name)
        elif part == "x" and not {"nav", "div", "svg"} & set(stack):
            want.append("x")
    assert pages.parse_html("".join(parts)).main_text.replace(" ", "").replace("\n", "") == "".join(want)


def test_analyzers():
    assert text.analyze("The bakers' oldest ovens", "english") == [(1, "baker"), (2, "oldest"), (3, "oven")]
    assert text.analyze("The bakers' ovens") == [(0, "the"), (1, "bakers"), (2, "ovens")]
    assert [t for _, t in text.analyze("ＦＵＬＬ-width Œuvre_12 ½!")] == ["full", "width", "œuvre", "12", "1", "2"]
    assert text.analyze("left " + "y" * 41 + " right " + "z" * 40) == [(0, "left"), (1, "right"), (2, "z" * 40)]
    with pytest.raises(ValueError):
        text.analyze("a", "klingon")


@pytest.mark.parametrize(
    ("word", "stem"),
    [("glasses", "glass"), ("cities", "citi"), ("gas", "ga"), ("speed", "speed"), ("freed", "freed"), ("fitted", "fit"), ("missing", "miss"), ("tiling", "tile"), ("bring", "bring"),
     ("tanned", "tan"), ("crying", "cry"), ("enjoy", "enjoi"), ("conditional", "condit"), ("organization", "organ"), ("generously", "gener"), ("electricity", "electr"),
     ("darkness", "dark"), ("allowance", "allow"), ("effective", "effect"), ("cease", "ceas"), ("hall", "hall"), ("is", "is")],
)
def test_porter(word, stem):
    assert porter.stem(word) == stem


C = query.Clause


@pytest.mark.parametrize(
    ("asked", "expected"),
    [
        ("red apple", [[C(("red",), (0,))], [C(("apple",), (0,))]]),
        ('OR "red apple" OR pear', [[C(("red", "apple"), (0, 1)), C(("pear",), (0,))]]),
        ("red OR - OR pear -apple", [[C(("red",), (0,)), C(("pear",), (0,))], [C(("apple",), (0,), True)]]),
        ('-"red apple" OR pear', [[C(("red", "apple"), (0, 1), True)], [C(("pear",), (0,))]]),
        ("red or -pear OR fig", [[C(("red",), (0,))], [C(("or",), (0,))], [C(("pear",), (0,), True)], [C(("fig",), (0,))]]),
        ('ripe-fig "open end', [[C(("ripe", "fig"), (0, 1))], [C(("open",), (0,))], [C(("end",), (0,))]]),
        ('"OR" OR', [[C(("or",), (0,))]]),
        ("  ", []),
    ],
)
def test_query_parsing(asked, expected):
    assert query.parse(asked) == expected


def test_query_parsing_keeps_the_gaps_of_stop_words():
    assert query.parse('"house of the cards"', "english") == [[C(("hous", "card"), (0, 3))]]
    assert query.parse("apple OR the OR pear", "english") == [[C(("appl",), (0,)), C(("pear",), (0,))]]


def test_column_forms_agree(spark):
    from pyspark.sql import functions as F

    rows = [(1, "Maß ﬂute ÀB_12", "http://x.example.org/p?d=1&c=2&fbclid=3#top"), (2, None, None)]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    got = df.select(text.tokens(F.col("t")).alias("t"), urls.normalize_udf("u").alias("a"), urls.normalized_simple(F.col("u")).alias("b")).collect()
    assert got[0].t == ["mass", "flute", "àb", "12"] and got[1].t == []
    assert got[0].a == got[0].b == "http://x.example.org/p?c=2&d=1"


def test_pages_are_read_in_bounded_batches(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from trawl.functions import pages

    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")

    @F.pandas_udf("long")
    def batch(html: pd.Series) -> pd.Series:
        return pd.Series([html.str.len().sum()] * len(html))

    rows = spark.range(0, 3000, 1, 1).select(F.lit("http://a.test/").alias("url"), F.repeat(F.lit("x"), 10_000).alias("html"))
    out = pages.parsed_pages(rows).select("page.text", batch("html").alias("n"))
    assert out.agg(F.count("text"), F.max("n")).first()[0] == 3000
    assert out.agg(F.max("n")).first()[0] <= 8 << 20
