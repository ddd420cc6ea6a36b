import hashlib
import html
import random
import re
import string

from tests.conftest import SMALL
from trawl.llm import html_wrapper, licenses, queries, secrets

MIDDLE = "/root/testdata/sf0.01"


def test_query_against_brute(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    for r in queries.op8_html_extraction(spark, MIDDLE).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)
        body = re.sub(r"<[^<>]*$", "", body[1] if body else "")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?h1>|</?p>|<br>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


SHELL = """<html><head><title>Site</title><script>x("<p>no</p>")</script></head><body><header>Top</header><div id="main-menu"><a href=/a>Home</a></div>
<div><p>Welcome to our site, read on.</p><h1>{0}</h1><p>First {0} &amp; more<br>line</p><p>Second <b>{0} part<p>Third {0}</div>
<div class="comments"><p>nice {0}</p></div><aside>{0}</aside><form><p>{0}</p></form><div role="contentinfo">c</div></body></html>"""


def test_wrapper_induction():
    pages = [SHELL.format(w) for w in ("alpha", "beta", "gamma", "delta")]
    made = html_wrapper.induce(pages + pages)
    text = html_wrapper.extract(pages[0], made)
    assert text == "alpha\nFirst alpha & more line\nSecond alpha part\nThird alpha"
    assert html_wrapper.extract(pages[0]) == "Welcome to our site, read on.\n" + text
    assert html_wrapper.induce(pages[:2]) == b"" and html_wrapper.induce([pages[0]] * 9) == b""


def test_layouts_of_one_host_are_told_apart():
    news = "<body><div class=top><p>All the news</p></div><div class=story><h2>{0}</h2><p>{0} happened.</p></div><div class=end><p>Printed daily</p></div>"
    shop = "<body><table><tr><td>Prices with tax<td>{0} each</table><p>Send us {0}</p><p>Open all day</p>"
    pages = [x.format(w) for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta") for x in (news, shop)]
    made = html_wrapper.induce(pages)
    assert html_wrapper.extract(pages[0], made) == "alpha\nalpha happened." and html_wrapper.extract(pages[1], made) == "alpha each\nSend us alpha"


def test_parts_merge_to_the_same_template():
    pages = [SHELL.format(f"word{i} and more {i * i}") for i in range(24)] + [SHELL.replace("<h1>", "<p>Only here {0}</p><h1>").format(f"x{i}") for i in range(6)]
    whole = html_wrapper.induce(pages)
    parts = []
    for i in range(0, 30, 5):
        trees = [html_wrapper.wrapped(html_wrapper.marked(html_wrapper.parse(p))[0]) for p in pages[i : i + 5]]
        for t in trees[1:]:
            html_wrapper.merge(trees[0], t)
        parts.append(html_wrapper.unpacked(html_wrapper.packed(trees[0])))
    for t in parts[1:]:
        html_wrapper.merge(parts[0], t)
    assert html_wrapper.template(parts[0]) == whole != b"" and parts[0].count == 30


def test_headers_hold_titles_within_articles_only():
    page = '<header><p>Site</p></header><div class="page-header">x</div><article><header class="entry-header"><h1>Title</h1></header><p>Text</p><div class="share-bar">s</div></article>'
    assert html_wrapper.extract(page) == "Title\nText"
    assert html_wrapper.extract("<header><p>Site</p></header><p>Text</p>") == "Text"


def best_matching(a, b):
    """Simple tree matching by the textbook."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + best_matching(x, y))
    return m[-1][-1] + 1


def random_tree(rng, depth=4):
    node = html_wrapper.Wrapped(rng.choice("ab" if depth < 4 else "a"))
    node.children = [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3 if depth else 0))]
    return node


def test_tree_matching_against_the_textbook():
    rng = random.Random(9)
    for _ in range(60):
        a, b = random_tree(rng), random_tree(rng)
        shapes = html_wrapper.Shapes()
        shapes.number(a)
        shapes.number(b)
        want = best_matching(a, b)
        assert shapes.match(a.shape, b.shape) == want
        both = html_wrapper.size(a) + html_wrapper.size(b) - want
        html_wrapper.merge(a, b)
        assert html_wrapper.size(a) == both


def test_halved_tables_match_as_much(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(html_wrapper, "HELD_CELLS", 6)
    for _ in range(60):
        a, b = random_tree(rng), random_tree(rng)
        a.children += [random_tree(rng, 2) for _ in range(12)]
        b.children += [random_tree(rng, 2) for _ in range(9)]
        want = html_wrapper.size(a) + html_wrapper.size(b) - best_matching(a, b)
        html_wrapper.merge(a, b)
        assert html_wrapper.size(a) == want


def test_nothing_of_an_article_is_lost():
    deep = "<div><article><p>before</p>" + "<div>" * 400 + "deep" + "</div>" * 400 + "<p>after</p></article></div>"
    assert html_wrapper.extract(deep) == "before\ndeep\nafter"
    inside = '<article><p class="related-work">a <math><mi>x</mi></math> b</p><div class="side-by-side">c</div><div id="share-price">d</div><object>e</object><label>f</label><p class=comment-on-the-law>g</p></article>'
    assert html_wrapper.extract(inside) == "a x b\nc\nd\nef\ng"
    assert html_wrapper.extract("<html><head><title>t</title><p>no head end</p><p>two") == "no head end\ntwo"
    assert html_wrapper.extract("<form id=aspnet><div><p>whole page in a form</p></div></form>") == "whole page in a form"
    assert html_wrapper.extract("<form><article>kept</article><input></form><form><p>gone</p></form>") == "kept"
    assert html_wrapper.extract("<p>a long enough paragraph</p><form><p>gone</p></form>") == "a long enough paragraph"
    copies = [f"<body><nav>n</nav><article><p>Shared text of a report that was printed often.</p><p>Printed {i}</p></article>" for i in range(5)]
    made = html_wrapper.induce(copies)
    assert html_wrapper.extract(copies[0], made) == "Shared text of a report that was printed often.\nPrinted 0"
    plain = [c.replace("article", "div") for c in copies]
    assert html_wrapper.extract(plain[0], html_wrapper.induce(plain)).startswith("Shared text")


def test_long_pages_lose_what_short_ones_do():
    page = lambda name, n: "<body>" + "".join(f"<p>{name} {i}</p>" for i in range(n)) + "<div><p>Bottom note of the site</p></div>"
    pages = [page(w, n) for w, n in (("a", 3), ("b", 900), ("c", 5), ("d", 2100))]
    made = html_wrapper.induce(pages)
    for p in pages:
        text = html_wrapper.extract(p, made)
        assert "Bottom note" not in text and len(text.split("\n")) == p.count("<p>") - 1


def stripped(source):
    """A page without the marks that give its article away, in a shell that all pages of its host share."""
    host = "<div><p>Our site for readers everywhere.</p><p>Call us on weekdays.</p></div>"
    body = re.sub(r"</?(article|nav|footer)>", lambda m: m.group().replace(m[1], "div"), source).replace(' class="ad"', "")
    return body.replace("<body>", "<body>" + host)


def test_wrappers_decide_where_no_element_marks_the_article(spark):
    pages = [r for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect() if "<article>" in r.html]
    df = spark.createDataFrame([(r.page_id, r.url, stripped(r.html)) for r in pages], "page_id long, url string, html string").repartition(3)
    want = {r.page_id: set(html_wrapper.extract(r.html).split("\n")) for r in pages}
    shared = {"Our site for readers everywhere.", "Call us on weekdays."}
    got = {r.page_id: r.main_text.split("\n") for r in html_wrapper.main_text(df).collect()}
    alone = {r.page_id: html_wrapper.extract(stripped(r.html)).split("\n") for r in pages}
    kept = sum(want[i] <= set(got[i]) for i in want)
    assert kept >= 0.99 * len(want)
    with_, without = (sum(bool(shared & set(x[i])) for i in want) for x in (got, alone))
    assert without == len(want) and with_ < 0.2 * len(want)


def test_pages_that_mark_their_article_go_through_wrappers(spark):
    shell = "<body><div><p>Call us on weekdays.</p></div>{0}<div><p>All rights with us.</p></div>"
    article = "<article><p>A line of every article.</p><p>Story {0} goes on and on.</p></article>"
    rows = [(i, "http://h/a", shell.format(article.format(i))) for i in range(8)]
    # One page of the host marks nothing: the others' shell is its shell.
    rows.append((8, "http://h/b", shell.format("<div class=text><p>A page of its own kind.</p></div>")))
    rows += [(10 + i, "http://m/a", f"<body><main><h1>Title {i}</h1><div><p>We print daily, order now.</p></div>{article.format(i)}</main>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.main_text for r in html_wrapper.main_text(df).collect()}
    assert got.pop(8) == "A page of its own kind."
    story = "A line of every article.\nStory {0} goes on and on."
    want = {i: story.format(i) for i in range(8)} | {10 + i: f"Title {i}\n" + story.format(i) for i in range(5)}
    assert got == want


def test_broadcast_and_joined_wrappers_agree(spark, monkeypatch):
    rows = [(i, f"http://h{i % 4}/a", SHELL.format(f"word{i}")) for i in range(40)] + [(90, None, SHELL.format("none")), (91, "http://h1/b", None)]
    rows += [(92, "http://h1/c", "<article><p>Welcome to our site, read on.</p></article>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = sorted(map(str, html_wrapper.main_text(df).collect()))
    monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", 0)
    assert sorted(map(str, html_wrapper.main_text(df).collect())) == first and len(first) == len(rows)


def test_html_edges(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, "http://h/a", None), (2, None, "<p>a&nbsp;b &lt;c&gt; &#233;</p>text<"), (3, "x", deep), (4, "http://h/a", "<p>" + "w " * 60000), (4, "http://h/a", "no tags & 1 < 2"), (5, "u", "<!-- open"), (6, "u", "<script>never")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, main_text string")
    got = sorted((r.page_id, r.main_text[:30], r.main_chars) for r in html_wrapper.main_text(df).collect())
    assert got == [(1, "", 0), (2, "a b <c> é\ntext<", 15), (3, "deep text", 9), (4, "no tags & 1 < 2", 15), (4, ("w " * 15)[:30], 119999), (5, "", 0), (6, "", 0)]
    assert html_wrapper.main_text(df.where("false")).collect() == []


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets_query_against_brute(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    found = 0
    for r in queries.op9_secret_scans(spark, MIDDLE).collect():
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        found += bool(base)
    assert found > 5


def test_battery():
    rng = random.Random(2)
    sets = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"]
    keys = ["".join(rng.choices(s, k=n)) for s in sets for n in (40, 48, 64) for _ in range(40)]
    hits = sum(any(k == "random" for *_, k in secrets.find_spans(f"the value {k} is here")) for k in keys)
    assert hits / len(keys) > 0.9
    # Recall by alphabet and length, letters alone among them.
    least = {(string.ascii_letters + string.digits, 20): 0.7, (string.ascii_letters + string.digits, 32): 0.95, (string.ascii_letters, 24): 0.7, (string.ascii_letters, 40): 0.95,
             (string.ascii_lowercase, 40): 0.8, (string.ascii_lowercase, 64): 0.95, (string.ascii_uppercase + "234567", 32): 0.9}
    for (letters, n), share in least.items():
        made = ["".join(rng.choices(letters, k=n)) for _ in range(200)]
        assert sum(any(k == "random" for *_, k in secrets.find_spans(f"the value {x} is here")) for x in made) / 200 >= share, (letters, n)
    plain = ["donaudampfschifffahrtsgesellschaftskapitaen", "AbstractHandlerMethodMappingConfiguration", "kirjastojarjestelmanhallintapaneeli", "THEQUICKBROWNFOXJUMPSOVERTHELAZYDOG", "internationalization-of-modules", "some_long_variable_name_here", "AbstractSingletonProxyFactoryBean2", "aaaaaaaaaaaaaaaaaaaaaaaa1", "123456789012345678901234567890", "src/main/java/org/example/app2/Main", "thonereinthealyaninghathon", "123e4567-e89b-12d3-a456-426614174000"]
    assert not [p for p in plain if secrets.find_spans(p)]


def test_secrets_edges(spark):
    token = "".join(random.Random(11).choices(string.ascii_letters + string.digits, k=48))
    rows = [(1, None), (2, ""), (3, f"é PassWord = 'abcdefgh1' {token} token:short"), (3, "x " * 60000 + "AKIA" + "A" * 16), (4, "password=secret=abcdefghij"), (5, "ſecret=abcdefghij")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, spans string")
    got = secrets.scan(df, keep_text=True, redacted=True).collect()
    assert [r.n_assign + r.n_access + r.n_hex + r.n_random for r in got] == [0, 0, 2, 1, 1, 0]
    assert got[0].text is None and got[2].text == "é [secret]' [secret] token:short" and got[3].text.endswith(" [secret]") and got[5].text == rows[5][1]
    assert [r.base_sha256 for r in got] == [hashlib.sha256(brute_spans(t or "").encode()).hexdigest() for _, t in rows]
    assert secrets.scan(df.where("false")).collect() == []
    assert secrets.redact("abcdef", [(1, 3, "a"), (2, 5, "b")]) == "a[secret]f"


def test_licenses(spark):
    truth = {"Apache License": "apache-2.0", "MIT License": "mit", "CC BY-NC": "cc-by-nc", "GNU General": "gpl", "All rights reserved": "proprietary"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    for r in queries.op10_license_scans(spark, MIDDLE).collect():
        assert r.licenses == ",".join(sorted(v for k, v in truth.items() if k.lower() in texts[r.doc_id].lower())), r.doc_id


def varied(rng, text, filler):
    """A text of which three words in ten are lost and one in five is followed by another word."""
    out = []
    for w in text.split():
        if rng.random() >= 0.3:
            out += [w, rng.choice(filler)] if rng.random() < 0.2 else [w]
    return " ".join(out)


def corpus_sentences(spark):
    return licenses.negatives(spark.read.parquet(f"{MIDDLE}/documents.parquet"))


def test_classifier_names_what_templates_alone_do_not(spark):
    told = corpus_sentences(spark)
    assert 500 < len(told) <= licenses.NEGATIVES
    model = licenses.train(told)
    rng = random.Random(5)
    filler = "the work and its parts may be used by anyone in any place as long as this is said".split()
    cases = [(f, varied(rng, t, filler)) for f, ts in licenses.TEMPLATES.items() for t in ts if len(t.split()) > 8 for _ in range(10)]
    right = sum(model.classify(t) == f for f, t in cases) / len(cases)

    def by_overlap(text, least):
        mine = licenses.pairs(text)
        score, family = max((max(licenses.overlap(mine, x) for x in model.pairs[f]), f) for f in licenses.TEMPLATES)
        return family if score >= least else None

    alone = sum(by_overlap(t, licenses.TOO_MUCH_SHARED) == f for f, t in cases) / len(cases)
    assert right > 0.75 and right > alone + 0.2
    # Templates with the bound that the classifier allows would take prose and other licences for theirs.
    prose = ["Any visitor may copy the map free of charge and without permission.", "The court granted the person all rights to the house.",
             "The version of the story in this book is used with permission.", "You should have received a copy of the letter along with this parcel."]
    assert sum(model.classify(t) in (None, "unknown") for t in prose) == len(prose) and sum(by_overlap(t, licenses.LEAST_SHARED) is None for t in prose) < len(prose) - 1
    other = [t % n for n in ("European Union Public", "Historical Permission Notice", "Reciprocal Public", "Lucent Public", "CeCILL")
             for t in ("Licensed under the %s License, version 1.2.", "This work is licensed under the terms of the %s License, version 3.")]
    assert not set(other) & set(licenses.OTHERS) and sum(model.classify(t) == "unknown" for t in other) >= 0.9 * len(other)
    assert not any(model.classify(t) for t in told[:500] if not by_overlap(t, licenses.TOO_MUCH_SHARED))


def test_long_lines_are_read_as_short_ones():
    model = licenses.train(["a sentence about nothing in particular", "and another one of them"])
    gpl = licenses.TEMPLATES["gpl"]
    for pad in (0, 540, 560, 5000):
        found = []
        text = "w " * (pad // 2) + "x. " + gpl[0] + " " + gpl[2] + "\n" + gpl[1]
        for a, b in licenses.paragraphs(text):
            found.append(model.classify(text[a:b]))
        assert found[-3:] == ["gpl"] * 3 and not any(found[:-3])


def test_license_edges(spark):
    model = licenses.train(["the quick brown fox jumps over the lazy dog", "a second paragraph about nothing in particular"])
    mit = licenses.TEMPLATES["mit"][2]
    rows = [(1, None), (2, ""), (3, "prose here\n" + mit), (3, "word " * 5000 + ". " + mit), (4, "She was granted permission to use the hall free of charge."), (5, "Copyright notice and license terms of an unheard-of kind apply.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licenses int")
    got = licenses.scan(df, model).collect()
    assert [r.licenses for r in got] == ["", "", "mit", "mit", "", ""] and got[2].license_spans == f"mit:11:{11 + len(mit)}"
    twice = licenses.scan(df.where("doc_id = 3").union(df.where("doc_id = 3")), model).collect()
    assert len(twice) == 4 and len(set(map(str, twice))) == 2
    both = licenses.TEMPLATES["gpl"][2] + " " + licenses.TEMPLATES["gpl"][0]
    one = licenses.scan(spark.createDataFrame([(1, both)], "doc_id long, text string"), model).first()
    assert (one.license_spans, one.n_licenses) == (f"gpl:0:{len(both)}", 1)
    assert licenses.scan(df.where("false"), model).collect() == [] and licenses.negatives(df.where("false")) == []
