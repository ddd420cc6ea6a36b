import json

import pytest
from pyspark.sql import functions as F

from trawl import cli
from trawl.operators import crawl, evaluation, index, ordered, simweb

SCHEMA = "url string, status int, html string, final_url string, content_type string, fetched_at double"


def words(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def page(body, *out, head=""):
    return f"<html><head><title>t</title>{head}</head><body><p>{body}</p>" + "".join(f'<a href="{o}">l</a>' for o in out) + "</body></html>"


def fetched(spark, rows):
    full = [(r[0], *(r[1:] if len(r) > 2 else (200, r[1])), None, "text/html", float(i)) if len(r) < 4 else (*r, float(i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def run(spark, rows, seeds=("http://a.test/",), robots=None, **config):
    told = spark.createDataFrame(robots, "host string, status int, text string") if robots else None
    return crawl.crawl(spark.createDataFrame([(s,) for s in seeds], "url string").coalesce(1), fetched(spark, rows), told, crawl.CrawlConfig(**config))


def test_what_is_refused_leads_nowhere(spark):
    rows = [
        ("http://a.test/", page(words("home"), "/private/x", "http://b.test/", "/c")), ("http://a.test/private/x", page(words("p"), "/behind-private")),
        ("http://b.test/", page(words("b"), "http://a.test/behind-other-host")), ("http://a.test/behind-private", page(words("bp"))),
        ("http://a.test/behind-other-host", page(words("bo"))), ("http://a.test/c", page(words("c"))), ("http://a.test/unlinked", page(words("c"))),
    ]
    done = run(spark, rows, ("HTTP://A.test",), [("a.test", 200, "User-agent: *\nDisallow: /private/\nCrawl-delay: 9")])
    # The page that nothing links to has the text of /c and must not make it a duplicate.
    assert {r.url: (r.depth, r.dup_of) for r in done.pages.collect()} == {"http://a.test/": (0, None), "http://a.test/c": (1, None)}
    got = {r.url: (r.outcome, r.delay) for r in done.fetches.collect()}
    assert got == {"http://a.test/": ("fetched", 9.0), "http://a.test/private/x": ("robots_blocked", 9.0), "http://a.test/c": ("fetched", 9.0)}
    wide = run(spark, rows, anywhere=True)
    assert {r.url for r in wide.pages.collect()} == {r[0] for r in rows} - {"http://a.test/unlinked"}


def test_budget_goes_by_discovery(spark):
    rows = [("http://a.test/", page(words("home"), "/z", "/y", "/x", "/w"))] + [(f"http://a.test/{c}", page(words(c), f"/{c}2")) for c in "zyxw"]
    rows += [(f"http://a.test/{c}2", page(words(c + "2"))) for c in "zyxw"]
    assert {r.url[14:]: r.depth for r in run(spark, rows, max_pages=7).pages.collect()} == {"": 0, "z": 1, "y": 1, "x": 1, "w": 1, "z2": 2, "y2": 2}
    # Forbidden pages were scheduled all the same.
    robots = [("a.test", 200, "User-agent: *\nDisallow: /z\nDisallow: /y")]
    assert {r.url[14:] for r in run(spark, rows, robots=robots, max_pages=4, max_depth=1).pages.collect()} == {"", "x"}
    assert run(spark, rows, max_pages=0).pages.count() == 0


def test_duplicates_redirects_and_failures(spark):
    rows = [
        ("http://a.test/", page(words("home"), "/one", "/two", "/moved", "/gone", "/file", "/nowhere", "/quiet", "/unseen")),
        ("http://a.test/one", page(words("same"), "/from-one")), ("http://a.test/two", page(words("same"), "/from-two")),
        ("http://a.test/moved", 200, page(words("target")), "http://a.test/target#x", "text/html"), ("http://a.test/target", page(words("target"))),
        ("http://a.test/gone", 404, "", None, "text/html"), ("http://a.test/file", 200, "%PDF", None, "application/pdf"),
        ("http://a.test/quiet", page(words("quiet"), "/from-quiet", head='<meta name="robots" content="nofollow">')),
        ("http://a.test/unseen", page(words("unseen"), "/from-unseen", "/target", head='<meta name="robots" content="noindex">')),
        *((f"http://a.test/from-{x}", page(words(f"from{x}"))) for x in ("one", "two", "quiet", "unseen")),
    ]
    done = run(spark, rows)
    got = {r.url.removeprefix("http://a.test/"): r for r in done.pages.collect()}
    assert set(got) == {"", "one", "two", "moved", "gone", "quiet", "unseen", "from-one", "from-unseen"}
    assert (got["two"].dup_of, got["two"].dup_kind) == ("http://a.test/one", "exact") and got["moved"].final_url == "http://a.test/target"
    assert got["gone"].title is None and got["unseen"].noindex and got["quiet"].nofollow
    one = crawl.fetch_stats(done.fetches).first()
    assert (one.scheduled, one.fetched, one.errors, one.http_errors, one.non_html, one.robots_blocked) == (11, 10, 1, 1, 1, 0) and one.bytes > 0
    assert ("http://a.test/two", "http://a.test/from-two") in {(r.src, r.dst) for r in done.links.collect()}


def test_bodies_are_not_broadcast(spark):
    urls = F.concat(F.lit("http://a.test/"), F.col("id").cast("string"))
    bodies = spark.range(500).select(urls.alias("url"), F.repeat(F.lit("x"), 1000).alias("html"))
    asked = spark.range(0, 600, 100).select(urls.alias("url"))
    for count, plan in ((6, "BroadcastHashJoin [url#"), (crawl.BROADCAST_URLS + 1, "SortMergeJoin")):
        got = crawl.answers(asked, bodies, count)
        assert sorted(r.url for r in got.collect()) == [f"http://a.test/{i}" for i in range(0, 500, 100)]
        text = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().sparkPlan().toString()
        assert plan in text and "rightHint=(strategy=broadcast)" not in text and "BuildRight" not in text


def test_attempts(spark):
    rows = [("u", 503, 0), ("u", 200, 1), ("u", 200, 2), ("v", None, 0), ("v", 429, 1), ("v", 503, 2), ("v", 200, 3), ("w", 404, 0)]
    df = spark.createDataFrame(rows, "url string, status int, attempt int")
    assert sorted(map(tuple, crawl.settled(df).select("url", "status", "retries").collect())) == [("u", 200, 1), ("v", 503, 2), ("w", 404, 0)]


def test_synthetic_web_against_its_truth(spark):
    web = simweb.web(spark, hosts=3, pages=30, exact=0.15, near=0.15)
    truth = {r.url: (r.cluster, r.kind) for r in web.truth.collect()}
    kinds = [k for _, k in truth.values()]
    assert len(truth) == 90 and kinds.count("exact") > 5 and kinds.count("near") > 5
    done = crawl.crawl(web.seeds, web.responses, web.robots, crawl.CrawlConfig(max_depth=3, max_pages=1000))
    pages = {r.url: r for r in done.pages.collect()}
    assert len(pages) > 60 and not any("private" in u or "utm" in u for u in pages)
    assert crawl.fetch_stats(done.fetches).first().robots_blocked >= 10
    score = evaluation.duplicate_clusters(done.pages, web.truth).first()
    assert score.precision == 1.0 and score.recall > 0.9 and score.flagged > 10
    again = simweb.web(spark, hosts=3, pages=30, exact=0.15, near=0.15)
    assert sorted(map(str, again.responses.collect())) == sorted(map(str, web.responses.collect()))
    slots = crawl.schedule(done.fetches.where("outcome <> 'robots_blocked'"), F.col("delay"), "host", "depth", "url")
    gaps = crawl.host_gaps(slots.withColumn("ts", F.timestamp_micros((F.col("earliest") * 1e6).cast("bigint"))))
    assert evaluation.politeness_violations(gaps, 1.0) == 0 and gaps.where("min_gap = 1.0").count() == 3


def test_running_values_of_groups_over_many_ranges(spark):
    rows = [(g, i, (i * 7) % 11) for g, n in (("a", 400), ("b", 1), (None, 90)) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = ordered.dealt(spark.createDataFrame(rows, "g string, i int, v int").repartition(5), ["g"], ["i"])
        assert dealt.select(ordered.RANGE).distinct().count() > 2
        got = ordered.previous(ordered.row_numbers(ordered.running_sum(dealt, ["g"], ["i"], "v", "s"), ["g"], ["i"], "n"), ["g"], ["i"], "v", "before")
        want = []
        for g in ("a", "b", None):
            mine = [r for r in rows if r[0] == g]
            want += [(g, i, v, sum(x[2] for x in mine[: i + 1]), i + 1, mine[i - 1][2] if i else None) for _, i, v in mine]
        assert sorted(map(str, got.select("g", "i", "v", "s", "n", "before").collect())) == sorted(f"Row(g={g!r}, i={i}, v={v}, s={s}, n={n}, before={b})" for g, i, v, s, n, b in want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_values_shuffle_once(spark):
    dealt = ordered.dealt(spark.range(100).select((F.col("id") % 3).alias("g"), "id"), ["g"], ["id"])
    rows = ordered.previous(ordered.row_numbers(dealt, ["g"], ["id"], "n"), ["g"], ["id"], "id", "before")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.where("before = id - 3 or (n = 1 and before is null)").count() == 100


def test_vbyte(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**53, 2**63 - 1]
    df = spark.createDataFrame([(numbers,), ([],), ([5],)], "x array<bigint>").withColumn("data", index.vbyte_encode(F.col("x")))
    got = df.select("x", "data", index.vbyte_decode(F.col("data")).alias("back")).collect()
    assert all(r.x == r.back for r in got) and bytes(got[1].data) == b"" and bytes(got[2].data) == b"\x05"
    assert bytes(df.first().data)[:6] == b"\x00\x01\x7f\x80\x01\xac"


@pytest.fixture
def said(spark, capsys, monkeypatch):
    """Runs the command line in the session of the tests and returns what it prints."""
    monkeypatch.setattr(cli, "build_session", lambda: spark)

    def call(*args):
        cli.main([str(a) for a in args])
        return capsys.readouterr().out

    return call


def test_command_line(spark, said, tmp_path):
    rows = [("http://a.test/", page("bean soup and bread", "/b")), ("http://a.test/b", page("bean salad with bread and olives"))]
    fetched(spark, rows).write.parquet(str(tmp_path / "responses"))
    out = said("crawl", "http://a.test", "--responses", tmp_path / "responses", "--db", tmp_path / "db", "--max-pages", 10)
    assert "'pages': 2" in out and "'fetched': 2" in out and "'links': 1" in out
    assert "'pages': 2" in said("crawl-stats", "--db", tmp_path / "db")
    said("index", "--crawl-db", tmp_path / "db", "--out", tmp_path / "index")
    # Any of the words is enough; the page with both is first.
    assert [x.split()[2] for x in said("search", "beans olives", "--index", tmp_path / "index").splitlines()] == ["http://a.test/b", "http://a.test/"]
    assert [x.split()[-2] for x in said("search", '"bean soup" OR salad', "--unranked", "--index", tmp_path / "index").splitlines()] == ["http://a.test/", "http://a.test/b"]
    assert said("search", "rice", "--index", tmp_path / "index") == ""
    articles = [{"title": "Soup", "text": "of beans", "namespace": 0, "outgoing_link": ["Bread"]}, {"title": "Bread", "text": "of flour", "namespace": 0, "outgoing_link": ["Soup", "Salt"]}]
    (tmp_path / "dump.json").write_text("".join('{"index":{}}\n' + json.dumps(a) + "\n" for a in articles))
    said("index", "--cirrus", tmp_path / "dump.json", "--out", tmp_path / "wiki", "--analyzer", "plain")
    out = said("links", "--cirrus", tmp_path / "dump.json", "--index", tmp_path / "wiki")
    assert "'edges': 2" in out and out.count("5.000e-01") == 2
    assert said("search", "beans", "--prior", "pagerank", "--index", tmp_path / "wiki").split()[-1] == "Soup"
    with pytest.raises(SystemExit):
        cli.main(["crawl", "http://a.test", "--responses", "x", "--concurrency", "3"])
