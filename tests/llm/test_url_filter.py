import re

import duckdb

from tests.conftest import SMALL
from trawl.llm import queries, url_filter
from trawl.llm.url_filter import host_path_rule, judge_urls, pattern_rule

RULES = [host_path_rule(*r) for r in queries.URL_RULES]
URLS = [
    (1, "https://a.EXAMPLE.net/en/x"), (2, "https://example.net/eng"), (3, "https://badexample.net/en/"), (4, "http://example.com/de/?q"), (5, "http://x.org/fr/1#f"),
    (6, "http://x.net"), (7, None), (8, "no url"), (9, "http://x.net/"), (9, "http://x.net/"), (10, ""), (11, "http://ads.doubleclick.net/a"), (12, "http://h.com/banner/ads/1"),
    (13, "x://h?://net/"), (14, "http://net/"), (15, "http://h.com/" + "a" * 50000 + "/porn/"), (None, "http://example.org/fr/"),
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        after = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", after).group()
        path = re.match(r"[^?#]*", after[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in queries.URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_rules_against_brute(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string").withColumnRenamed("page_id", "rule")
    got = judge_urls(df, RULES)
    assert got.columns == ["rule", "url", "host", "path", "url_rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, best = brute(r.url)
        assert (r.host, r.path, r.url_rule, r.verdict) == (host, path, best and best[0], best[1] if best else "allow"), r.url


def test_patterns_and_shuffled_index(spark):
    rules = RULES + [pattern_rule("block", "/porn/"), pattern_rule("block", "/banner/ads/"), pattern_rule("block", "|http://h.com/|"), pattern_rule("allow", "abc*def^"), pattern_rule("block", "bc")]
    df = spark.createDataFrame(URLS + [(20, "http://z.com/xabcq?1def&"), (21, "http://z.com/xabcq")], "page_id long, url string")
    one = sorted(map(str, judge_urls(df, rules).collect()))
    two = sorted(map(str, judge_urls(df, rules, broadcast_bytes=0).collect()))
    assert one == two
    by = {r.page_id: r.verdict for r in judge_urls(df, rules).collect()}
    assert (by[12], by[15], by[20], by[21]) == ("block", "block", "allow", "block")
    assert judge_urls(df.where("false"), rules).collect() == [] and judge_urls(df, []).where("verdict = 'allow'").count() == len(URLS) + 2
    assert rules[0].tokens == ("net",) and url_filter.pattern_rule("block", "*foo/bar").tokens == ()


def test_query_equals_sql(spark):
    found = queries.op1_url_filters(spark, SMALL).toPandas()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    want = c.sql(queries.oracle_sql()["op1_url_filters"]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(found) == rows(want)
