"""A synthetic web with ground truth: responses, robots files and which pages are copies of which.

Every number of a page is a hash of the seed, the page and what the number is
for, so the web is made by columns alone, in parallel and alike each time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tries to find an original that a copy may be of; a page that finds none is an original.
TRIES = 8


class Web(NamedTuple):
    """``responses`` and ``robots`` as a crawl reads them; ``truth`` (url, cluster, kind): pages of a cluster are copies."""

    seeds: DataFrame
    responses: DataFrame
    robots: DataFrame
    truth: DataFrame


def _chance(seed: int, page: Column, *what) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), page.cast("bigint"), *(w if isinstance(w, Column) else F.lit(w) for w in what)), F.lit(1 << 30)) / F.lit(1 << 30)).cast("double")


def _words(seed: int, page: Column, vocabulary: int) -> Column:
    size = (250 + F.floor(_chance(seed, page, "size") * 150)).cast("int")
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.lit("w"), F.floor(_chance(seed, page, "word", i) * vocabulary).cast("string")))


def web(
    spark: SparkSession, hosts: int = 10, pages: int = 50, seed: int = 42, vocabulary: int = 4000, exact: float = 0.08, near: float = 0.08,
    links: int = 8, across: float = 0.3, tracked: float = 0.15, private: int = 5,
) -> Web:
    """``hosts`` of ``pages`` public pages each and ``private`` more that robots files forbid.

    ``exact`` and ``near`` are the shares of copies of an earlier page; a near
    copy has one other word and says when it was changed. A page links to
    ``links`` others, ``across`` of them on other hosts and ``tracked`` of them
    with a tracking parameter, and to one private page of its host.
    """
    total = hosts * pages
    kind = lambda p: F.when(_chance(seed, p, "kind") < exact, "exact").when(_chance(seed, p, "kind") < exact + near, "near")
    url = lambda p: F.concat(F.lit("http://h"), F.floor(p / pages).cast("string"), F.lit(".web.test/p"), (p % pages).cast("string"))
    rows = spark.range(total).withColumnRenamed("id", "p")
    tried = [F.floor(_chance(seed, F.col("p"), "of", i) * F.col("p")) for i in range(TRIES)]
    found = F.coalesce(*(F.when(kind(t).isNull() & (F.col("p") > 0), t) for t in tried))
    rows = rows.withColumns({"kind": kind(F.col("p")), "of": found})
    rows = rows.select("p", F.when(F.col("of").isNotNull(), F.col("kind")).alias("kind"), F.when(F.col("kind").isNotNull(), F.coalesce("of", "p")).otherwise(F.col("p")).alias("cluster"))
    words = _words(seed, F.col("cluster"), vocabulary)
    at = F.floor(_chance(seed, F.col("p"), "edit") * F.size(words)).cast("int")
    edited = F.concat(F.transform(words, lambda w, i: F.when(i == at, F.lit("edited")).otherwise(w)), F.array(F.lit("changed"), F.concat(F.lit("at"), F.col("p").cast("string"))))
    body = F.array_join(F.when(F.col("kind") == "near", edited).otherwise(words), " ")

    def link(i: Column) -> Column:
        host = F.when(_chance(seed, F.col("p"), "across", i) < across, F.floor(_chance(seed, F.col("p"), "host", i) * hosts)).otherwise(F.floor(F.col("p") / pages))
        target = url(host * pages + F.floor(_chance(seed, F.col("p"), "page", i) * pages))
        mark = F.when(_chance(seed, F.col("p"), "tracked", i) < tracked, "?utm_source=web").otherwise("")
        return F.concat(F.lit('<a href="'), target, mark, F.lit('">go</a>'))

    out = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(links)), link), " ")
    hidden = F.concat(F.lit('<a href="/private/'), (F.col("p") % private).cast("string"), F.lit('">no</a>')) if private else F.lit("")
    html = F.concat(
        F.lit("<html><head><title>Page "), F.col("p").cast("string"), F.lit("</title></head><body><nav>menu</nav><p>"), body, F.lit("</p><footer>"), out, hidden, F.lit("</footer></body></html>")
    )
    answer = [F.lit(200).alias("status"), F.lit(None).cast("string").alias("final_url"), F.lit("text/html").alias("content_type")]
    public = rows.select(url(F.col("p")).alias("url"), html.alias("html"), *answer, F.col("p").cast("double").alias("fetched_at"))
    secret = spark.range(hosts * private).select(
        F.concat(F.lit("http://h"), F.floor(F.col("id") / max(1, private)).cast("string"), F.lit(".web.test/private/"), (F.col("id") % max(1, private)).cast("string")).alias("url"),
        F.lit("<p>private</p>").alias("html"), *answer, F.lit(0.0).alias("fetched_at"),
    )
    robots = spark.range(hosts).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".web.test")).alias("host"), F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /private/\n").alias("text"))
    seeds = spark.range(hosts).select(url(F.col("id") * pages).alias("url"))
    return Web(seeds, public.unionByName(secret), robots, rows.select(url(F.col("p")).alias("url"), "cluster", F.coalesce("kind", F.lit("original")).alias("kind")))
