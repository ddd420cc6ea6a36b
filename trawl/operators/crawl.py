"""The data half of a crawler: frontier, politeness, pages, links and statistics.

Fetching is out of band: a table of responses (url, status, final_url, html,
content_type, fetched_at and, when there were retries, attempt from 0) stands
for the network. A crawl goes in breadth-first rounds over it. What a round
admits is decided before its links count: hosts, depth, budget, robots rules and
duplicates among the pages reached so far.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import pages as pg
from trawl.functions import robots as rb
from trawl.functions.urls import host_of, normalize_udf, path_and_query
from trawl.operators import dedup, ordered
from trawl.operators.index import with_doc_ids
from trawl.operators.session import checkpointed

#: URLs of a round that are sent to every task, about 20 MB; more of them meet the responses in a shuffle.
BROADCAST_URLS = 100_000


@dataclass
class CrawlConfig:
    max_pages: int = 200
    max_depth: int = 5
    delay: float = 1.0
    max_delay: float = 30.0
    retries: int = 2
    max_body: int = 2_000_000
    user_agent: str = "trawlbot/0.1"
    robot: str = "trawlbot"
    anywhere: bool = False


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(node, depth) reached by breadth-first rounds over links (src, dst), seeds (node) at depth 0.

    Each round is one join and one anti-join, checkpointed; the page budget is
    spent in the order of the nodes.
    """
    seen = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    if max_pages is not None:
        seen = checkpointed(seen.orderBy("node").limit(max_pages))
    edge = seen
    for d in range(1, max_depth + 1):
        new = edge.join(links, edge["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        new = new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        if max_pages is not None:
            new = new.orderBy("node").limit(max(0, max_pages - seen.count()))
        edge = checkpointed(new)
        if edge.isEmpty():
            break
        seen = seen.union(edge)
    return seen


def schedule(urls: DataFrame, delay: float | Column, host_col: str = "host", *order: str) -> DataFrame:
    """``urls`` with ``slot`` and ``earliest`` seconds: a host's pages one delay apart, in the given order.

    ``delay`` may be a column that is the same for all pages of a host. Pages are
    numbered over ranges of (host, order), so a host of any size is spread over tasks.
    """
    by = list(order or ("url",))
    rows = ordered.row_numbers(ordered.dealt(urls, [host_col], by), [host_col], by, "slot").drop(ordered.RANGE)
    wait = delay if isinstance(delay, Column) else F.lit(delay)
    return rows.withColumn("slot", F.col("slot").cast("int")).withColumn("earliest", (F.col("slot") - 1) * wait)


def effective_delay(configured: float, asked: float | None, most: float = 30.0) -> float:
    """A robots delay raises the configured one, up to ``most``."""
    return max(configured, min(asked or 0.0, most))


def retry_wait(attempt: int, retry_after: str | None = None, network: bool = False, most: float = 30.0) -> float:
    """Seconds before attempt + 1: Retry-After in digits, else 2 s a try; half a second a try after network failures."""
    if network:
        return 0.5 * (attempt + 1)
    return min(float(retry_after) if retry_after and retry_after.isdigit() else 2.0 * (attempt + 1), most)


def settled(responses: DataFrame, retries: int = 2) -> DataFrame:
    """One response a URL, with ``retries``: the first attempt within the limit that was not refused for load (429, 503)
    and did answer, else the last one within it. Without a column ``attempt`` every response is a first one."""
    if "attempt" not in responses.columns:
        return responses.withColumn("retries", F.lit(0))
    again = F.col("status").isNull() | F.col("status").isin(429, 503)
    tried = responses.where(F.col("attempt") <= retries).withColumn("_again", again)
    best = tried.groupBy("url").agg(F.coalesce(F.min(F.when(~F.col("_again"), F.col("attempt"))), F.max("attempt")).alias("retries"))
    return tried.drop("_again").join(best, "url").where(F.col("attempt") == F.col("retries")).drop("attempt")


def answers(asked: DataFrame, responses: DataFrame, count: int) -> DataFrame:
    """``responses`` to the ``count`` asked URLs. Bodies are never broadcast: Spark guesses the size of made-up columns far too small."""
    if count <= BROADCAST_URLS:
        return F.broadcast(asked).join(responses, "url")
    return asked.join(responses.hint("merge"), "url")


def parsed(responses: DataFrame, config: CrawlConfig) -> DataFrame:
    """Responses with the parsed ``page`` and ``body``; failures (no status or 400 and above) have neither, other types
    than HTML are left out, bodies are cut to ``max_body`` characters."""
    failed = F.col("status").isNull() | (F.col("status") >= 400)
    kept = responses.where(failed | F.lower(F.coalesce("content_type", F.lit("text/html"))).contains("html"))
    kept = kept.withColumn("html", F.when(failed, None).otherwise(F.substr("html", F.lit(1), F.lit(config.max_body))))
    out = pg.analyzed(kept, config.robot).withColumn("failed", failed)
    return out.withColumn("final_url", F.coalesce(normalize_udf(F.coalesce("final_url", "url")), F.col("url")))


def stored(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Stored pages of ``parsed`` rows with ``arrival`` and the marks (arrival, content_hash, simhash, dup_of, dup_kind) of the good ones."""
    out = rows.join(marks, "arrival", "left").withColumn("page", F.when(~F.col("failed"), F.col("page")))
    extra = [c for c in ("depth", "retries", "arrival") if c in out.columns]
    return out.select(
        "url", "final_url", "status", "fetched_at", F.col("page.title").alias("title"), F.col("page.text").alias("text"), F.col("page.main_text").alias("main_text"),
        "content_hash", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"), "dup_of", "dup_kind",
        F.coalesce("page.noindex", F.lit(False)).alias("noindex"), F.coalesce("page.nofollow", F.lit(False)).alias("nofollow"),
        F.col("page.canonical").alias("canonical"), F.coalesce("page.links", F.array()).alias("links"), "html", *extra,
    )


def process(responses: DataFrame, config: CrawlConfig | None = None) -> DataFrame:
    """Stored pages of all responses, duplicates in order of (fetched_at, url)."""
    config = config or CrawlConfig()
    rows = parsed(settled(responses, config.retries), config).withColumn("arrival", F.struct("fetched_at", "url"))
    prints = dedup.fingerprints(rows.where("not failed"), "body", ("arrival",))
    marks = dedup.assign(prints, "arrival").withColumn("dup_of", F.col("dup_of.url")).join(prints.select("arrival", "content_hash", "simhash"), "arrival")
    return stored(rows, marks).drop("arrival", "retries")


def link_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of all stored pages; the source is the requested URL."""
    return pages.select(F.col("url").alias("src"), F.explode("links").alias("dst")).distinct()


def followable(pages: DataFrame) -> DataFrame:
    """Distinct links of pages that are neither duplicates nor nofollow; noindex pages count."""
    return link_edges(pages.where("dup_kind is null and not nofollow"))


class Crawl(NamedTuple):
    """``pages`` stored, ``links`` between them, and ``fetches``: what became of every URL that was admitted."""

    pages: DataFrame
    links: DataFrame
    fetches: DataFrame


def crawl(seeds: DataFrame, responses: DataFrame, robots: DataFrame | None = None, config: CrawlConfig | None = None) -> Crawl:
    """A crawl over a table of responses: robots, depth, budget and host rules as configured.

    Each round takes the admitted URLs of one depth in order of discovery (by
    the page that named them, then by place on it; seeds as given). Refused
    ones count against the budget, as do URLs without a response; URLs of other
    hosts are not admitted. Pages are judged against the originals of the rounds
    before and the earlier ones of their own; only originals that don't say
    nofollow give links. The target of a redirect counts as seen from the page on
    that was sent there.
    ``robots`` has (host, status, text); hosts without a row may be fetched.
    """
    config = config or CrawlConfig()
    first = seeds.select(normalize_udf("url").alias("url"), F.monotonically_increasing_id().alias("at")).where("url is not null")
    new = first.groupBy("url").agg(F.min("at").alias("at"))
    hosts = None if config.anywhere else checkpointed(new.select(host_of(F.col("url")).alias("_host")).distinct())
    known = settled(responses, config.retries)
    rules, delays = robots_tables(robots, config) if robots is not None else (None, None)
    spark, seen, budget = seeds.sparkSession, None, config.max_pages
    pages, fetches, prints = [], [], None
    for depth in range(config.max_depth + 1):
        # A round is no larger than what is left of the budget.
        asked = with_doc_ids(new.orderBy("at").limit(max(0, budget)), "at").withColumn("depth", F.lit(depth))
        asked = asked.select("url", "depth", F.struct(F.lit(depth).alias("depth"), F.col("doc_id").alias("nth"), "url").alias("arrival"))
        asked = asked.withColumns({"host": host_of(F.col("url")), "path": path_and_query(F.col("url"))})
        asked = rb.decide(asked, rules) if rules is not None else asked.withColumn("allowed", F.lit(True))
        asked = checkpointed(asked)
        count = asked.count()
        if not count:
            break
        budget -= count
        got = checkpointed(answers(asked.where("allowed").select("url", "depth", "arrival"), known, count))
        rows = checkpointed(parsed(got, config))
        fetches.append(_outcomes(asked, got, delays, config))
        good = dedup.fingerprints(rows.where("not failed"), "body", ("arrival",))
        prints = checkpointed(good if prints is None else prints.unionByName(good))
        verdict = dedup.assign(prints, "arrival")
        marks = verdict.where(F.col("arrival.depth") == depth).withColumn("dup_of", F.col("dup_of.url"))
        round_pages = checkpointed(stored(rows, marks.join(prints.select("arrival", "content_hash", "simhash"), "arrival")))
        pages.append(round_pages)
        # Only originals are compared with what comes later.
        prints = checkpointed(prints.join(verdict.where("dup_kind is null").select("arrival"), "arrival", "left_semi"))
        met = asked.select("url")
        seen = checkpointed(met if seen is None else seen.union(met))
        out = round_pages.where("dup_kind is null and not nofollow and status < 400")
        linked = out.select(F.col("arrival.nth").alias("page"), F.posexplode("links").alias("pos", "url"))
        new = linked.groupBy("url").agg(F.min(F.struct("page", "pos")).alias("at"))
        if hosts is not None:
            new = new.join(hosts, host_of(F.col("url")) == F.col("_host"), "left_semi")
        # A link that comes after the page that was sent to its target finds the target seen.
        sent = round_pages.groupBy(F.col("final_url").alias("_sent")).agg(F.min("arrival.nth").alias("_by"))
        fresh = new.join(seen, "url", "left_anti").join(sent, F.col("url") == F.col("_sent"), "left")
        new = checkpointed(fresh.where(F.col("_by").isNull() | (F.col("at.page") <= F.col("_by"))).select("url", "at"))
        seen = seen.union(round_pages.select(F.col("final_url").alias("url")))
    if not pages:
        empty = checkpointed(parsed(known.where("false").withColumns({"depth": F.lit(0), "arrival": F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("nth"), "url")}), config))
        none = dedup.fingerprints(empty, "body", ("arrival",))
        pages.append(stored(empty, dedup.assign(none, "arrival").withColumn("dup_of", F.col("dup_of.url")).join(none.select("arrival", "content_hash", "simhash"), "arrival")))
        fetches.append(spark.createDataFrame([], FETCH))
    every = reduce(DataFrame.unionByName, pages).drop("arrival", "retries")
    return Crawl(every, link_edges(every), reduce(DataFrame.unionByName, fetches))


FETCH = "url string, host string, depth int, outcome string, status int, retries int, bytes long, fetched_at double, delay double"


def _outcomes(asked: DataFrame, got: DataFrame, delays: DataFrame | None, config: CrawlConfig) -> DataFrame:
    """(url, host, depth, outcome, status, retries, bytes, fetched_at, delay) of a round's URLs.

    ``outcome`` is robots_blocked, error (no answer, or none in the table), http_error, non_html or fetched.
    """
    html = F.lower(F.coalesce("content_type", F.lit("text/html"))).contains("html")
    told = got.select(
        F.col("url").alias("_url"), F.lit(True).alias("_met"), F.col("status").cast("int"), F.col("retries").cast("int"), html.alias("_html"),
        F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes"), F.col("fetched_at").cast("double"),
    )
    rows = asked.join(told, F.col("url") == F.col("_url"), "left")
    outcome = (
        F.when(~F.col("allowed"), "robots_blocked").when(F.col("_met").isNull() | F.col("status").isNull(), "error")
        .when(F.col("status") >= 400, "http_error").when(~F.col("_html"), "non_html").otherwise("fetched")
    )
    wait = F.lit(config.delay)
    if delays is not None:
        rows = rows.join(delays, "host", "left")
        wait = F.coalesce("_delay", wait)
    return rows.select("url", "host", "depth", outcome.alias("outcome"), "status", F.coalesce("retries", F.lit(0)).alias("retries"),
                       F.coalesce("bytes", F.lit(0)).alias("bytes"), "fetched_at", wait.cast("double").alias("delay"))


def robots_tables(robots: DataFrame, config: CrawlConfig) -> tuple[DataFrame, DataFrame]:
    """(host, allow, regex, length) of the rules for this robot, and (host, _delay): the seconds that the host asks for, within limits."""
    agent, least, most = config.user_agent, config.delay, config.max_delay

    def run(batches):
        for batch in batches:
            rows = []
            for host, status, text in batch.itertuples(index=False):
                policy = rb.from_status(None if pd.isna(status) else int(status), text or "")
                if policy.mode == "disallow_all":
                    rows.append((host, False, "^/", 1, None))
                rows += [(host, allow, regex, length, None) for allow, _, regex, length in rb.rules_table(policy, agent)]
                rows.append((host, None, None, None, effective_delay(least, policy.crawl_delay(agent), most)))
            yield pd.DataFrame(rows, columns=["host", "allow", "regex", "length", "_delay"]).astype({"allow": object, "length": "Int32"})

    told = checkpointed(robots.select("host", "status", "text").mapInPandas(run, "host string, allow boolean, regex string, length int, _delay double"))
    delays = told.where("_delay is not null").groupBy("host").agg(F.max("_delay").alias("_delay"))
    return told.where("regex is not null").select("host", "allow", "regex", "length"), delays


def fetch_stats(fetches: DataFrame) -> DataFrame:
    """One row: scheduled, fetched, robots_blocked, errors, http_errors, non_html, retries, bytes, seconds, pages_per_sec.

    ``fetched`` counts all answers; seconds are those between the first and the last.
    """
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    one = fetches.agg(
        F.count("*").alias("scheduled"), count("fetched", "http_error", "non_html").alias("fetched"), count("robots_blocked").alias("robots_blocked"),
        count("error").alias("errors"), count("http_error").alias("http_errors"), count("non_html").alias("non_html"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.round(F.coalesce(F.max("fetched_at") - F.min("fetched_at"), F.lit(0.0)), 2).alias("seconds"),
    )
    return one.withColumn("pages_per_sec", F.round(F.when(F.col("seconds") > 0, F.col("fetched") / F.col("seconds")).otherwise(0.0), 2))


def crawl_stats(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One row: pages, ok, exact_dups, near_dups, noindex, hosts, links, dup_rate."""
    one = pages.agg(
        F.count("*").alias("pages"), F.count_if(F.col("status").between(200, 299)).alias("ok"), F.count_if(F.col("dup_kind") == "exact").alias("exact_dups"),
        F.count_if(F.col("dup_kind") == "near").alias("near_dups"), F.count_if("noindex").alias("noindex"), F.count_distinct(host_of(F.col("url"))).alias("hosts"),
    )
    rate = F.round((F.col("exact_dups") + F.col("near_dups")) / F.greatest(F.col("pages"), F.lit(1)), 4)
    return one.crossJoin(links.agg(F.count("*").alias("links"))).withColumn("dup_rate", rate)  # one row each


def host_gaps(fetches: DataFrame, host_col: str = "host", time_col: str = "ts") -> DataFrame:
    """(host, n, min_gap): least seconds between two fetches of a host; null for one fetch."""
    t = F.unix_micros(F.col(time_col).cast("timestamp"))
    gap = (t - F.lag(t).over(Window.partitionBy(host_col).orderBy(time_col))) / 1e6
    return fetches.select(host_col, gap.alias("g")).groupBy(host_col).agg(F.count("*").alias("n"), F.min("g").alias("min_gap"))
