"""Command line: crawl, crawl-stats, index, search, links. Tables are Parquet folders."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from trawl.operators import crawl, links, query, rank
from trawl.operators import index as ix
from trawl.operators.session import build_session
from trawl.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    # Concurrency, CPU workers and a contact address are a fetcher's own; here responses are a table, so these options don't exist.
    top = argparse.ArgumentParser(prog="trawl")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="process a table of responses as a crawl from the seeds")
    c.add_argument("seed", nargs="+")
    c.add_argument("--responses", required=True)
    c.add_argument("--robots")
    c.add_argument("--db", default="data/crawl")
    c.add_argument("--max-pages", type=int, default=200)
    c.add_argument("--max-depth", type=int, default=5)
    c.add_argument("--delay", type=float, default=1.0)
    c.add_argument("--anywhere", action="store_true")
    s = sub.add_parser("crawl-stats")
    s.add_argument("--db", default="data/crawl")
    i = sub.add_parser("index")
    source = i.add_mutually_exclusive_group(required=True)
    source.add_argument("--crawl-db")
    source.add_argument("--cirrus")
    i.add_argument("--out", default="data/index")
    i.add_argument("--limit", type=int)
    i.add_argument("--analyzer", choices=("plain", "english"), default="english")
    q = sub.add_parser("search")
    q.add_argument("query")
    q.add_argument("--index", default="data/index")
    q.add_argument("--limit", type=int, default=10)
    q.add_argument("--k1", type=float, default=1.2)
    q.add_argument("--b", type=float, default=0.75)
    q.add_argument("--unranked", action="store_true")
    q.add_argument("--prior", choices=("auto", "none", "pagerank", "indegree"), default="auto")
    q.add_argument("--prior-weight", type=float, default=0.3)
    g = sub.add_parser("links")
    g.add_argument("--cirrus", required=True)
    g.add_argument("--index", default="data/index")
    g.add_argument("--damping", type=float, default=0.85)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    if args.command == "crawl":
        config = crawl.CrawlConfig(max_pages=args.max_pages, max_depth=args.max_depth, delay=args.delay, anywhere=args.anywhere)
        began = time.time()
        robots = spark.read.parquet(args.robots) if args.robots else None
        seeds = spark.createDataFrame([(s,) for s in args.seed], "url string")
        done = crawl.crawl(seeds, spark.read.parquet(args.responses), robots, config)
        sinks.write_table(done.pages, f"{args.db}/pages")
        sinks.write_table(done.links, f"{args.db}/links")
        one = crawl.fetch_stats(done.fetches).first().asDict()
        one |= crawl.crawl_stats(spark.read.parquet(f"{args.db}/pages"), spark.read.parquet(f"{args.db}/links")).first().asDict()
        sinks.log_run(spark, f"{args.db}/runs", one, began)
        print(one)
    elif args.command == "crawl-stats":
        print(crawl.crawl_stats(spark.read.parquet(f"{args.db}/pages"), spark.read.parquet(f"{args.db}/links")).first().asDict())
    elif args.command == "index":
        docs = readers.article_documents(spark, args.cirrus, args.limit) if args.cirrus else readers.indexable_pages(spark.read.parquet(f"{args.crawl_db}/pages"))
        if args.limit is not None:
            docs = docs.where(F.col("doc_id") < args.limit)
        ix.save(ix.build(docs, args.analyzer), args.out)
    elif args.command == "search":
        index = ix.load(spark, args.index)
        priors = _priors(spark, args.index, args.prior)
        if args.unranked:
            found = query.search(index, args.query).orderBy("doc_id").limit(args.limit).withColumn("score", F.lit(None).cast("double"))
        else:
            found = rank.ranked_search(index, args.query, args.limit, priors, args.prior_weight, args.k1, args.b)
        for row in found.join(index.docs, "doc_id").orderBy(F.desc("score"), "doc_id").collect():
            print(row.doc_id, row.score, row["url"], row["title"])
    else:
        articles = readers.articles(spark, args.cirrus)
        edges = links.edges(articles)
        nodes = articles.select(F.col("doc_id").alias("id"), "title", "incoming_links", "popularity_score")
        sinks.save_graph(nodes, edges, f"{args.index}/graph")
        nodes, edges = sinks.load_graph(spark, f"{args.index}/graph")
        result = links.pagerank(nodes, edges, args.damping)
        sinks.save_ranks(result.rank.join(links.in_degree(nodes, edges), "id"), f"{args.index}/ranks")
        print(links.graph_stats(articles).first().asDict(), result.iterations, result.converged)
        for row in result.rank.join(nodes, "id").orderBy(F.desc("rank"), "id").limit(10).collect():
            print(f"{row['rank']:.3e}", row.title)


def _priors(spark, path: str, kind: str):
    """``auto`` is pagerank when ranks were saved, else none."""
    if kind == "none":
        return None
    try:
        ranks = spark.read.parquet(f"{path}/ranks")
    except Exception:
        if kind == "auto":
            return None
        raise
    return rank.prior(ranks, "pagerank" if kind == "auto" else kind)


if __name__ == "__main__":
    main()
