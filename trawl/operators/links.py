"""Link graphs, degrees and PageRank."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.session import checkpointed


def normalize_title(title: Column) -> Column:
    """Underscores as spaces, trimmed, the first character upper-case."""
    t = F.trim(F.replace(title, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substr(t, F.lit(1), F.lit(1))), F.substr(t, F.lit(2)))


def names(articles: DataFrame) -> DataFrame:
    """(name, id) of articles (doc_id, title, redirect array of (namespace, title)).

    The last article of a title has it; an alias goes to the first article that
    claims it and never replaces a title. Null namespaces count as 0.
    """
    titles = articles.select(normalize_title(F.coalesce("title", F.lit(""))).alias("name"), F.col("doc_id").alias("id"), F.lit(0).alias("kind"), (-F.col("doc_id")).alias("turn"))
    told = articles.select("doc_id", F.explode("redirect").alias("r")).where(F.coalesce("r.namespace", F.lit(0)) == 0)
    aliases = told.select(normalize_title(F.col("r.title")).alias("name"), F.col("doc_id").alias("id"), F.lit(1).alias("kind"), F.col("doc_id").alias("turn"))
    return titles.union(aliases).groupBy("name").agg(F.min_by("id", F.struct("kind", "turn")).alias("id"))


def resolved(articles: DataFrame) -> DataFrame:
    """(src, dst) per outgoing link; dst is null when nothing has the name. Links of a page that repeat stay."""
    out = articles.select(F.col("doc_id").alias("src"), F.explode("outgoing_link").alias("l")).select("src", normalize_title(F.col("l")).alias("name"))
    return out.join(names(articles), "name", "left").select("src", F.col("id").alias("dst"))


def edges(articles: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self-links."""
    return resolved(articles).where("dst is not null and src <> dst").distinct()


def graph_stats(articles: DataFrame) -> DataFrame:
    """One row: articles, redirect_aliases, links_in_dump, edges, unresolved_links, self_links."""
    links = resolved(articles).agg(
        F.count("*").alias("links_in_dump"), F.count_if(F.col("dst").isNull()).alias("unresolved_links"),
        F.count_if(F.col("src") == F.col("dst")).alias("self_links"),
        F.count_distinct(F.when(F.col("src") != F.col("dst"), F.struct("src", "dst"))).alias("edges"),
    )
    alias = F.size(F.filter(F.coalesce("redirect", F.array()), lambda r: F.coalesce(r["namespace"], F.lit(0)) == 0))
    pages = articles.agg(F.count("*").alias("articles"), F.coalesce(F.sum(alias), F.lit(0)).alias("redirect_aliases"))
    return pages.crossJoin(links)  # one row each


def in_degree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, in_degree), zeros included."""
    n = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_n"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("_n", F.lit(0)).alias("in_degree"))


def out_degree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, out_degree, dangling), zeros included."""
    n = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_n"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("_n", F.lit(0)).alias("out_degree"), F.col("_n").isNull().alias("dangling"))


@dataclass
class PageRank:
    rank: DataFrame
    iterations: int
    converged: bool
    l1_history: list[float] = field(default_factory=list)


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, tol: float = 1e-10, max_iter: int = 200, fixed: int | None = None) -> PageRank:
    """Ranks (id, rank) that sum to one; dangling mass is spread evenly.

    Stops when the L1 change is under n * tol, after that iteration's ranks are
    taken. ``fixed`` runs exactly so many iterations. Edges are weighted and
    laid out once; an iteration joins the ranks on the source, sums by target
    and is checkpointed, and one aggregate gives its dangling mass and change.
    Parallel edges count as often as they occur.
    """
    n = nodes.count()
    if not n:
        return PageRank(nodes.select("id", F.lit(0.0).alias("rank")), 0, True)
    weighted = links.join(links.groupBy("src").agg(F.count("*").alias("_d")), "src").select("src", "dst", (1 / F.col("_d")).alias("w"))
    weighted = checkpointed(weighted)
    state = nodes.select("id").join(weighted.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True)), "id", "left")
    state = checkpointed(state.select("id", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    loose = state.agg(F.sum(F.when(F.col("dangling"), F.col("rank")))).first()[0] or 0.0
    history: list[float] = []
    for turn in range(1, (fixed or max_iter) + 1):
        moved = weighted.join(state, weighted["src"] == state["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("_in"))
        rank = F.lit(damping) * (F.coalesce("_in", F.lit(0.0)) + F.lit(loose / n)) + F.lit((1 - damping) / n)
        new = checkpointed(state.join(moved, state["id"] == moved["dst"], "left").select("id", "dangling", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("step")))
        change, loose = new.agg(F.sum("step"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        history.append(change)
        state = new.drop("step")
        if fixed is None and change < n * tol:
            return PageRank(state.select("id", "rank"), turn, True, history)
    return PageRank(state.select("id", "rank"), len(history), fixed is not None, history)


def copurchase_links(lineitem: DataFrame) -> DataFrame:
    """Distinct (src, dst): parts that follow each other in an order, by line number, then part."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = lineitem.select(F.col("l_partkey").alias("src"), after.alias("dst"))
    return pairs.where("dst is not null and src <> dst").distinct()
