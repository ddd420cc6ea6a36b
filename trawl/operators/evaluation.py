"""Offline evaluation of rankings: run(qid, docid, score) against qrels(qid, docid, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trec_order(run: DataFrame) -> DataFrame:
    """``run`` with ``rank``: by score, ties to the larger document id as text."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(F.col("docid").cast("string")))
    return run.withColumn("rank", F.row_number().over(w))


def judged_queries(qrels: DataFrame) -> DataFrame:
    """Queries with a positive grade; only these are averaged."""
    return qrels.where("grade > 0").select("qid").distinct()


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg) of the judged queries; gains are grades as they are, 0 without results."""
    gain = F.sum(F.col("grade") / F.log2(F.col("rank") + 1))
    found = trec_order(run).where(F.col("rank") <= k).join(qrels, ["qid", "docid"]).groupBy("qid").agg(gain.alias("dcg"))
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade")))
    ideal = qrels.where("grade > 0").withColumn("rank", ideal_rank).where(F.col("rank") <= k).groupBy("qid").agg(gain.alias("idcg"))
    return ideal.join(found, "qid", "left").select("qid", (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"))


def recall(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    """(qid, recall): share of the positive documents within the first k."""
    good = qrels.where("grade > 0")
    found = trec_order(run).where(F.col("rank") <= k).join(good, ["qid", "docid"]).groupBy("qid").agg(F.count("*").alias("f"))
    all_ = good.groupBy("qid").agg(F.count("*").alias("n"))
    return all_.join(found, "qid", "left").select("qid", (F.coalesce("f", F.lit(0)) / F.col("n")).alias("recall"))


def evaluate(run: DataFrame, qrels: DataFrame, ndcg_at: int = 10, recall_at: int = 100) -> DataFrame:
    """One row of macro averages: n_queries, ndcg, recall."""
    both = ndcg(run, qrels, ndcg_at).join(recall(run, qrels, recall_at), "qid")
    return both.agg(F.count("*").alias("n_queries"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"))


def known_item(run: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """One row: n, success_1, success_k, mrr for queries with one right document; targets (qid, docid)."""
    hit = trec_order(run).join(targets, ["qid", "docid"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    r = F.col("rank")
    return targets.select("qid").distinct().join(hit, "qid", "left").agg(
        F.count("*").alias("n"), F.avg(F.coalesce((r == 1).cast("int"), F.lit(0))).alias("success_1"),
        F.avg(F.coalesce((r <= k).cast("int"), F.lit(0))).alias("success_k"), F.avg(F.when(r <= k, 1 / r).otherwise(0.0)).alias("mrr"),
    )


def weight_sweep(scored: DataFrame, targets: DataFrame, weights: list[float], digits: int | None = None) -> DataFrame:
    """(w, success_1, mrr) of score + w prior for each weight; scored has (qid, docid, score, prior).

    The grid is a literal array; the right document's rank is one plus the number of better ones.
    """
    grid = scored.select("*", F.explode(F.array(*map(F.lit, weights))).alias("w"))
    value = F.col("score") + F.col("w") * F.col("prior")
    grid = grid.withColumn("final", F.round(value, digits) if digits is not None else value)
    w = Window.partitionBy("qid", "w").orderBy(F.desc("final"), "docid")
    ranked = grid.withColumn("rank", F.row_number().over(w)).join(targets, ["qid", "docid"])
    n = targets.select("qid").distinct().agg(F.count("*").alias("n"))
    sums = ranked.groupBy("w").agg(F.sum((F.col("rank") == 1).cast("int")).alias("s"), F.sum(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)).alias("m"))
    return sums.crossJoin(n).select("w", (F.col("s") / F.col("n")).alias("success_1"), (F.col("m") / F.col("n")).alias("mrr"))


def best_weight(sweep: DataFrame) -> float:
    """Highest success, ties to the smaller weight."""
    return sweep.orderBy(F.desc("success_1"), "w").first()["w"]


def duplicate_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision and recall of flagged ids; found (id), truth (id), 1 when there is nothing to be right about."""
    f, t = found.select("id").distinct().withColumn("f", F.lit(1)), truth.select("id").distinct().withColumn("t", F.lit(1))
    both = f.join(t, "id", "full").agg(F.count("f").alias("found"), F.count("t").alias("true"), F.count_if((F.col("f") == 1) & (F.col("t") == 1)).alias("right"))
    return both.select("found", "true", "right", F.when(F.col("found") > 0, F.col("right") / F.col("found")).otherwise(1.0).alias("precision"), F.when(F.col("true") > 0, F.col("right") / F.col("true")).otherwise(1.0).alias("recall"))


def duplicate_clusters(pages: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: flagged, right, copies, found, precision, recall of duplicate marks against true clusters.

    ``pages`` (url, dup_of) are those that were stored, ``truth`` (url, cluster).
    A mark is right when both pages are of one cluster; of each cluster with n
    stored pages n - 1 are copies that should be marked. Rates of nothing are 1.
    """
    named = pages.select("url", "dup_of").join(truth.select("url", "cluster"), "url")
    other = truth.select(F.col("url").alias("dup_of"), F.col("cluster").alias("c"))
    marks = named.where("dup_of is not null").join(other, "dup_of", "left")
    told = marks.agg(F.count("*").alias("flagged"), F.count_if(F.col("cluster") == F.col("c")).alias("right"))
    copies = named.groupBy("cluster").agg((F.count("*") - 1).alias("n"), F.count("dup_of").alias("f"))
    there = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("copies"), F.coalesce(F.sum(F.least("n", "f")), F.lit(0)).alias("found"))
    one = told.crossJoin(there)  # one row each
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    return one.select("flagged", "right", "copies", "found", rate("right", "flagged").alias("precision"), rate("found", "copies").alias("recall"))


def politeness_violations(gaps: DataFrame, delay: float) -> int:
    """Hosts of ``host_gaps`` whose least gap is under the delay."""
    return gaps.where(F.col("min_gap") < delay).count()


def compare_to(measured: DataFrame, published: dict[str, float]) -> DataFrame:
    """measured (dataset, ndcg) with the published value and the difference."""
    table = measured.sparkSession.createDataFrame(list(published.items()), "dataset string, published double")
    return measured.join(F.broadcast(table), "dataset", "left").withColumn("delta", F.col("ndcg") - F.col("published"))
