"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.index import with_doc_ids

ARTICLE = (
    "title string, namespace int, text string, incoming_links bigint, popularity_score double, "
    "redirect array<struct<namespace: int, title: string>>, outgoing_link array<string>"
)


def articles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Articles of a gzipped search dump (an index line before each document): namespace 0, text not empty, in file order.

    A gzip file is one task; its lines are numbered there and dealt out afterwards.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).where(~F.col("value").startswith('{"index"'))
    rows = lines.select("at", F.from_json("value", ARTICLE).alias("d")).select("at", "d.*")
    rows = rows.where((F.coalesce("namespace", F.lit(0)) == 0) & (F.coalesce("text", F.lit("")) != ""))
    rows = with_doc_ids(rows.withColumn("title", F.coalesce("title", F.lit(""))), "at").drop("at")
    rows = rows.withColumns({"incoming_links": F.coalesce("incoming_links", F.lit(0)), "popularity_score": F.coalesce("popularity_score", F.lit(0.0))})
    return rows if limit is None else rows.where(F.col("doc_id") < limit)


def article_documents(spark: SparkSession, path: str, limit: int | None = None, site: str = "https://simple.wikipedia.org/wiki/") -> DataFrame:
    """(doc_id, url, title, text) of the same articles."""
    url = F.concat(F.lit(site), F.replace(F.col("title"), F.lit(" "), F.lit("_")))
    return articles(spark, path, limit).select("doc_id", url.alias("url"), "title", "text")


def beir_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, url, title, text) of corpus.jsonl, the identifier as url."""
    rows = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    rows = rows.select(F.col("_id").alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return with_doc_ids(rows, "url")


def beir_queries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("qid"), "text")


def beir_qrels(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    names = ("qid string, docid string, grade int")
    return spark.read.schema(names).option("sep", "\t").option("header", True).option("enforceSchema", True).csv(f"{folder}/qrels/{split}.tsv")


def indexable_pages(pages: DataFrame, main_content: bool = True) -> DataFrame:
    """(doc_id, url, title, text) of stored pages that answered well, are no duplicates and may be indexed, in order of fetching."""
    text = F.coalesce(F.nullif(F.col("main_text"), F.lit("")), F.col("text")) if main_content and "main_text" in pages.columns else F.col("text")
    good = pages.where("status between 200 and 299 and dup_of is null and not noindex")
    rows = good.select("url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("text"), "fetched_at")
    return with_doc_ids(rows, "fetched_at", "url").drop("fetched_at")


def page_html(pages: DataFrame, url: str) -> str | None:
    row = pages.where(F.col("url") == url).select("html").first()
    return row.html if row else None
