"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``documents``.
Null texts count as empty, null languages and sources as values of their own;
repeated rows are judged alike, and near duplicates leave one row of each group.
Columns beyond those of ``documents`` are left out at the first stage, so none
can clash with an operator's own. Very long texts are whole at every stage; rows
of one id with different texts are documents of their own. An empty table stays
empty through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import jaccard, mixing, packing, quality, secrets
from trawl.llm.common import remove_path, shared_path
from trawl.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: runs of five words, Jaccard similarity 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and perplexity bands keep."""
    return quality.kept(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id: SimHash balls, then the exact similarity."""
    return jaccard.keep_representatives(docs, shingle=SHINGLE, similarity=SIMILARITY).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark."""
    cleaned = secrets.scan(docs, keep_text=True, redacted=True)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.resampled(docs, mixing.word_count(F.col("text")), F.array("source")).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: SQL can't express compression of counts into a language model, fingerprints or tokenisers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each table between them lies in the shared checkpoint folder until the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
