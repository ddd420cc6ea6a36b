"""Writers: pages, links, run logs, graphs and ranks as Parquet."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert_pages(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """The last row of each URL by fetched_at; new rows win ties."""
    both = new.withColumn("_new", F.lit(1))
    if stored is not None:
        both = both.unionByName(stored.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def insert_links(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """The set of (src, dst)."""
    return (new if stored is None else stored.unionByName(new)).select("src", "dst").distinct()


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def log_run(spark: SparkSession, path: str, stats: dict, started_at: float, ended_at: float | None = None) -> None:
    """Append (started_at, ended_at, stats as JSON)."""
    row = [(float(started_at), float(ended_at or time.time()), json.dumps(stats))]
    spark.createDataFrame(row, "started_at double, ended_at double, stats string").coalesce(1).write.mode("append").parquet(path)


def last_run(spark: SparkSession, path: str) -> dict | None:
    row = spark.read.parquet(path).orderBy(F.desc("ended_at")).first()
    return json.loads(row.stats) if row else None


def save_graph(nodes: DataFrame, links: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    links.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_ranks(ranks: DataFrame, path: str) -> None:
    ranks.write.mode("overwrite").parquet(path)
