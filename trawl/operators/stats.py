"""Rank statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators import ordered

#: Distinct differences that reach the driver.
MOST_VALUES = 100_000


def average_ranks(df: DataFrame, value: str, out: str = "avg_rank") -> DataFrame:
    """``df`` with ranks from 1, ties sharing their mean.

    Values are counted first and the running count is over distinct values,
    summed within ranges and then over ranges, so no task sees all rows.
    """
    counted = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    dealt = counted.repartitionByRange("_v").withColumn("_p", F.spark_partition_id())
    from trawl.operators.session import checkpointed

    dealt = checkpointed(dealt)
    base = dealt.groupBy("_p").agg(F.sum("_n").alias("_s"))
    # One row a partition.
    base = base.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    upto = F.sum("_n").over(Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = dealt.withColumn("_u", upto).join(F.broadcast(base), "_p").select("_v", (F.col("_base") + F.col("_u") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, df[value].eqNullSafe(ranks["_v"])).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ``rho``: Pearson's correlation of average ranks."""
    return average_ranks(average_ranks(df, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("rho"))


def top_k_overlap(df: DataFrame, a: str, b: str, k: int, id_col: str = "id") -> DataFrame:
    """One row, ``overlap``: share of k in both tops, ties to the smaller id; k divides even when there are fewer rows."""
    first = df.orderBy(F.desc(a), id_col).limit(k).select(id_col)
    second = df.orderBy(F.desc(b), id_col).limit(k).select(id_col)
    return first.join(second, id_col).agg((F.count("*") / F.lit(k)).alias("overlap"))


def nearest_rank(df: DataFrame, group: str, value: str, percents: list[float]) -> DataFrame:
    """(group, p, value): element min(n - 1, floor(p n / 100)) of the sorted values, no interpolation.

    Distinct values are counted and summed over ranges, so a group of any size is spread over tasks.
    """
    counted = df.groupBy(group, value).agg(F.count("*").alias("n"))
    placed = ordered.running_sum(ordered.dealt(counted, [group], [value]), [group], [value], "n", "upto").drop(ordered.RANGE)
    total = counted.groupBy(F.col(group).alias("_g")).agg(F.sum("n").alias("total"))
    wanted = total.select("_g", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("p"), "total")
    wanted = wanted.withColumn("at", F.least(F.col("total") - 1, F.floor(F.col("p") / 100 * F.col("total"))))
    met = placed.join(wanted, F.col(group).eqNullSafe(F.col("_g")))
    return met.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select(group, "p", F.col(value).alias("value"))


def mcnemar_exact(fixed: int, broken: int) -> float:
    """Two-sided exact p-value of the discordant counts."""
    n, k = fixed + broken, min(fixed, broken)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def mcnemar(df: DataFrame, before: Column, after: Column) -> tuple[int, int, float]:
    """(fixed, broken, p) of two success columns."""
    row = df.agg(F.count_if(~before & after).alias("f"), F.count_if(before & ~after).alias("b")).first()
    return row.f, row.b, mcnemar_exact(row.f, row.b)


def bootstrap_interval(df: DataFrame, difference: Column, resamples: int = 5000, seed: int = 42) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of the mean difference over resamples.

    Resampling rows is drawing the counts of the distinct differences from a
    multinomial. Up to ``MOST_VALUES`` of them reach the driver; with more, each
    row draws a Poisson count for each resample where it lies, and only the sums
    of the resamples do.
    """
    counts = df.groupBy(difference.alias("d")).count()
    rows = counts.limit(MOST_VALUES + 1).collect()
    if not rows:
        return 0.0, 0.0
    if len(rows) > MOST_VALUES:
        means = _poisson_means(df.select(difference.cast("double").alias("d")), resamples, seed)
    else:
        values, held = np.array([r.d for r in rows], float), np.array([r["count"] for r in rows])
        means = np.random.default_rng(seed).multinomial(held.sum(), held / held.sum(), resamples) @ values / held.sum()
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def _poisson_means(rows: DataFrame, resamples: int, seed: int) -> np.ndarray:
    """The mean of each of the resamples of a large column."""

    def run(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums, held = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            d = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(d), 512):
                drawn = rng.poisson(1.0, (resamples, len(d[i : i + 512])))
                sums += drawn @ d[i : i + 512]
                held += drawn.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(sums), pa.array(held)], ["k", "s", "n"])

    parts = rows.where("d is not null").mapInArrow(run, "k long, s double, n double")
    summed = parts.groupBy("k").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1.0))).alias("m"))
    return np.array([r.m for r in summed.collect()])


def weighted_sample(df: DataFrame, weight: str, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, probability by weight (exponential keys from a hash of the id)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return df.where(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), id_col).limit(n)
