"""One-feature least squares from sufficient statistics: models whose fits are sums, so that updates are sums too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.operators.sampling import last_rows

def sums(df: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """n and the sums from which any merge of groups can be fitted."""
    a, b = F.col(x), F.col(y)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))


def solved(stats: DataFrame, ridge: float = 0.0) -> DataFrame:
    """``stats`` with slope and intercept; ``ridge`` penalises the slope."""
    sxx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n") + ridge
    sxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    out = stats.withColumn("slope", F.when(sxx != 0, sxy / sxx).otherwise(0.0))
    return out.withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))


NAMES = ("n", "sx", "sy", "sxx", "sxy")


def cumulative(stats: DataFrame) -> DataFrame:
    """Sums over all batches up to each: a full retraining without its rows. A row per batch is ordered."""
    w = W.orderBy("batch_id")
    return stats.select("batch_id", *(F.sum(c).over(w).alias(c) for c in NAMES))


def with_fifo(df: DataFrame, stats: DataFrame, capacity: int = 500) -> DataFrame:
    """Sums over each batch and a first-in-first-out buffer before it: the last ``capacity`` learned rows.

    Of each batch only its last ``capacity`` rows can be in a later buffer, so those alone are ordered.
    """
    tails = last_rows(df.select("batch_id", "row_id", "x", "y"), ["batch_id"], capacity)
    later = stats.select(F.col("batch_id").alias("t"))
    recent = tails.join(F.broadcast(later), F.col("batch_id") < F.col("t"))
    place = F.row_number().over(W.partitionBy("t").orderBy(F.desc("batch_id"), F.desc("row_id")))
    buffer = sums(recent.withColumn("k", place).where(F.col("k") <= capacity), ["t"]).withColumnRenamed("t", "batch_id")
    return stats.unionByName(buffer).groupBy("batch_id").agg(*(F.sum(c).alias(c) for c in NAMES))


def predicted(df: DataFrame, models: DataFrame, on: Column | list[str]) -> DataFrame:
    """``df`` with p from models of a row per batch."""
    m = models.select(F.col("batch_id").alias("m_batch"), "slope", "intercept")
    joined = df.join(F.broadcast(m), on) if not isinstance(on, list) else df.join(F.broadcast(m.withColumnRenamed("m_batch", on[0])), on)
    return joined.withColumn("p", F.col("intercept") + F.col("slope") * F.col("x"))


