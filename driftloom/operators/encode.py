"""Leakage-safe feature encoding: statistics frozen on the first batch, running moments beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.functions.hashing import hash_bin
from driftloom.functions.numeric import clean, clip, missing


def batch_moments(df: DataFrame, columns: list[str], by: str = "batch_id") -> DataFrame:
    """Per batch and column: n of present values, mean and m2, the sum of squared deviations."""
    long = df.select(by, *(clean(c).alias(c) for c in columns)).unpivot([by], columns, "column", "x")
    return long.groupBy(by, "column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"))


def merged_moments(moments: DataFrame, by: str = "batch_id") -> DataFrame:
    """Moments of all batches up to each one: partial moments are merged by their sums, over a row per batch and column."""
    w = W.partitionBy("column").orderBy(by)
    n = F.sum("n").over(w)
    sx = F.sum(F.coalesce(F.col("n") * F.col("mean"), F.lit(0.0))).over(w)
    sxx = F.sum(F.coalesce(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))).over(w)
    out = moments.select(by, "column", n.alias("n"), sx.alias("sx"), sxx.alias("sxx"))
    mean = F.when(F.col("n") > 0, F.col("sx") / F.col("n"))
    return out.select(by, "column", "n", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("sxx") - F.col("n") * mean * mean).alias("m2"))


def frozen_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: of each column mean_c (0 if never seen), std_c (sample, at least 1e-4) and impute_c over ``df``."""
    aggs = []
    for c in columns:
        x = clean(c)
        mean = F.coalesce(F.avg(x), F.lit(0.0))
        std = F.sqrt(F.greatest(F.lit(1e-8), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)) / F.greatest(F.lit(1), F.count(x) - 1)))
        aggs += [mean.alias(f"mean_{c}"), std.alias(f"std_{c}"), mean.alias(f"impute_{c}")]
    return df.agg(*aggs)


def scaled(c: str, sigma: float = 8.0) -> Column:
    """The imputed, standardised and clipped value, beside the columns of ``frozen_stats``."""
    x = F.coalesce(clean(c), F.col(f"impute_{c}"))
    return clip((x - F.col(f"mean_{c}")) / F.greatest(F.col(f"std_{c}"), F.lit(1e-8)), -sigma, sigma)


def with_spec(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with exactly the frozen columns: missing ones as null, others dropped."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def feature_names(numerical: list[str], categorical: list[str], bins: int = 16) -> list[str]:
    out = [f"{c}_{s}" for c in numerical for s in ("scaled", "isna")]
    return out + [f"{c}_hash_{i}" for c in categorical for i in range(bins)]


def encode(df: DataFrame, stats: DataFrame, keys: list[str], numerical: list[str], categorical: list[str], bins: int = 16) -> DataFrame:
    """Keys and all features: scaled values and missing marks, then hashed one-hot bins. Targets are never read; the one row of
    statistics is broadcast."""
    cols: list[Column] = [F.col(k) for k in keys]
    for c in numerical:
        cols += [scaled(c).alias(f"{c}_scaled"), missing(c).cast("double").alias(f"{c}_isna")]
    for c in categorical:
        b = hash_bin(c, bins)
        cols += [F.when(b == i, 1.0).otherwise(0.0).alias(f"{c}_hash_{i}") for i in range(bins)]
    return with_spec(df, [*keys, *numerical, *categorical]).join(F.broadcast(stats)).select(*cols)


def running_histogram(df: DataFrame, column: str, bins: int = 16, by: str = "batch_id") -> DataFrame:
    """A category's bin counts up to each batch; bins of all batches so far have a row."""
    counts = df.groupBy(by, hash_bin(column, bins).alias("bin")).agg(F.count("*").alias("n"))
    batches, every = df.select(by).distinct(), counts.select("bin").distinct()
    grid = batches.join(F.broadcast(every))  # batches times at most ``bins``
    w = W.partitionBy("bin").orderBy(by)
    return grid.join(counts, [by, "bin"], "left").select(by, "bin", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n")).where("n > 0")
