"""Synthetic families of the benchmark, as column expressions over a range of row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.hashing import normal, uniform


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id")


def _sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def family1(spark: SparkSession, n: int = 4000, features: int = 10, noise: float = 0.5, seed: int = 42) -> DataFrame:
    """Smooth regression with an interaction, a square and two linear terms of uniform features."""
    x = _rows(spark, n).select("row_id", *(uniform(f"f1.{seed}.{i}", "row_id").alias(f"x_{i}") for i in range(features)))
    c = F.col
    signal = 10.0 * F.sin(math.pi * c("x_0") * c("x_1")) + 20.0 * F.pow(c("x_2") - 0.5, F.lit(2.0)) + 10.0 * c("x_3") + 5.0 * c("x_4")
    return x.withColumn("target", signal + noise * normal(f"f1.{seed}.e", "row_id"))


def family2(spark: SparkSession, n: int = 4000, features: int = 12, seed: int = 42) -> DataFrame:
    """Classes with a boundary of linear, product and square terms of normal features."""
    x = _rows(spark, n).select("row_id", *(normal(f"f2.{seed}.{i}", "row_id").alias(f"feat_{i}") for i in range(features)))
    c = lambda i: F.col(f"feat_{i}")
    z = 1.5 * c(0) - 2.0 * c(1) + 3.0 * c(2) * c(3) - 1.2 * c(4) * c(4) + 0.4 * normal(f"f2.{seed}.e", "row_id")
    return x.withColumn("target", (uniform(f"f2.{seed}.u", "row_id") < _sigmoid(z)).cast("int"))


#: The features that count in the third family, with their coefficients.
ACTIVE = {2: 4.0, 7: -3.5, 15: 2.0, 25: -2.5, 38: 5.0}


def family3(spark: SparkSession, n: int = 4000, features: int = 40, rho: float = 0.5, seed: int = 42) -> DataFrame:
    """Sparse regression on features whose correlation falls off by ``rho`` a step: each leans on the one before it."""
    x = _rows(spark, n).withColumn("dim_0", normal(f"f3.{seed}.0", "row_id"))
    for i in range(1, features):
        x = x.withColumn(f"dim_{i}", rho * F.col(f"dim_{i - 1}") + math.sqrt(1 - rho * rho) * normal(f"f3.{seed}.{i}", "row_id"))
    signal = sum((b * F.col(f"dim_{i}") for i, b in ACTIVE.items()), F.lit(0.0))
    return x.withColumn("target", signal + normal(f"f3.{seed}.e", "row_id"))


#: Weights of the tiers, and the shares of tiers and groups.
TIERS = {"Alpha": 1.5, "Beta": 0.5, "Gamma": -0.8, "Delta": -1.8}
TIER_SHARES = (0.4, 0.3, 0.2, 0.1)
ZONES = ("North", "South", "East", "West")
GROUP_SHARES = (0.5, 0.3, 0.2)


def _pick(seed: str, names: tuple[str, ...] | list[str], shares: tuple[float, ...]) -> Column:
    u, total = uniform(seed, "row_id"), 0.0
    out = F.lit(names[-1])
    bounds = []
    for name, share in zip(names, shares, strict=True):
        total += share
        bounds.append((name, total))
    for name, bound in reversed(bounds[:-1]):
        out = F.when(u < bound, name).otherwise(out)
    return out


def family4(spark: SparkSession, n: int = 4000, features: int = 8, seed: int = 42) -> DataFrame:
    """Classes by numbers and a tier, with zones and subgroups beside them."""
    x = _rows(spark, n).select(
        "row_id", *(normal(f"f4.{seed}.{i}", "row_id").alias(f"num_{i}") for i in range(features)),
        _pick(f"f4.{seed}.t", list(TIERS), TIER_SHARES).alias("cat_tier"), _pick(f"f4.{seed}.z", ZONES, (0.25,) * 4).alias("cat_zone"),
        _pick(f"f4.{seed}.g", [f"Group_{i}" for i in range(3)], GROUP_SHARES).alias("subgroup_id"),
    )
    weight = F.element_at(F.create_map(*(F.lit(v) for kv in TIERS.items() for v in kv)), F.col("cat_tier"))
    c = lambda i: F.col(f"num_{i}")
    z = 1.8 * c(0) - 1.4 * c(1) + 0.8 * c(2) * c(3) + weight + 0.5 * normal(f"f4.{seed}.e", "row_id")
    return x.withColumn("target", (uniform(f"f4.{seed}.u", "row_id") < _sigmoid(z)).cast("int"))


def family5(spark: SparkSession, n: int = 4000, features: int = 10, seed: int = 42) -> DataFrame:
    """Regression whose noise grows with the distance from the origin."""
    x = _rows(spark, n).select("row_id", *((4.0 * uniform(f"f5.{seed}.{i}", "row_id") - 2.0).alias(f"var_{i}") for i in range(features)))
    c = lambda i: F.col(f"var_{i}")
    norm = F.sqrt(c(0) * c(0) + c(1) * c(1) + c(2) * c(2))
    signal = 3.0 * F.tanh(c(0)) + 2.0 * c(1) - 1.5 * c(2) * c(2)
    return x.withColumn("target", signal + normal(f"f5.{seed}.e", "row_id") * (0.3 + 0.5 * norm))


FAMILIES = {"gen_family1": family1, "gen_family2": family2, "gen_family3": family3, "gen_family4": family4, "gen_family5": family5}
