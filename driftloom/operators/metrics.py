"""Batch metrics, calibration, fairness, robustness over a stream, and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.functions.numeric import clip


def regression(df: DataFrame, by: str = "batch_id", y: str = "y", p: str = "p") -> DataFrame:
    """n, mse, rmse, mae, r2 (0 for one row or a constant target) and primary, -rmse."""
    e = F.col(y) - F.col(p)
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"))
    r2 = F.when((F.col("n") <= 1) | (F.col("v") <= 1e-8), 0.0).otherwise(1.0 - F.col("mse") / F.col("v"))
    return out.select(by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), (-F.sqrt("mse")).alias("primary"))


def auc(df: DataFrame, by: str = "batch_id", y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve by mid-ranks; 0.5 with one class. Equal scores are counted before they are ranked, so that a
    batch's window has a row per distinct score."""
    c = df.groupBy(by, clip(F.col(p), 1e-6, 1 - 1e-6).alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    w = W.partitionBy(by).orderBy("s")
    below = F.sum(F.col("n") - F.col("pos")).over(w) - (F.col("n") - F.col("pos"))
    wins = F.col("pos") * (below + 0.5 * (F.col("n") - F.col("pos")))
    out = c.withColumn("wins", wins).groupBy(by).agg(F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    return out.select(by, F.when((F.col("pos") == 0) | (F.col("neg") == 0), 0.5).otherwise(F.col("wins") / (F.col("pos") * F.col("neg"))).alias("auc"))


def calibration_error(df: DataFrame, by: str = "batch_id", y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Expected calibration error over even bins, half-open but for the last; bounds are compared as literals."""
    at = F.lit(0)
    for i in range(1, bins):
        at = F.when(F.col(p) >= i / bins, i).otherwise(at)
    b = df.withColumn("bin", at).groupBy(by, "bin").agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("acc"), F.avg(p).alias("conf"))
    return b.groupBy(by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, by: str = "batch_id", y: str = "y", p: str = "p") -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.groupBy(by).agg(F.avg(e * e).alias("brier"))


def classification(df: DataFrame, by: str = "batch_id", y: str = "y", p: str = "p") -> DataFrame:
    """n, accuracy and f1 of p > 0.5 (0 where undefined), auc, brier, ece and primary, the auc."""
    hit, one = (F.col(p) > 0.5).cast("int"), F.col(y).cast("int")
    e = F.col(p) - F.col(y)
    base = df.groupBy(by).agg(
        F.count("*").alias("n"), F.avg((hit == one).cast("double")).alias("accuracy"), F.sum(hit * one).alias("tp"),
        F.sum(hit * (1 - one)).alias("fp"), F.sum((1 - hit) * one).alias("fn"), F.avg(e * e).alias("brier"),
    )
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    out = base.withColumn("f1", F.when(d > 0, 2.0 * F.col("tp") / d).otherwise(0.0)).join(auc(df, by, y, p), by).join(calibration_error(df, by, y, p), by)
    return out.select(by, "n", "accuracy", "f1", "auc", "brier", "ece", F.col("auc").alias("primary"))


def fairness(df: DataFrame, group: str, by: str = "batch_id", y: str = "y", p: str = "p", least: int = 5, task: str = "classification") -> DataFrame:
    """Per batch: groups of at least ``least`` rows, the worst one's accuracy (or -rmse) and the gap to the best."""
    e = F.col(y) - F.col(p)
    value = F.avg(((F.col(p) > 0.5).cast("int") == F.col(y)).cast("double")) if task == "classification" else -F.sqrt(F.avg(e * e))
    g = df.groupBy(by, group).agg(F.count("*").alias("n"), value.alias("v")).where(F.col("n") >= least)
    return g.groupBy(by).agg(F.count("*").alias("groups"), F.min("v").alias("worst"), (F.max("v") - F.min("v")).alias("gap"))


def robustness(results: DataFrame, model: str = "model") -> DataFrame:
    """Over a stream's batches (a row each, column perf): baseline, mean, worst and best of the later ones, their population
    deviation, and the greatest fall below the baseline. A single batch is its own later one."""
    first = F.min_by("perf", "batch_id")
    base = results.groupBy(model).agg(first.alias("baseline"), F.min("batch_id").alias("b0"), F.count("*").alias("batches"))
    later = results.join(base, model).where((F.col("batch_id") > F.col("b0")) | (F.col("batches") == 1))
    return later.groupBy(model).agg(
        F.first("baseline").alias("baseline"), F.avg("perf").alias("mean_shifted"), F.min("perf").alias("worst_shifted"), F.max("perf").alias("best_shifted"),
        F.stddev_pop("perf").alias("volatility"), F.max(F.greatest(F.lit(0.0), F.col("baseline") - F.col("perf"))).alias("max_degradation"),
    )


WEIGHTS = {"performance": 0.40, "robustness": 0.25, "calibration": 0.15, "fairness": 0.10, "efficiency": 0.10}


def multi_objective(perf: Column, degradation: Column, brier_: Column, gap: Column | None, latency: Column, weights: dict[str, float] | None = None) -> Column:
    """The composite of five parts in [0, 1]; a gap that is null or absent counts as perfectly fair."""
    w = weights or WEIGHTS
    parts = {
        "performance": clip(F.when(perf > 0, perf).otherwise(1.0 / (1.0 + F.abs(perf))), 0, 1),
        "robustness": clip(1.0 - degradation / F.greatest(F.lit(1.0), F.abs(perf) + 1.0), 0, 1),
        "calibration": clip(1.0 - brier_, 0, 1),
        "fairness": F.lit(1.0) if gap is None else F.coalesce(clip(1.0 - gap, 0, 1), F.lit(1.0)),
        "efficiency": 1.0 / (1.0 + latency),
    }
    return clip(sum((w[k] * v for k, v in parts.items()), F.lit(0.0)), 0, 1)
