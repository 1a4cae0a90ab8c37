"""The stability and plasticity policy: what a drift report makes of the next update."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.numeric import clip


@dataclass(frozen=True)
class PolicyConfig:
    min_rate: float = 0.10
    max_rate: float = 1.00
    min_replay: float = 0.15
    max_replay: float = 0.50
    trees: int = 25
    rate: float = 0.05
    l2: float = 1.5


def actions(report: DataFrame, config: PolicyConfig | None = None) -> DataFrame:
    """Per batch: adaptation_rate, specialist_weight, anchor_weight, replay_blend_ratio, n_new_trees, learning_rate, l2 and
    description, from overall, concept, confidence, alarm and drift_type."""
    p = config or PolicyConfig()
    s, c, k, alarm = clip(F.col("overall"), 0, 1), clip(F.col("concept"), 0, 1), clip(F.col("confidence"), 0, 1), F.col("alarm")
    e = clip(s * (0.5 + 0.5 * k), 0, 1)
    out = report.withColumn("e", F.when(alarm, clip(e + 0.20 * F.greatest(c, F.lit(0.5)), 0, 1)).otherwise(e))
    e = F.col("e")
    out = out.withColumn("adaptation_rate", p.min_rate + (p.max_rate - p.min_rate) * e)
    w = clip(0.08 + 0.78 * e, 0.05, 0.85)
    out = out.withColumn("specialist_weight", F.when(alarm, F.least(F.lit(0.90), w + 0.10)).otherwise(w))
    replay = p.max_replay - (p.max_replay - p.min_replay) * e
    rate = F.col("adaptation_rate")
    text = F.when(F.col("drift_type") == "compound", "reset the specialist, refresh replay").when(F.col("drift_type") == "concept", "reset the specialist")
    text = text.when(F.col("drift_type") == "covariate", "extend both models").otherwise("keep the anchor")
    return out.select(
        "batch_id", "severity", "drift_type", rate, "specialist_weight", (1.0 - F.col("specialist_weight")).alias("anchor_weight"),
        F.when(alarm, F.greatest(F.lit(p.min_replay), replay - 0.05)).otherwise(replay).alias("replay_blend_ratio"),
        F.greatest(F.lit(5), F.bround(F.lit(float(p.trees)) * (0.60 + rate)).cast("int")).alias("n_new_trees"),
        (p.rate * (0.75 + 0.75 * rate)).alias("learning_rate"), (p.l2 * (1.35 - 0.55 * rate)).alias("l2"), text.alias("description"),
    )


def training_sizes(n, held, replay_ratio: float, rate: float):
    """Rows of the replay buffer for the specialist and of the batch for the anchor, from the rows of both: numbers or columns."""
    if isinstance(n, Column):
        low, high, floor = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(F.lit(a), b)), F.floor
        choose = lambda some, none: F.when(held > 0, some).otherwise(none)
    else:
        low, high, floor = min, max, int
        choose = lambda some, none: some if held > 0 else none
    special = choose(low(held, high(8, floor(n * replay_ratio))), 0 * n)
    anchor = choose(high(8, low(n, floor(n * max(0.10, 0.20 * rate)))), high(8, floor(n * 0.5)))
    return special, anchor
