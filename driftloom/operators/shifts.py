"""Operators that shift a stream's distribution. Statistics are those of a row's batch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.hashing import hash_int, normal
from driftloom.operators.sampling import mark_by_hash, place_by_hash


def batch_moments(df: DataFrame, columns: list[str], by: str = "batch_id") -> DataFrame:
    """``df`` with mean and sample deviation of each column in its batch (avg_c, std_c; a deviation of zero is 1).

    An aggregation and a join with its few rows, rather than a window that gathers a batch in one task.
    """
    std = lambda c: F.stddev_samp(c)
    stats = df.groupBy(by).agg(*(F.avg(c).alias(f"avg_{c}") for c in columns), *(F.when(std(c) > 0, std(c)).otherwise(1.0).alias(f"std_{c}") for c in columns))
    return df.join(stats, by)


def mean_shift(df: DataFrame, columns: list[str], size: float = 2.0, by: str = "batch_id") -> DataFrame:
    """Move columns by ``size`` standard deviations."""
    out = batch_moments(df, columns, by)
    return out.withColumns({c: F.col(c) + size * F.col(f"std_{c}") for c in columns}).select(*df.columns)


def scale_shift(df: DataFrame, columns: list[str], factor: float = 2.5, by: str = "batch_id") -> DataFrame:
    """Stretch columns about their mean."""
    out = batch_moments(df, columns, by)
    return out.withColumns({c: F.col(f"avg_{c}") + factor * (F.col(c) - F.col(f"avg_{c}")) for c in columns}).select(*df.columns)


def rotation_shift(df: DataFrame, pair: tuple[str, str], theta: float = math.pi / 4) -> DataFrame:
    a, b = map(F.col, pair)
    return df.withColumns({pair[0]: math.cos(theta) * a - math.sin(theta) * b, pair[1]: math.sin(theta) * a + math.cos(theta) * b})


def concept_shift(y: Column, a: Column, b: Column, gain: float = 3.0) -> Column:
    """A new interaction in a regression target."""
    return y + gain * F.sin(a * b)


def noise_shift(y: Column, sigma: float, seed: str, row_id: str = "row_id") -> Column:
    return y + sigma * normal(seed, row_id)


def flip_labels(df: DataFrame, rate: float, seed: str, label: str = "y", by: str = "batch_id", where: Column | None = None) -> DataFrame:
    """Flip int(rate x rows) labels of each batch among the rows that ``where`` admits, drawn by hash."""
    admitted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    marked = mark_by_hash(df.where(admitted), [by], F.floor(F.lit(rate) * F.col("group_rows")), seed, "_flip")
    out = marked.unionByName(df.where(~admitted).withColumn("_flip", F.lit(False)))
    return out.withColumn(label, F.when(F.col("_flip"), 1 - F.col(label)).otherwise(F.col(label))).select(*df.columns)


def concept_flip(df: DataFrame, columns: list[str], rate: float, seed: str, label: str = "y", by: str = "batch_id") -> DataFrame:
    """Flip labels in the subspace where all ``columns`` are over their batch's median."""
    middle = df.groupBy(by).agg(*(F.median(c).alias(f"mid_{c}") for c in columns))
    joined = df.join(middle, by)
    inside = F.lit(True)
    for c in columns:
        inside = inside & (F.col(c) > F.col(f"mid_{c}"))
    return flip_labels(joined, rate, seed, label, by, inside).select(*df.columns)


def prior_shift(df: DataFrame, ratio: float, seed: str, label: str = "y", by: str = "batch_id") -> DataFrame:
    """A bootstrap of each batch with a share of ``ratio`` positive rows: slot, row_id and label of each draw.

    Each of a batch's slots draws, by hash, a place among the rows of its class; places are hash order within a class.
    """
    pool = place_by_hash(df.select(by, "row_id", label), [by, label], seed, "place")
    sizes = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("n1"))
    # slots by thousands, so that no array holds all of a batch's
    blocks = sizes.select(by, "n", "n1", F.floor(F.col("n") * ratio).alias("want1"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1000))).alias("block"))
    slots = blocks.select(by, "n", "n1", "want1", F.explode(F.sequence(1000 * F.col("block"), F.least(1000 * F.col("block") + 999, F.col("n") - 1))).alias("slot"))
    slots = slots.withColumn(label, (F.col("slot") < F.col("want1")).cast("int"))
    among = F.when(F.col(label) == 1, F.col("n1")).otherwise(F.col("n") - F.col("n1"))
    draw = hash_int(F.concat_ws(":", F.lit(f"{seed}s"), F.col(by).cast("string"), F.col("slot").cast("string")))
    slots = slots.where(among > 0).withColumn("place", F.pmod(draw, among))
    return slots.join(pool, [by, label, "place"]).select(by, F.col("slot").cast("int").alias("slot"), "row_id", label)


#: The environment schedule: what each batch undergoes, in order.
ENVIRONMENTS = ("baseline", "covariate", "prior", "concept", "rotation_noise", "compound")


def environment_stream(df: DataFrame, features: tuple[str, str, str] = ("x0", "x1", "x2")) -> DataFrame:
    """The six environments on a regression stream's batches 0 to 5 (other batches stay), named in env.

    1: the first two features 2.2 deviations up, then stretched by 1.8. 2: target up by 3.5. 3: interaction of gain 4.
    4: rotation by a third of pi and noise of 1.8. 5: three features stretched by 2, the third 1.8 deviations up, then an
    interaction of gain 3.5 between second and third, and noise of 1.2.
    """
    a, b, c = features
    m = batch_moments(df, list(features))
    batch, col = F.col("batch_id"), F.col
    third = math.pi / 3

    def moved(f: str) -> Column:
        return col(f"avg_{f}") + 2.2 * col(f"std_{f}") + 1.8 * (col(f) - col(f"avg_{f}"))

    def stretched(f: str) -> Column:
        return col(f"avg_{f}") + 2.0 * (col(f) - col(f"avg_{f}"))

    new = {
        f"n_{a}": F.when(batch == 1, moved(a)).when(batch == 4, math.cos(third) * col(a) - math.sin(third) * col(b)).when(batch == 5, stretched(a)).otherwise(col(a)),
        f"n_{b}": F.when(batch == 1, moved(b)).when(batch == 4, math.sin(third) * col(a) + math.cos(third) * col(b)).when(batch == 5, stretched(b)).otherwise(col(b)),
        f"n_{c}": F.when(batch == 5, stretched(c) + 1.8 * 2.0 * col(f"std_{c}")).otherwise(col(c)),
    }
    m = m.withColumns(new)
    y = F.when(batch == 2, col("y") + 3.5).when(batch == 3, concept_shift(col("y"), col(a), col(b), 4.0)).when(batch == 4, noise_shift(col("y"), 1.8, "e4"))
    y = y.when(batch == 5, noise_shift(concept_shift(col("y"), col(f"n_{b}"), col(f"n_{c}"), 3.5), 1.2, "e5")).otherwise(col("y"))
    names = F.element_at(F.array(*map(F.lit, ENVIRONMENTS)), F.least(batch, F.lit(5)) + 1)
    return m.select(*(c_ for c_ in df.columns if c_ not in (*features, "y")), *(col(f"n_{f}").alias(f) for f in features), y.alias("y"), names.alias("env"))
