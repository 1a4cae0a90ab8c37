"""The benchmark grid: streams as DataFrames, a grouped map per stream and model, roll-ups as aggregations."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.hashing import hash_bin
from driftloom.operators import metrics, sampling, shifts
from driftloom.plans import lifecycle
from driftloom.plans.learners import Booster
from driftloom.sources import generators
from driftloom.sources.stored import ship, stored

#: Numeric and categorical columns and the task of each family.
FAMILIES = {
    "gen_family1": ([f"x_{i}" for i in range(10)], [], "regression"), "gen_family2": ([f"feat_{i}" for i in range(12)], [], "binary_classification"),
    "gen_family3": ([f"dim_{i}" for i in range(40)], [], "regression"), "gen_family4": ([f"num_{i}" for i in range(8)], ["cat_tier", "cat_zone"], "binary_classification"),
    "gen_family5": ([f"var_{i}" for i in range(10)], [], "regression"),
}


def classification_environments(df: DataFrame, columns: list[str]) -> DataFrame:
    """The six environments of a stream of classes: as for regressions, with flipped labels for new interactions and noise, and
    a bootstrap to 15 % positives for the prior. One aggregation serves all batches' moments and medians, one mark all flips."""
    a, b, c = columns[:3]
    col, batch = F.col, F.col("batch_id")
    stats = df.groupBy("batch_id").agg(*(f(x).alias(f"{n}_{x}") for x in (a, b, c) for n, f in (("avg", F.avg), ("std", F.stddev_samp))), F.median(a).alias("mid_a"), F.median(b).alias("mid_b"))
    m = df.join(stats, "batch_id")
    third = np.pi / 3
    moved = lambda x: col(f"avg_{x}") + 2.2 * col(f"std_{x}") + 1.8 * (col(x) - col(f"avg_{x}"))
    wide = lambda x: col(f"avg_{x}") + 2.0 * (col(x) - col(f"avg_{x}"))
    new = {
        a: F.when(batch == 1, moved(a)).when(batch == 4, np.cos(third) * col(a) - np.sin(third) * col(b)).when(batch == 5, wide(a)).otherwise(col(a)),
        b: F.when(batch == 1, moved(b)).when(batch == 4, np.sin(third) * col(a) + np.cos(third) * col(b)).when(batch == 5, wide(b)).otherwise(col(b)),
        c: F.when(batch == 5, wide(c) + 3.6 * col(f"std_{c}")).otherwise(col(c)),
    }
    # stretching keeps the order, so the medians' sides are those of the columns as they came
    pool = F.when(batch == 3, (col(a) > col("mid_a")) & (col(b) > col("mid_b"))).when(batch == 4, True).when(batch == 5, col(b) > col("mid_b")).otherwise(False)
    m = m.select(*(x for x in df.columns if x not in new), pool.alias("pool"), *(v.alias(k) for k, v in new.items()))
    rate = F.when(batch == 3, 0.40).when(batch == 4, 0.10).otherwise(0.35)
    m = sampling.mark_by_hash(m, ["batch_id", "pool"], F.when(col("pool"), F.floor(rate * col("group_rows"))).otherwise(0), "flip", "_one")
    m = sampling.mark_by_hash(m, ["batch_id"], F.when(batch == 5, F.floor(0.08 * col("group_rows"))).otherwise(0), "flip5", "_two")
    flips = col("_one").cast("int") + col("_two").cast("int")
    m = m.withColumn("target", F.pmod(col("target") + flips, F.lit(2)).cast("int")).select(*df.columns)
    drawn = shifts.prior_shift(df.where("batch_id = 2").withColumnRenamed("target", "y"), 0.15, "prior").select("row_id")
    return m.where("batch_id <> 2").unionByName(drawn.join(df.where("batch_id = 2"), "row_id").select(*df.columns))


def stream(spark: SparkSession, family: str, batch: int, seed: int) -> DataFrame:
    """dataset, seed, batch_id, row_id, is_eval, features (encoded with statistics of the first batch), y. Hidden rows are drawn by
    the id of the source row, so that copies of a row are on one side."""
    numeric, categories, task = FAMILIES[family]
    df = stored(generators.FAMILIES[family](spark, 6 * batch, seed=seed).withColumn("batch_id", F.floor(F.col("row_id") / batch).cast("int")), family)
    if task == "regression":
        df = shifts.environment_stream(df.withColumnRenamed("target", "y"), tuple(numeric[:3])).withColumnRenamed("y", "target")
    else:
        df = classification_environments(df, numeric)
    df = stored(df, f"{family}-shifted")
    key = sampling.mark_by_hash(df.select("batch_id", "row_id").distinct(), ["batch_id"], F.greatest(F.lit(10), F.floor(F.col("group_rows") * 0.2)), f"grid{seed}", "is_eval")
    stats = df.where("batch_id = 0").agg(*(F.struct(F.avg(c).alias("m"), F.greatest(F.stddev_samp(c), F.lit(1e-4)).alias("s")).alias(f"z_{c}") for c in numeric))
    values = [F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(c) - F.col(f"z_{c}.m")) / F.col(f"z_{c}.s"))) for c in numeric]
    values += [F.when(hash_bin(c) == i, 1.0).otherwise(0.0) for c in categories for i in range(16)]
    out = df.join(F.broadcast(stats)).join(key, ["batch_id", "row_id"])  # one row of statistics
    group = F.col("subgroup_id") if "subgroup_id" in df.columns else F.lit("")
    return out.select(F.lit(family).alias("dataset"), F.lit(task).alias("task"), F.lit(seed).alias("seed"), "batch_id", "row_id", "is_eval", group.alias("subgroup"), F.array(*values).alias("features"), F.col("target").cast("double").alias("y"))


_RESULT = "dataset string, task string, seed int, model string, batch_id int, n_update int, n_eval int, perf double, accuracy double, f1 double, brier double, ece double, gap double, retention double, seconds double, state_bytes long, severity string, rate double, specialist_weight double, anchor_trees int, specialist_trees int, replay_rows int"
#: What a clock measures, or the machine: not the same in any two runs.
MEASURED = ("seconds", "state_bytes")


def _batches(part: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    out = []
    for _, b in part.sort_values(["batch_id", "row_id"]).groupby("batch_id"):
        x, y, hidden = np.stack(b["features"].to_numpy()).astype(float), b["y"].to_numpy(float), b["is_eval"].to_numpy(bool)
        out.append((x[~hidden], y[~hidden], x[hidden], y[hidden], b["subgroup"].to_numpy(str)[hidden]))
    return out


def run_grid(spark: SparkSession, families: list[str], seeds: list[int], models: list[str] | dict[str, Callable], batch: int) -> DataFrame:
    """A row per stream, model and batch. Streams and models are independent groups; a group is six bounded batches.

    ``models`` are names of learners, or names with callables that make any learner from task and seed.
    """
    ship(spark)
    made = models if isinstance(models, dict) else {name: name for name in models}
    with ThreadPoolExecutor(4) as pool:  # streams are built by jobs of their own, side by side
        built = list(pool.map(lambda k: stream(spark, k[0], batch, k[1]), [(f, s) for f in families for s in seeds]))
    rows = stored(reduce(DataFrame.unionByName, built), "grid")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        head = part.iloc[0]
        out = pd.DataFrame(lifecycle.prequential(_batches(part), head["task"], made[head["model"]], int(head["seed"])))
        for c in ("dataset", "task", "seed", "model"):
            out[c] = head[c]
        return out

    return rows.withColumn("model", F.explode(F.array(*map(F.lit, made)))).groupBy("dataset", "seed", "model").applyInPandas(run, _RESULT)


def runs(results: DataFrame) -> DataFrame:
    """Per stream and model: score, shifted performance, degradation, retention, calibration, fairness, time and memory."""
    keyed = results.withColumn("key", F.concat_ws("/", "dataset", "seed", "model"))
    robust = metrics.robustness(keyed.select(F.col("key").alias("model"), "batch_id", "perf")).withColumnRenamed("model", "key")
    more = keyed.groupBy("key", "dataset", "task", "seed", "model").agg(
        F.avg("brier").alias("brier"), F.avg("ece").alias("ece"), F.avg("gap").alias("gap"), F.avg("seconds").alias("seconds"), F.sum("seconds").alias("seconds_total"),
        F.max("state_bytes").alias("state_bytes"), F.max_by("retention", "batch_id").alias("retention"),
    )
    score = metrics.multi_objective(F.col("mean_shifted"), F.col("max_degradation"), F.col("brier"), F.col("gap"), F.col("seconds"))
    out = robust.join(more, "key").withColumn("score", score)
    return out.select("dataset", "task", "seed", "model", "score", "mean_shifted", "worst_shifted", "max_degradation", "retention", "brier", "ece", "gap", "seconds", "seconds_total", "state_bytes")


def summarize(results: DataFrame) -> DataFrame:
    """Per model: runs, score (mean and deviation), and the means of what ``runs`` has."""
    return runs(results).groupBy("model").agg(
        F.count("*").alias("runs"), F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_std"),
        *(F.avg(c).alias(c) for c in ("mean_shifted", "worst_shifted", "max_degradation", "retention", "brier", "ece", "gap", "seconds", "state_bytes")),
    )


# -- registered queries --------------------------------------------------------------------------------------------------


def gbt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees of the first batch of two streams, as a table of nodes."""
    return _trees(spark, later=False)


def gbt_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trees with ten more, fitted to the second batch's gradients and appended."""
    return _trees(spark, later=True)


def _trees(spark: SparkSession, later: bool) -> DataFrame:
    ship(spark)
    rows = stream(spark, "gen_family1", 400, 42).unionByName(stream(spark, "gen_family2", 400, 42)).where("batch_id < 2 and not is_eval")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        first, second = (_batches(part[part["batch_id"] == k])[0][:2] for k in (0, 1))
        model = Booster(part["task"].iloc[0]).fit(*first, 25, 0.05, 1.5)
        if later:
            model.extend(*second, 10, 0.05, 1.5)
        out = pd.DataFrame(model.rows(), columns=["tree_id", "node_id", "feature", "threshold", "left", "right", "value"])
        out.insert(0, "dataset", part["dataset"].iloc[0])
        return out

    return rows.groupBy("dataset").applyInPandas(fit, "dataset string, tree_id int, node_id int, feature int, threshold double, left int, right int, value double")


#: Seeds and batch sizes of the reference's three studies.
BENCH_SEEDS, STUDY_SEEDS = (42, 101, 777), (42, 101)
BENCH_BATCH, ABLATION_BATCH, CANDIDATE_BATCH = 1000, 1000, 800


def lifecycle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initialisation and five updates of the adaptive learner on each family."""
    return run_grid(spark, list(FAMILIES), [42], ["adaptive"], 500).drop(*MEASURED)


def ablations(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = STUDY_SEEDS, batch: int = ABLATION_BATCH) -> DataFrame:
    """The adaptive learner and five versions of it without one part, on all families, by model."""
    return summarize(run_grid(spark, list(FAMILIES), list(seeds), list(lifecycle.ABLATIONS), batch))


def candidates(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = STUDY_SEEDS, batch: int = CANDIDATE_BATCH) -> DataFrame:
    """The three candidates and the adaptive learner side by side, on all families, by model."""
    return summarize(run_grid(spark, list(FAMILIES), list(seeds), [*lifecycle.CANDIDATES, "adaptive"], batch))


def candidate(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_grid(spark, list(FAMILIES), list(STUDY_SEEDS), [name], CANDIDATE_BATCH).drop(*MEASURED)

    return run


def bench_grid(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...] = BENCH_SEEDS, batch: int = BENCH_BATCH) -> DataFrame:
    """All families, the adaptive learner and its baselines, by model."""
    return summarize(run_grid(spark, list(FAMILIES), list(seeds), ["adaptive", *lifecycle.BASELINES], batch))


Q = {"gbt_fit": gbt_fit, "gbt_incremental": gbt_incremental, "lifecycle": lifecycle_query, "ablations": ablations, "candidates": candidates, "cand_mlp": candidate("mlp"), "cand_booster": candidate("booster"), "bench_grid": bench_grid}
