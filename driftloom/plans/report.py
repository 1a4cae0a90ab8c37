"""Reports of the benchmark studies: detail and summary as CSV files, and a table on the console."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.plans import harness, lifecycle

#: Columns of the summary: what is shown of each column of the detail, by model.
SUMMARY = {"score": ["mean", "std"], "mean_shifted": ["mean"], "worst_shifted": ["mean"], "max_degradation": ["mean"], "retention": ["mean"], "seconds": ["mean"], "state_kb": ["mean"]}
#: The studies: models, seeds and rows of a batch.
STUDIES = {
    "benchmark": (["adaptive", *lifecycle.BASELINES], harness.BENCH_SEEDS, harness.BENCH_BATCH),
    "ablation": (list(lifecycle.ABLATIONS), harness.STUDY_SEEDS, harness.ABLATION_BATCH),
    "candidate": ([*lifecycle.CANDIDATES, "adaptive"], harness.STUDY_SEEDS, harness.CANDIDATE_BATCH),
}


def detail(results: DataFrame) -> pd.DataFrame:
    """A row per stream and model, numbers to four digits; as many rows as the study has runs, so it is collected."""
    rows = harness.runs(results).withColumn("state_kb", F.col("state_bytes") / 1024.0).drop("state_bytes")
    return rows.orderBy("dataset", "seed", "model").toPandas().round(4)


def summary(runs: pd.DataFrame) -> pd.DataFrame:
    """By model, under two levels of column names: column and statistic."""
    return runs.groupby("model").agg(SUMMARY).round(4)


def write(runs: pd.DataFrame, folder: str | Path, study: str) -> tuple[Path, Path]:
    """``<study>_results.csv``, and ``<study>_summary.csv`` with its two header rows."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    paths = folder / f"{study}_results.csv", folder / f"{study}_summary.csv"
    runs.to_csv(paths[0], index=False)
    summary(runs).to_csv(paths[1])
    return paths


def run_study(spark: SparkSession, study: str, seeds: list[int] | None = None, batch: int | None = None, folder: str | Path | None = None, families: list[str] | None = None, say: Callable[[str], None] = print) -> pd.DataFrame:
    """Run a study, report each run and the summary, and write both if a folder is named."""
    models, own_seeds, own_batch = STUDIES[study]
    runs = detail(harness.run_grid(spark, families or list(harness.FAMILIES), list(seeds or own_seeds), models, batch or own_batch))
    for k, r in enumerate(runs.itertuples(), 1):
        say(f"[{k}/{len(runs)}] {r.model:16s} | {r.dataset} | seed {r.seed} | score {r.score:.4f} | mean perf {r.mean_shifted:.4f} | latency {r.seconds:.3f}s")
    say(summary(runs).to_string())
    if folder is not None:
        for path in write(runs, folder, study):
            say(f"saved to {path}")
    return runs
