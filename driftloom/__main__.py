"""Command line: ``python -m driftloom benchmark --seeds 42 101 --batch_size 1000 --output_dir results``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from driftloom.plans import report
from driftloom.sources.config import load_config


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="driftloom", description="Run a study of the adaptive learner and its rivals.")
    parser.add_argument("study", nargs="?", choices=list(report.STUDIES))
    parser.add_argument("--seeds", nargs="+", type=int, help="random seeds")
    parser.add_argument("--batch_size", type=int, help="rows of a batch")
    parser.add_argument("--output_dir", help="folder of the CSV files (results)")
    parser.add_argument("--families", nargs="+", help="families of streams (all)")
    parser.add_argument("--config", help="file with any of these; what the command line has goes first")
    given = {k: v for k, v in vars(parser.parse_args(arguments)).items() if v is not None}
    values = (load_config(given["config"]) if "config" in given else {}) | given
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    report.run_study(spark, values.get("study", "benchmark"), values.get("seeds"), values.get("batch_size"), values.get("output_dir", "results"), values.get("families"))


if __name__ == "__main__":
    main()
