"""Sinks, configuration and command line of the studies, learners of one's own, and the measures of a run."""

import json

import numpy as np
import pandas as pd
import pytest

from driftloom import __main__ as command
from driftloom.plans import harness, lifecycle, report
from driftloom.sources.config import _plain, load_config


def test_grid_with_groups_and_own_learner(spark):
    class Mean:
        """A learner of one's own."""

        def __init__(self, task, seed):
            self.m = None

        def initialize(self, x, y):
            self.m = y.mean()

        update = initialize

        def predict(self, x):
            return np.full(len(x), self.m)

    out = harness.run_grid(spark, ["gen_family4"], [42], {"mean": Mean, "static": "static"}, 120)
    rows = out.toPandas()
    assert len(rows) == 12 and set(rows["model"]) == {"mean", "static"}
    assert rows["gap"].notna().all() and rows["gap"].between(0, 1).all() and (rows["state_bytes"] > 0).all()
    assert rows[["accuracy", "f1", "brier", "ece"]].apply(lambda c: c.between(0, 1)).all().all()
    runs = harness.runs(out).toPandas()
    assert (runs["gap"] > 0).any() and (runs["seconds_total"] >= runs["seconds"]).all()
    with pytest.raises(ValueError):
        lifecycle.learner("nothing", "regression", 0)


def test_measures_by_hand():
    y, p = np.array([1, 1, 0, 0, 1.0]), np.array([0.9, 0.4, 0.2, 0.8, 0.7])
    got = lifecycle.class_scores(y, p)
    assert got["accuracy"] == pytest.approx(0.6) and got["f1"] == pytest.approx(2 / 3)
    assert got["brier"] == pytest.approx(np.mean((p - y) ** 2)) and got["ece"] == pytest.approx((0.1 + 0.6 + 0.2 + 0.8 + 0.3) / 5)
    assert lifecycle.subgroup_gap(y, p, np.array(["a"] * 5), "binary_classification") == 0.0
    assert lifecycle.subgroup_gap(y, p, np.array([""] * 5), "regression") is None


def test_study_files(spark, tmp_path):
    said = []
    runs = report.run_study(spark, "candidate", [42], 100, tmp_path / "out", ["gen_family1"], said.append)
    assert len(runs) == 4 and len(said) == 4 + 1 + 2
    detail = pd.read_csv(tmp_path / "out" / "candidate_results.csv")
    assert list(detail.columns) == list(runs.columns) and len(detail) == 4
    summary = pd.read_csv(tmp_path / "out" / "candidate_summary.csv", header=[0, 1], index_col=0)
    assert ("score", "mean") in summary.columns and ("score", "std") in summary.columns and len(summary) == 4


def test_configuration(tmp_path):
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")
    (tmp_path / "a.yaml").write_text("# seeds\nseeds: [42, 101]\nbatch_size: 100 # rows\noutput_dir: 'here'\n")
    want = {"seeds": [42, 101], "batch_size": 100, "output_dir": "here"}
    assert load_config(tmp_path / "a.yaml") == want == _plain((tmp_path / "a.yaml").read_text())
    (tmp_path / "b.json").write_text(json.dumps(want))
    assert load_config(tmp_path / "b.json") == want
    (tmp_path / "c.yaml").write_text("")
    assert load_config(tmp_path / "c.yaml") == {}
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError):
        load_config(tmp_path / "d.json")


def test_command_line(spark, tmp_path, monkeypatch):
    got = []
    monkeypatch.setattr(report, "run_study", lambda *a: got.append(a[1:]))
    (tmp_path / "c.json").write_text(json.dumps({"seeds": [7], "batch_size": 50}))
    command.main(["ablation", "--config", str(tmp_path / "c.json"), "--batch_size", "60", "--output_dir", "o"])
    command.main([])
    assert got == [("ablation", [7], 60, "o", None), ("benchmark", None, None, "results", None)]
