"""Drift statistics against NumPy, golden values of the formulas, and the detector's three classic cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import drift, metrics, policy
from driftloom.plans import lifecycle

RNG = np.random.default_rng(7)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, *map(float, row)) for i, row in enumerate(x)], ["row_id", *(f"c{j}" for j in range(x.shape[1]))])


def test_psi_golden(spark):
    hist = spark.createDataFrame([(1, "a", 100, 2, 1, 30), (1, "a", 100, 2, 2, 70)], "batch_id int, feature string, n long, bins int, bin int, c long")
    ref = spark.createDataFrame([("a", 100, 2, 1, 50), ("a", 100, 2, 2, 50)], "feature string, n long, bins int, bin int, c long")
    assert drift.psi(hist, ref, ["batch_id"], ["feature"]).first()["psi"] == pytest.approx(0.169452, abs=1e-6)


@pytest.mark.parametrize("bins", [5, 20])
def test_bins_of_any_number(spark, bins):
    """Every value is in a bin, whatever their number; edges of more bins than named are an error."""
    x, y = RNG.normal(size=(300, 2)), RNG.normal(size=(1000, 2)) * 0.7
    config, names = drift.DriftConfig(bins=bins), ["c0", "c1"]
    cur, ref = drift.long_form(frame(spark, y).withColumn("batch_id", F.lit(1)), ["batch_id"], names), drift.long_form(frame(spark, x), [], names)
    edges = drift.reference_summary(ref, bins=bins)
    hist = drift.histogram(ref, edges, ["feature"], ["feature"], bins).toPandas()
    for j, name in enumerate(names):
        e = np.array(edges.where(F.col("feature") == name).first()["edges"])
        assert hist[hist["feature"] == name].sort_values("bin")["c"].tolist() == np.histogram(x[:, j], e)[0].tolist()
        assert hist[hist["feature"] == name]["c"].sum() == 300
    got = {r["feature"]: r["score"] for r in drift.feature_scores(cur, ref, ["batch_id"], ["feature"], config).collect()}
    for j, name in enumerate(names):
        assert got[name] == pytest.approx(lifecycle.feature_score(x[:, j], y[:, j], config), abs=1e-6)
    with pytest.raises(Exception, match="more than 3 bins"):
        drift.histogram(ref, edges, ["feature"], ["feature"], 3).collect()


def test_cusum_golden(spark):
    b = spark.createDataFrame([(1, 100, 0.1), (2, 100, 0.4)], "batch_id int, n long, z double")
    rows = {r["batch_id"]: r for r in drift.cusum(b).collect()}
    assert rows[1]["t"] == pytest.approx(1.0) and not rows[1]["alarm"]
    assert rows[2]["t"] == pytest.approx(4.0) and rows[2]["alarm"] and rows[2]["concept"] == pytest.approx(4 / 3.5)


def test_scores_equal_numpy_and_cases(spark):
    ref, same, moved = RNG.normal(size=(250, 3)), RNG.normal(size=(500, 3)), RNG.normal(size=(500, 3)) + np.array([3.0, 0, 0])
    names = ["c0", "c1", "c2"]
    cur = frame(spark, same).withColumn("batch_id", F.lit(1)).unionByName(frame(spark, moved, 1000).withColumn("batch_id", F.lit(2)))
    r = frame(spark, ref)
    got = {(x["batch_id"], x["feature"]): x["score"] for x in drift.feature_scores(drift.long_form(cur, ["batch_id"], names), drift.long_form(r, [], names), ["batch_id"], ["feature"]).collect()}
    for b, x in ((1, same), (2, moved)):
        for j in range(3):
            assert got[b, f"c{j}"] == pytest.approx(lifecycle.feature_score(ref[:, j], x[:, j], drift.DriftConfig()), abs=1e-6)
    z = spark.createDataFrame([(i, float(v)) for i, v in enumerate(RNG.normal(size=200))], "row_id long, r double")
    res = cur.select("batch_id", (F.when(F.col("batch_id") == 2, 5.0).otherwise(0.0) + F.col("c2")).alias("r"))
    out = {x["batch_id"]: x for x in drift.report(cur, r, res, z, names).collect()}
    assert out[1]["overall"] < 0.35 and out[2]["severity"] == "high" and out[2]["alarm"] and out[2]["drift_type"] in ("concept", "compound")
    assert out[2]["confidence"] == pytest.approx(1 - math.exp(-10))


def test_degenerate_edges(spark):
    x = spark.createDataFrame([("k", 2.0)] * 20 + [("b", float(i % 2)) for i in range(20)], "feature string, x double")
    got = {r["feature"]: r for r in drift.reference_summary(x).collect()}
    assert got["k"]["edges"] == pytest.approx(list(np.linspace(1, 3, 11))) and got["k"]["std"] == 1.0
    assert got["b"]["edges"][0] < 0 and got["b"]["edges"][-1] > 1
    assert drift.reference_summary(x.where("false")).count() == 0


def test_policy_golden(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 1.0, False, "none", "none"), (1, 1.0, 1.0, 1.0, True, "high", "compound")], "batch_id int, overall double, concept double, confidence double, alarm boolean, severity string, drift_type string")
    a, b = sorted(policy.actions(rows).collect(), key=lambda r: r["batch_id"])
    assert (a["adaptation_rate"], a["specialist_weight"], a["replay_blend_ratio"], a["n_new_trees"]) == pytest.approx((0.10, 0.08, 0.50, 18))
    assert (a["learning_rate"], a["l2"]) == pytest.approx((0.04125, 1.9425))
    assert (b["adaptation_rate"], b["specialist_weight"], b["replay_blend_ratio"], b["n_new_trees"], b["learning_rate"], b["l2"]) == pytest.approx((1.0, 0.90, 0.15, 40, 0.075, 1.2))
    got = lifecycle.action_of({"overall": 1.0, "concept": 1.0, "alarm": True, "severity": "high", "confidence": 1.0}, policy.PolicyConfig())
    assert got["trees"] == 40 and got["specialist"] == pytest.approx(0.9)


def test_composite_golden(spark):
    row = spark.range(1).select(
        metrics.multi_objective(F.lit(0.8), F.lit(0.1), F.lit(0.15), None, F.lit(0.05)).alias("a"), metrics.multi_objective(F.lit(-2.0), F.lit(1.0), F.lit(0.0), None, F.lit(0.1)).alias("b")
    ).first()
    assert row["a"] == pytest.approx(0.878849, abs=1e-6) and row["b"] == pytest.approx(0.640909, abs=1e-6)


def test_metrics_edges(spark):
    one = spark.createDataFrame([(0, 1, 0.2), (0, 1, 0.9), (1, 0, 0.3), (1, 1, 0.3), (1, 1, 1.0)], "batch_id int, y int, p double")
    got = {r["batch_id"]: r["auc"] for r in metrics.auc(one).collect()}
    assert got[0] == 0.5 and got[1] == pytest.approx(0.75)
    y = np.array([0, 1, 1])
    assert lifecycle.auc(y, np.array([0.3, 0.3, 1.0])) == pytest.approx(0.75)
    ece = {r["batch_id"]: r["ece"] for r in metrics.calibration_error(one).collect()}
    assert ece[0] == pytest.approx((0.8 + 0.1) / 2)
