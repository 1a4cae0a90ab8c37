"""The learner on DataFrames and on a stream: roles, missing values, labels, probabilities, plasticity, restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import driftloom
from driftloom import AdaptiveModel, Settings, StreamLearner, TaskSpec
from driftloom.functions.hashing import normal, uniform


def frame(spark, n, seed, slope=2.0):
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    rows = rows.select(*(normal(f"{seed}{c}", "row_id").alias(c) for c in "abc"), normal(f"{seed}e", "row_id").alias("e"))
    return rows.select("a", "b", "c", (slope * F.col("a") - 1.5 * F.col("b") + 0.2 * F.col("e")).alias("target"))


def test_exports():
    for name in driftloom.__all__:
        assert getattr(driftloom, name) is not None
    with pytest.raises(AttributeError):
        driftloom.nothing  # noqa: B018


def test_regression_and_updates(spark):
    model = AdaptiveModel(settings=Settings(capacity=150, history=3))
    with pytest.raises(RuntimeError):
        model.predict(frame(spark, 3, "x"))
    with pytest.raises(RuntimeError):
        model.update(frame(spark, 3, "x"))
    model.initialize(frame(spark, 200, "one"))
    assert model.task.task_type == "regression" and set(model.task.numerical) == {"a", "b", "c"}
    trees = [model.memory()["trees"]]
    for k in range(4):
        report = model.update(frame(spark, 150, f"u{k}"))
        assert report["severity"] in ("none", "low", "medium", "high") and report["rows"] == 150
        trees.append(model.memory()["trees"])
    assert model.updates == 4 and len(model.reports) == 3
    memory = model.memory()
    assert memory["replay_rows"] == model.replay(spark).count() == 150 and memory["reference_rows"] <= 256 and memory["state"] > 0
    test = frame(spark, 300, "test").withColumn("extra", F.lit("k"))
    out = model.predict(test)
    assert out.columns == [*test.columns, "prediction"]
    error = out.agg(F.sqrt(F.avg((F.col("prediction") - F.col("target")) ** 2)), F.stddev_pop("target"), F.count_if(F.col("prediction").isNull() | F.isnan("prediction"))).first()
    assert error[0] < 0.6 * error[1] and error[2] == 0
    with pytest.raises(TypeError):
        model.predict_proba(test)
    with pytest.raises(ValueError):
        model.predict(test.withColumn("prediction", F.lit(1)))


def test_classes_with_nulls_categories_and_labels(spark):
    rows = frame(spark, 300, "cls").withColumn("id", F.monotonically_increasing_id() % 50)
    label = F.when(F.col("a") + F.col("b") > 0, "yes").otherwise("no")
    rows = rows.select(F.when(F.col("id") % 9 == 0, None).otherwise(F.col("a")).alias("num.1"), F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("b")).alias("mean_c0"), F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("v"), F.col("id") % 3)).alias("row"), label.alias("label"))
    model = AdaptiveModel().initialize(rows, "label")
    assert model.task.task_type == "binary_classification" and model.task.pos_label == "yes" and model.task.categorical == ("row",)
    unseen = rows.withColumn("row", F.lit("unseen")).drop("mean_c0")
    model.update(rows.limit(120))
    p = model.predict_proba(unseen).select("p0", "p1").toPandas()
    assert len(p) == 300 and np.isfinite(p.to_numpy()).all() and np.allclose(p.sum(axis=1), 1) and p["p1"].between(0, 1).all()
    hit = model.predict(rows).agg(F.avg(((F.col("prediction") == 1) == (F.col("label") == "yes")).cast("double"))).first()[0]
    assert hit > 0.8
    assert model.predict(rows.where("false")).count() == 0
    assert model.update(rows.where("false")) == {"rows": 0}


def test_targets_are_not_features_and_bounds_hold(spark):
    one = frame(spark, 400, "one")
    a = AdaptiveModel(rows=100).initialize(one)
    assert "target" not in a.task.all_features and len(a.state) > 0
    with pytest.raises(ValueError):
        AdaptiveModel(TaskSpec("regression")).initialize(one.select("target"))
    with pytest.raises(ValueError):
        a.update(one.drop("target"))


def test_plasticity(spark):
    """A reversed relation is learned from one batch."""
    def rows(seed, new):
        x = spark.range(300).withColumnRenamed("id", "row_id").select(*((2 * uniform(f"{seed}{c}", "row_id") - 1).alias(c) for c in ("x0", "x1")))
        return x.withColumn("y", (-3.0 * F.col("x0") + 4.0 * F.sin("x1")) if new else 3.0 * F.col("x0"))

    model = AdaptiveModel(settings=Settings(capacity=150)).initialize(rows("a", False), "y")
    error = lambda df: model.predict(df).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    assert error(rows("t", False)) < 1.0
    report = model.update(rows("b", True))
    assert report["specialist"] > 0.30 and report["alarm"] and error(rows("t", True)) < 3.0 and error(rows("t", False)) < 3.0


def test_saved_and_streamed(spark, tmp_path):
    for k in range(3):
        frame(spark, 120, f"s{k}", 2.0 if k < 2 else -2.0).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    learner = StreamLearner(str(tmp_path / "state"), AdaptiveModel(settings=Settings(capacity=60)))

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        learner.start(source, str(tmp_path / "checkpoint")).awaitTermination()

    run()
    assert [r["batch"] for r in learner.reports(spark)] == [0, 1, 2] and learner.learned(spark).updates == 2
    frame(spark, 120, "s9", -2.0).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # goes on from version 2
    model = learner.learned(spark)
    assert model.updates == 3 and [r["batch"] for r in learner.reports(spark)] == [0, 1, 2, 3]
    learner.process(frame(spark, 120, "s9", -2.0), 3)  # a repeated batch gives the same version
    again = learner.learned(spark)
    test = frame(spark, 50, "t", -2.0)
    assert again.updates == 3 and again.predict(test).orderBy("a").collect() == model.predict(test).orderBy("a").collect()
