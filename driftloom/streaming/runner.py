"""Structured Streaming runner: micro-batches in, versioned state out, safe to stop and to start again."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftloom.functions.hashing import rank_key
from driftloom.model import AdaptiveModel
from driftloom.operators import drift
from driftloom.operators.drift import DriftConfig


@dataclass(frozen=True)
class StreamRunner:
    """Drift monitoring of a stream of (row_id, features...): one version of state per micro-batch under ``state``.

    ``state/reference/batch=N`` holds the bounded reference sample after batch N, ``state/report/batch=N`` its scores against
    the version before. A batch reads version N-1 and overwrites version N, so that a repeated batch gives the same files:
    sources' offsets are in the query's checkpoint, and every write is idempotent.
    """

    state: str
    features: tuple[str, ...]
    config: DriftConfig = DriftConfig()

    def _path(self, name: str, batch: int) -> str:
        return f"{self.state.rstrip('/')}/{name}/batch={batch}"

    def process(self, batch: DataFrame, number: int) -> None:
        """Detect against the reference of the version before, then let the reference learn."""
        spark = batch.sparkSession
        rows = batch.select(F.lit(number).alias("batch_id"), "row_id", *(F.col(f).cast("double").alias(f) for f in self.features))
        if number == 0:
            sample = drift.reference_sample(rows, self.config.reference_size)
        else:
            old = spark.read.parquet(self._path("reference", number - 1))
            scores = drift.feature_scores(drift.long_form(rows, ["batch_id"], list(self.features)), drift.long_form(old, [], list(self.features)), ["batch_id"], ["feature"], self.config)
            scores.write.mode("overwrite").parquet(self._path("report", number))
            own = drift.reference_sample(rows, self.config.reference_size)
            # two bounded samples: the smallest hashes of both are those of all rows so far
            sample = old.unionByName(own).orderBy(rank_key("ref", "row_id"), "row_id").limit(self.config.reference_size)
        sample.coalesce(1).write.mode("overwrite").parquet(self._path("reference", number))

    def start(self, source: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def reports(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.state.rstrip('/')}/report").parquet(f"{self.state.rstrip('/')}/report/batch=*").drop("batch")


@dataclass(frozen=True)
class StreamLearner:
    """The adaptive learner on a stream: each micro-batch is scored, then learned: drift, CUSUM, policy, replay and trees.

    ``state/model/batch=N`` holds the model after batch N, ``state/report/batch=N`` the report and action of that batch. A
    batch reads version N-1 and overwrites version N, so that a repeated batch, or a query that is started again, goes on
    from what was learned. A batch without rows hands the version on.
    """

    state: str
    model: AdaptiveModel = field(default_factory=AdaptiveModel)
    target: str = "target"

    def _path(self, name: str, batch: int) -> str:
        return f"{self.state.rstrip('/')}/{name}/batch={batch}"

    def _before(self, spark: SparkSession, number: int) -> AdaptiveModel:
        if number == 0:
            return replace(self.model, reports=[])
        return AdaptiveModel.load(spark, self._path("model", number - 1))

    def process(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        model = self._before(spark, number)
        if not batch.isEmpty():
            if model.state is None:
                report = {"batch": number, "first": True}
                model.initialize(batch, self.target)
            else:
                report = {"batch": number} | model.update(batch)
            spark.createDataFrame([(json.dumps(report),)], "report string").coalesce(1).write.mode("overwrite").parquet(self._path("report", number))
        model.save(spark, self._path("model", number))

    def start(self, source: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def learned(self, spark: SparkSession) -> AdaptiveModel:
        """The model after the last batch that was written."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.state.rstrip('/')}/model")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        last = max(int(f.getPath().getName().split("=")[1]) for f in found)
        return AdaptiveModel.load(spark, self._path("model", last))

    def reports(self, spark: SparkSession) -> list[dict]:
        """Reports of all batches, in order: a row each."""
        root = f"{self.state.rstrip('/')}/report"
        rows = spark.read.option("basePath", root).parquet(f"{root}/batch=*").orderBy("batch").collect()
        return [json.loads(r["report"]) for r in rows]
