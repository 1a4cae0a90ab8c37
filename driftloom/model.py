"""The adaptive learner on DataFrames: encode, detect, learn and predict, with a state that is stored and read again."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.numeric import clean
from driftloom.operators import encode, sampling, spec
from driftloom.operators.spec import TaskSpec
from driftloom.plans import lifecycle
from driftloom.sources.stored import ship


@dataclass
class AdaptiveModel:
    """Initialize on a first DataFrame, update with later ones, predict any.

    Features are encoded by statistics frozen on the first DataFrame. A task on an executor learns from at most ``rows`` rows
    of each (those with the smallest hashes of all columns; a bounded sample by design, so that a batch of any size is
    learned in one task's memory) and returns the state: trees, replay buffer, drift reference and sums, all bounded. The
    driver keeps its bytes and the reports of the last batches. Rows without a target are not learned.
    """

    task: TaskSpec | None = None
    settings: lifecycle.Settings = field(default_factory=lifecycle.Settings)
    seed: int = 0
    rows: int = 20_000
    state: bytes | None = None
    stats: dict | None = None
    updates: int = 0
    reports: list[dict] = field(default_factory=list)

    # -- learning --------------------------------------------------------------------------------------------------

    def initialize(self, df: DataFrame, target: str = "target", subgroup: str | None = None) -> AdaptiveModel:
        """Learn a first DataFrame. Without a task, types and numbers of distinct values tell it."""
        task = (self.task or spec.infer_task_spec(df, target, subgroup)).with_roles(df)
        if not task.all_features:
            raise ValueError("no feature columns")
        self.task = task
        names = self._names()
        own = [names[c] for c in task.numerical]
        self.stats = encode.frozen_stats(df.select(*(F.col(f"`{c}`").alias(names[c]) for c in task.numerical)), own).first().asDict() if own else {}
        self.updates, self.reports = 0, []
        self._learn(df, None)
        return self

    def update(self, df: DataFrame) -> dict:
        """Detect drift against what was learned, adapt, and learn: the report and action of the batch."""
        if self.state is None:
            raise RuntimeError("update needs initialize")
        report = self._learn(df, self.state)
        self.updates += 1
        self.reports = [*self.reports, report][-self.settings.history :]
        return report

    def _learn(self, df: DataFrame, state: bytes | None) -> dict:
        spark = df.sparkSession
        ship(spark)
        task, settings, seed = self.task, self.settings, self.seed
        if task.target not in df.columns:
            raise ValueError(f"no column {task.target!r} to learn")
        target = F.col(f"`{task.target}`")
        y = clean(target) if task.task_type == "regression" else F.when(target.isNotNull(), (target == F.lit(task.pos_label)).cast("double"))
        known = self._encoded(df, F.struct(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType))).alias("row_id"), y.alias("y")))
        known = known.select("row.row_id", "row.y", "features").where("y is not null")
        some = sampling.take_by_hash(known, [], self.rows, f"learn{seed}")

        def learn(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("row_id")
            x, target = np.stack(part["features"].to_numpy()).astype(float), part["y"].to_numpy(float)
            model = lifecycle.Adaptive(task.task_type, settings, seed) if state is None else pickle.loads(state)
            report = (model.initialize(x, target) if state is None else model.update(x, target)) or {}
            return pd.DataFrame([(pickle.dumps(model), json.dumps(report | {"rows": len(part)}, default=float))], columns=["state", "report"])

        out = some.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "state binary, report string").first()
        if out is None:
            if state is None:
                raise ValueError("no row has a target")
            return {"rows": 0}
        self.state = bytes(out["state"])
        return json.loads(out["report"])

    # -- predicting ------------------------------------------------------------------------------------------------

    def _names(self) -> dict[str, str]:
        """Names for the features that no column made of them can clash with."""
        return {c: f"c{i}" for i, c in enumerate(self.task.all_features)}

    def _encoded(self, df: DataFrame, row: Column) -> DataFrame:
        """row, a value of ``row``'s expression, and features. Features a DataFrame lacks are missing."""
        names = self._names()
        kind = T.StructType([T.StructField(k, T.DoubleType()) for k in self.stats])
        stats = df.sparkSession.createDataFrame([tuple(map(float, self.stats.values()))], kind) if self.stats else df.sparkSession.range(1).select()
        plain = df.select(row.alias("row"), *((F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")).alias(n) for c, n in names.items()))
        own = [names[c] for c in self.task.numerical], [names[c] for c in self.task.categorical]
        return encode.encode(plain, stats, ["row"], *own).select("row", F.array(*encode.feature_names(*own)).alias("features"))

    def _predicted(self, df: DataFrame, names: dict[str, int | None]) -> DataFrame:
        """``df`` with columns: the prediction (None), or the probability of a class."""
        if self.state is None:
            raise RuntimeError("predict needs initialize")
        if clash := set(names) & set(df.columns):
            raise ValueError(f"the DataFrame has a column {sorted(clash)[0]!r}")
        spark = df.sparkSession
        ship(spark)
        known = spark.sparkContext.broadcast(self.state)  # bounded by the settings' trees, replay and reference
        rows = self._encoded(df, F.struct(*(F.col(f"`{c}`") for c in df.columns)))
        schema = T.StructType([T.StructField("row", T.StructType(df.schema.fields)), T.StructField("p", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = pickle.loads(known.value)
            for batch in batches:
                width = len(batch.column(1)[0]) if batch.num_rows else 0
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                p = model.predict(x) if batch.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(p, float))], ["row", "p"])

        out = rows.mapInArrow(run, schema)
        value = {None: F.col("p"), 1: F.col("p"), 0: 1.0 - F.col("p")}
        return out.select(*(F.col("row").getField(c).alias(c) for c in df.columns), *(value[k].alias(n) for n, k in names.items()))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the predicted value, or the predicted class: the positive label where its probability is over a half."""
        if self.task is None or self.task.task_type == "regression":
            return self._predicted(df, {name: None})
        out = self._predicted(df, {name: 1})
        return out.withColumn(name, (F.col(name) > 0.5).cast("int"))

    def predict_proba(self, df: DataFrame, names: tuple[str, str] = ("p0", "p1")) -> DataFrame:
        """``df`` with the probabilities of both classes, which sum up to one."""
        if self.task is None or self.task.task_type == "regression":
            raise TypeError("probabilities are of classes, and the task is a regression")
        return self._predicted(df, {names[0]: 0, names[1]: 1})

    # -- state -----------------------------------------------------------------------------------------------------

    def memory(self) -> dict[str, int]:
        """Bytes of the state as it is stored, and of its parts; and numbers of trees and rows held."""
        if self.state is None:
            return {"state": 0}
        model = pickle.loads(self.state)
        parts = {"anchor": model.anchor, "specialist": model.specialist, "replay": model.replay, "detector": model.detector, "log": model.log}
        sizes = {f"{k}_bytes": len(pickle.dumps(v)) for k, v in parts.items()}
        return {"state": len(self.state), **sizes, "trees": len(model.anchor.trees) + len(model.specialist.trees), "replay_rows": len(model.replay), "reference_rows": len(model.detector.ref)}

    def replay(self, spark: SparkSession) -> DataFrame:
        """The replay buffer as rows of features and y, empty before a batch is learned."""
        model = None if self.state is None else pickle.loads(self.state)
        rows = [] if model is None or not len(model.replay) else [(x.tolist(), float(y)) for x, y in zip(model.replay.x, model.replay.y, strict=True)]
        return spark.createDataFrame(rows, "features array<double>, y double")  # at most the capacity

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as a table of one row; an earlier one there is replaced."""
        row = (pickle.dumps((self.task, self.settings, self.seed, self.rows, self.stats, self.updates, self.reports)), self.state)
        spark.createDataFrame([row], "head binary, state binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AdaptiveModel:
        """The model saved at ``path``. It holds pickled objects: read only what you have written."""
        row = spark.read.parquet(path).first()
        task, settings, seed, rows, stats, updates, reports = pickle.loads(bytes(row["head"]))
        return cls(task, settings, seed, rows, None if row["state"] is None else bytes(row["state"]), stats, updates, reports)
