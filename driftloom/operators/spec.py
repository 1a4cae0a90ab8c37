"""Task specifications: what a table's columns are for, declared or inferred."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASKS = ("regression", "binary_classification")
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*_INTEGERS, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


@dataclass(frozen=True)
class TaskSpec:
    task_type: str
    target: str = "target"
    numerical: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    metric: str = "auto"
    subgroup: str | None = None
    pos_label: object = 1

    def __post_init__(self) -> None:
        if self.task_type not in TASKS:
            raise ValueError(f"task_type must be one of {TASKS}, not {self.task_type!r}")
        if self.metric == "auto":
            object.__setattr__(self, "metric", "mse" if self.task_type == "regression" else "roc_auc")

    @property
    def all_features(self) -> tuple[str, ...]:
        return (*self.numerical, *self.categorical)

    def with_roles(self, df: DataFrame) -> TaskSpec:
        """A spec without features takes them from ``df`` by type alone; it is a new spec."""
        if self.all_features:
            return self
        skip = {self.target, self.subgroup}
        fields = [f for f in df.schema.fields if f.name not in skip]
        return replace(self, numerical=tuple(f.name for f in fields if isinstance(f.dataType, _NUMBERS)), categorical=tuple(f.name for f in fields if not isinstance(f.dataType, _NUMBERS)))


def infer_task_type(df: DataFrame, target: str, most: int = 15) -> tuple[str, object]:
    """Task type and positive label: two values (or a boolean) are classes, floating point or many values a regression."""
    kind = df.schema[target].dataType
    row = df.agg(F.count_distinct(F.col(f"`{target}`")).alias("u"), F.max(F.col(f"`{target}`")).alias("top")).first()
    u = row["u"]
    if u == 2 or (u <= 2 and isinstance(kind, T.BooleanType)):
        return "binary_classification", row["top"] if u == 2 else 1
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) or u > most:
        return "regression", 1
    return ("binary_classification" if u <= 2 else "regression"), 1


def infer_roles(df: DataFrame, skip: set[str], few: int = 4) -> DataFrame:
    """One row per column: its role, categorical for what is no number and for integers of at most ``few`` values, and its
    distinct values, all counted in one aggregation."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    counts = df.agg(*(F.count_distinct(F.col(f"`{f.name}`")).alias(f.name) for f in fields))
    integer = {f.name: isinstance(f.dataType, _INTEGERS) for f in fields}
    number = {f.name: isinstance(f.dataType, _NUMBERS) for f in fields}
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("n_distinct"), F.lit(integer[f.name]).alias("i"), F.lit(number[f.name]).alias("f")) for f in fields))).alias("r")).select("r.*")
    role = F.when(~F.col("f") | (F.col("i") & (F.col("n_distinct") <= few)), "categorical").otherwise("numerical")
    return rows.select("column", "n_distinct", role.alias("role"))


def infer_task_spec(df: DataFrame, target: str, subgroup: str | None = None, most: int = 15) -> TaskSpec:
    task, pos = infer_task_type(df, target, most)
    roles = infer_roles(df, {target, subgroup} - {None}).collect()  # a row per column
    pick = lambda role: tuple(r["column"] for r in roles if r["role"] == role)
    return TaskSpec(task, target, pick("numerical"), pick("categorical"), subgroup=subgroup, pos_label=pos)
