"""Batch streams over Parquet tables: a row has row_id, batch_id, features and a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.functions.hashing import uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in batches of five days: x0 value, x1 the property k, x2 the hour, cat the type, and a regression target y."""
    days = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01")))
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.floor(days / 5).cast("int").alias("batch_id"), F.col("value").alias("x0"),
        F.get_json_object("props", "$.k").cast("double").alias("x1"), F.hour("ts").cast("double").alias("x2"),
        F.col("event_type").alias("cat"), F.col("user_id"),
    )
    return e.withColumn("y", 0.8 * F.col("x0") - 0.3 * F.col("x1") + 4.0 * (uniform("y", "row_id") - 0.5))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in batches by year: x is the quantity, and y turns from rising to falling with it in 1998."""
    t = table(spark, sf_dir, "lineitem").select(
        F.conv(F.substring(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), 1, 15), 16, 10).cast("long").alias("row_id"), (F.year("l_shipdate") - 1995).alias("batch_id"),
        F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("d"),
    )
    slope = F.when(F.col("batch_id") >= 3, -2.0).otherwise(3.0)
    return t.withColumn("y", slope * F.col("x") + 50.0 * F.col("d") + 10.0 * (uniform("li", "row_id") - 0.5))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers in batches by year: a score p of the label y, by order priority and market segment."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"), (F.year("o_orderdate") - F.lit(1995)).alias("batch_id"), F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("balance"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
    )
    t = t.withColumn("y", (uniform("oy", "row_id") < F.least(F.col("price") / 400000.0, F.lit(1.0))).cast("int"))
    noisy = F.col("price") / 500000.0 + 0.3 * (uniform("op", "row_id") - 0.5)
    # two decimals: scores tie, which the rank statistics must handle
    return t.withColumn("p", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), noisy)), 2))


def count_batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Batches of ``size`` rows in the total order given by ``order``, whose first column is numeric.

    Rows are numbered within ranges of the first column; ranges' counts give each range's offset, so that no task sees
    all rows.
    """
    first = order[0]
    ranged = df.withColumn("_range", F.floor(F.col(first) / F.lit(4096)).cast("long"))
    ahead = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = ahead.withColumn("_ahead", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.join(ahead, "_range").withColumn("batch_id", F.floor((F.col("_ahead") + own - 1) / size).cast("int")).drop("_range", "_ahead")
