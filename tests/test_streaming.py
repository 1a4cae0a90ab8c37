"""The runner twice over the same files, and once with a restart between them: equal state."""

from pyspark.sql import functions as F

from driftloom.streaming.runner import StreamRunner


def test_restart_gives_equal_state(spark, tmp_path):
    src = tmp_path / "in"
    schema = "row_id long, a double, b double"

    def batch(k):
        spark.range(k * 200, k * 200 + 200).select(F.col("id").alias("row_id"), (F.col("id") % 17 + 3.0 * k).alias("a"), (F.col("id") % 5).cast("double").alias("b")).coalesce(1).write.parquet(str(src / f"d{k}"))

    def run(name):
        runner = StreamRunner(str(tmp_path / name / "state"), ("a", "b"))
        q = runner.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*")), str(tmp_path / name / "ck"))
        q.awaitTermination()
        return runner

    batch(0)
    batch(1)
    run("stopped")  # two batches, then a stop
    batch(2)
    stopped, whole = run("stopped"), run("whole")
    rows = lambda r: sorted((x["batch_id"], x["feature"], round(x["psi"], 9), round(x["wass"], 9)) for x in r.reports(spark).collect())
    assert rows(stopped) == rows(whole) and {x[0] for x in rows(whole)} == {1, 2}
    last = lambda r: {x["row_id"] for x in spark.read.parquet(r._path("reference", 2)).collect()}
    assert last(stopped) == last(whole) and len(last(whole)) == 256
