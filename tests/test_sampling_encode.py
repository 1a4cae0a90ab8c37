"""Hash samples, quotas, encoding and type inference."""

import hashlib

import pytest
from pyspark.sql import functions as F

from driftloom.operators import encode, sampling, spec


def test_take_by_hash_is_exact_on_one_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 2900, "hot").otherwise(None).alias("g"))
    got = {(r["g"], r["row_id"]) for r in sampling.take_by_hash(df, ["g"], 50, "s").collect()}
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"s:{i}".encode()).hexdigest(), i))
    assert got == {("hot", i) for i in [i for i in order if i < 2900][:50]} | {(None, i) for i in [i for i in order if i >= 2900][:50]}
    marked = sampling.mark_by_hash(df, ["g"], 50, "s", "m")
    assert marked.count() == 3000 and marked.where("m").count() == 100
    assert sampling.take_by_hash(df, ["g"], 0, "s").count() == 0


def test_holdout_sizes(spark):
    df = spark.range(530).select(F.col("id").alias("row_id"), F.when(F.col("id") < 30, 0).otherwise(1).alias("batch_id"))
    got = {r["batch_id"]: r["n"] for r in sampling.holdout_split(df).where("is_eval").groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 10, 1: 100}


def test_quotas_and_replay_cap(spark):
    df = spark.range(90).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("stratum"))
    got = [r["n"] for r in sampling.stratified(df, 10, "q").groupBy("stratum").agg(F.count("*").alias("n")).orderBy("stratum").collect()]
    assert got == [4, 3, 3]
    again = sampling.replay_update(sampling.stratified(df, 10, "q"), df.withColumn("row_id", F.col("row_id") + 1000), 10)
    assert again.count() == 10


def test_farthest_points():
    import numpy as np

    x = np.array([[0.0], [0.1], [5.0], [10.0]])
    assert sampling.farthest_points(x, 3) == [2, 0, 3]  # nearest to the centroid; the first of equally far ones; the rest
    assert sampling.farthest_points(x, 9) == [0, 1, 2, 3]


def test_select_farthest_sees_all_rows(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x, strata = rng.normal(size=(900, 3)), [*(k % 3 for k in range(896)), 7, 7, 7, 7]
    df = spark.createDataFrame([(i, s, v.tolist()) for i, (s, v) in enumerate(zip(strata, x, strict=True))], "row_id long, stratum int, features array<double>")
    got = {(r["stratum"], r["pick"]): r["row_id"] for r in sampling.select_farthest(df.repartition(5), 22).collect()}
    want = {}
    for s, n in ((0, 6), (1, 6), (2, 5), (7, 5)):
        ids = [i for i, t in enumerate(strata) if t == s]
        want |= {(s, k): ids[j] for k, j in enumerate(sampling.farthest_points(x[ids], n))}
    assert got == want
    assert sampling.select_farthest(df.where("false"), 5).count() == 0


def test_replay_query_folds_every_batch_by_farthest_points(spark, tmp_path):
    import numpy as np

    from driftloom.plans import stream_queries
    from driftloom.sources import streams

    rows = [(i, f"2024-01-{1 + i // 100 * 5:02d} 0{i % 10}:00:00", i % 7, "ab"[i % 2], float(i * 37 % 101), '{"k": %d}' % (i * 13 % 29)) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "timestamp(ts) ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    names = encode.feature_names(["x0", "x1", "x2"], ["cat"])
    e = streams.events(spark, str(tmp_path))
    stats = encode.frozen_stats(e.where("batch_id = 0"), ["x0", "x1", "x2"])
    given = encode.encode(e, stats, ["row_id", "y", "batch_id"], ["x0", "x1", "x2"], ["cat"]).orderBy("row_id").toPandas()
    x, y = given[names].to_numpy(float), given["y"].to_numpy()

    def strata(ids):
        q = np.quantile(y[ids], np.linspace(0, 1, 11))
        edges = np.unique([q[0] - 1e-9, *np.round(q[1:-1], 9), q[-1] + 1e-9])
        return np.clip(np.digitize(y[ids], edges) - 1, 0, 9)

    def cut(ids):
        if len(ids) <= 150:
            return ids
        s, out = strata(ids), []
        for v in np.unique(s):
            own = ids[s == v]
            out += own[sampling.farthest_points(x[own], 15)].tolist()
        return np.array(sorted(out))

    keep = np.empty(0, int)
    for b in range(4):
        keep = cut(np.array(sorted([*keep, *cut(given.index[given["batch_id"] == b].to_numpy())]), int))
    got = {r["row_id"]: (r["stratum"], r["batch_id"]) for r in stream_queries.Q["replay_update"](spark, str(tmp_path)).collect()}
    assert {b for _, b in got.values()} == {0, 1, 2, 3}
    assert got == {int(i): (int(s), int(given["batch_id"][i])) for i, s in zip(keep, strata(keep), strict=True)}


def test_encode_width_nulls_and_label_independence(spark):
    fit = spark.createDataFrame([(1, "1.0", "a", 1.0), (2, None, None, 0.0), (3, "x", "b", 1.0), (4, "3.0", "a", 0.0)], "row_id int, v string, c string, y double")
    stats = encode.frozen_stats(fit, ["v", "gone"] if "gone" in fit.columns else ["v"])
    later = spark.createDataFrame([(5, "NaN", "new", 9.0), (6, "1e9", None, -9.0)], "row_id int, v string, c string, y double")
    out = encode.encode(later, stats, ["row_id"], ["v"], ["c"])
    assert out.columns == ["row_id", *encode.feature_names(["v"], ["c"])]
    rows = sorted(out.collect())
    assert (rows[0]["v_scaled"], rows[0]["v_isna"], rows[1]["v_scaled"]) == (0.0, 1.0, 8.0)
    assert sum(rows[0][f"c_hash_{i}"] for i in range(16)) == 1.0
    assert sorted(encode.encode(later.drop("y", "c").withColumn("extra", F.lit(1)), stats, ["row_id"], ["v"], ["c"]).collect())[0]["v_scaled"] == 0.0


def test_infer(spark):
    df = spark.createDataFrame([(1, 0, 1.5, "a"), (2, 1, 2.5, "b"), (3, 1, None, "a")], "k int, y int, f double, s string")
    t = spec.infer_task_spec(df, "y")
    assert t.task_type == "binary_classification" and t.pos_label == 1 and t.numerical == ("f",) and t.categorical == ("k", "s")
    assert spec.infer_task_type(df, "f")[0] == "binary_classification" and spec.infer_task_type(df, "k")[0] == "regression"
    with pytest.raises(ValueError):
        spec.TaskSpec("ranking")


def test_last_rows_and_shares(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("batch_id"), (F.col("id") * F.col("id") * 7919 - 10**12).alias("row_id"), F.lit("k").alias("_at"))
    for n in (1, 100, 5000):
        got = sampling.last_rows(rows.drop("_at"), ["batch_id"], n, ranges=16).groupBy("batch_id").agg(F.collect_list("row_id").alias("r")).collect()
        every = rows.toPandas()
        for r in got:
            own = sorted(every[every["batch_id"] == r["batch_id"]]["row_id"])
            assert sorted(r["r"]) == own[-n:]
    one = spark.range(4).select(F.lit(0).alias("batch_id"), F.lit(7).cast("long").alias("row_id"))
    assert sampling.last_rows(one.limit(1), ["batch_id"], 3).count() == 1 and sampling.last_rows(one.where("false"), ["batch_id"], 3).count() == 0
    assert sampling.shares(10, 3).tolist() == [4, 3, 3] and sampling.shares(2, 3).tolist() == [1, 1, 0] and sampling.shares(9, 3).tolist() == [3, 3, 3]
    at = spark.range(3).select(sampling.quota(10, F.lit(3), F.col("id")).alias("q")).collect()
    assert [r["q"] for r in at] == [4, 3, 3]
