"""Queries of drift statistics, policy, metrics, linear learners and stream roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.functions.numeric import r6
from driftloom.operators import drift, linear, metrics, policy, sampling, shifts
from driftloom.plans.sqltext import solve, sql
from driftloom.plans.sqltext import r6 as R
from driftloom.sources import streams
from driftloom.sources.stored import stored

Q: dict = {}
O: dict[str, str] = {}
FEATURES = ["x0", "x1", "x2"]


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle is not None:
            O[f.__name__] = oracle
        return f

    return add


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shifted stream, written once for all that reads it."""
    return stored(shifts.environment_stream(streams.events(spark, sf_dir)), "shifted")


def reference(stream: DataFrame) -> DataFrame:
    return stored(drift.reference_sample(stream.where("batch_id = 0")), "reference")


def _sides(spark, sf_dir):
    s = shifted(spark, sf_dir)
    return drift.long_form(s, ["batch_id"], FEATURES), drift.long_form(reference(s), [], FEATURES)


def _residuals(stream: DataFrame) -> DataFrame:
    """Residuals of a line fitted on the first batch, whose single row is broadcast."""
    first = stream.where("batch_id = 0").agg(F.regr_slope("y", "x0").alias("b"), F.regr_intercept("y", "x0").alias("a"))
    return stream.join(F.broadcast(first)).select("batch_id", "row_id", (F.col("y") - (F.col("a") + F.col("b") * F.col("x0"))).alias("r"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shifted(spark, sf_dir)
    r = _residuals(s)
    return drift.report(s, reference(s), r, r.where("batch_id = 0"), FEATURES)


# -- reference and distances ------------------------------------------------------------------------------------------


@query(sql(f"SELECT feature, n, {R('std')} AS std FROM sm", "sm"))
def ref_stats(spark, sf_dir):
    _, ref = _sides(spark, sf_dir)
    return drift.reference_summary(ref).select("feature", "n", r6("std").alias("std"))


@query(sql(f"SELECT feature, CAST(i AS INTEGER) AS i, {R('e')} AS edge FROM (SELECT feature, unnest(range(1, len(edges) + 1)) AS i, unnest(edges) AS e FROM sm)", "sm"))
def quantile_edges(spark, sf_dir):
    _, ref = _sides(spark, sf_dir)
    return drift.reference_summary(ref).select("feature", F.posexplode("edges").alias("i", "e")).select("feature", (F.col("i") + 1).alias("i"), r6("e").alias("edge"))


@query(sql("SELECT batch_id, feature, CAST(bin AS INTEGER) AS bin, c FROM hc", "hc"))
def hist_edges(spark, sf_dir):
    cur, ref = _sides(spark, sf_dir)
    return drift.histogram(cur, drift.reference_summary(ref), ["batch_id"], ["feature"]).select("batch_id", "feature", "bin", "c")


@query(sql(f"SELECT feature, CAST(bin AS INTEGER) AS bin, {R('(c + 0.001) / (n + 0.001 * bins)')} AS p FROM hr", "hr"))
def ref_summary(spark, sf_dir):
    _, ref = _sides(spark, sf_dir)
    h = drift.histogram(ref, drift.reference_summary(ref), ["feature"], ["feature"])
    return h.select("feature", "bin", r6((F.col("c") + 0.001) / (F.col("n") + 0.001 * F.col("bins"))).alias("p"))


@query(sql(f"SELECT batch_id, feature, {R('psi')} AS psi FROM ps", "ps"))
def psi_feature(spark, sf_dir):
    cur, ref = _sides(spark, sf_dir)
    s = drift.reference_summary(ref)
    p = drift.psi(drift.histogram(cur, s, ["batch_id"], ["feature"]), drift.histogram(ref, s, ["feature"], ["feature"]), ["batch_id"], ["feature"])
    return p.select("batch_id", "feature", r6("psi").alias("psi"))


@query(sql(f"SELECT batch_id, feature, {R('wass')} AS wass FROM wa", "wa"))
def wasserstein_feature(spark, sf_dir):
    cur, ref = _sides(spark, sf_dir)
    return drift.wasserstein(cur, ref, ["batch_id"], ["feature"]).select("batch_id", "feature", r6("wass").alias("wass"))


@query(sql(f"SELECT batch_id, feature, {R('psi')} AS psi, {R('wass')} AS wass, {R('score')} AS score FROM sc", "sc"))
def feature_score(spark, sf_dir):
    cur, ref = _sides(spark, sf_dir)
    return drift.feature_scores(cur, ref, ["batch_id"], ["feature"]).select("batch_id", "feature", *(r6(c).alias(c) for c in ("psi", "wass", "score")))


@query(sql(f"SELECT {R('floor')} AS floor FROM fl", "fl"))
def null_floor(spark, sf_dir):
    return drift.null_floor(reference(shifted(spark, sf_dir)), FEATURES).select(r6("floor").alias("floor"))


@query(sql(f"SELECT pair, {R('score')} AS score FROM hsc", "hsc"))
def raw_cov_score(spark, sf_dir):
    """Uncalibrated scores between the random halves of the reference."""
    ref = reference(shifted(spark, sf_dir)).select("row_id", *FEATURES)
    halves = ref.select("row_id", *FEATURES, F.explode(F.array(F.lit("h1"), F.lit("h2"), F.lit("h3"))).alias("pair"))
    w = W.partitionBy("pair").orderBy(F.md5(F.concat_ws(":", "pair", "row_id")), "row_id")  # a bounded reference
    halves = halves.withColumn("first", F.row_number().over(w) <= F.floor(F.count("*").over(W.partitionBy("pair")) / 2))
    a, b = (drift.long_form(halves.where(f), ["pair"], FEATURES) for f in ("first", "not first"))
    scores = drift.feature_scores(b, a, ["pair"], ["pair", "feature"], raw=True)
    return scores.groupBy("pair").agg(r6(F.percentile("score", 0.8)).alias("score"))


@query(sql(f"SELECT batch_id, n, {R('raw')} AS raw, {R('cov')} AS cov FROM cv", "cv"))
def covariate_score(spark, sf_dir):
    s = shifted(spark, sf_dir)
    ref = reference(s)
    scores = drift.feature_scores(drift.long_form(s, ["batch_id"], FEATURES), drift.long_form(ref, [], FEATURES), ["batch_id"], ["feature"])
    return drift.covariate_scores(scores, drift.null_floor(ref, FEATURES)).select("batch_id", "n", r6("raw").alias("raw"), r6("cov").alias("cov"))


@query(sql(f"SELECT batch_id, CAST(k AS INTEGER) AS rank, feature, {R('top')} AS top FROM (SELECT batch_id, feature, greatest(psi, wass) AS top, row_number() OVER (PARTITION BY batch_id ORDER BY greatest(psi, wass) DESC, feature) AS k FROM sc WHERE greatest(psi, wass) >= 0.1) WHERE k <= 5", "sc"))
def top_drifted(spark, sf_dir):
    cur, ref = _sides(spark, sf_dir)
    scores = drift.feature_scores(cur, ref, ["batch_id"], ["feature"])
    return drift.top_drifted(scores, {f: i for i, f in enumerate(FEATURES)}).select("batch_id", "rank", "feature", r6("top").alias("top"))


# -- residual monitoring ----------------------------------------------------------------------------------------------


@query(sql(f"SELECT {R('mu')} AS mu, {R('sd')} AS sd FROM rm", "rm"))
def cusum_baseline(spark, sf_dir):
    r = _residuals(shifted(spark, sf_dir))
    return drift.residual_moments(r.where("batch_id = 0")).select(r6("mu").alias("mu"), r6("sd").alias("sd"))


def _z(spark, sf_dir):
    r = _residuals(shifted(spark, sf_dir))
    return drift.batch_z(r, drift.residual_moments(r.where("batch_id = 0")))


@query(sql(f"SELECT batch_id, n, {R('z')} AS z, {R('abs(z) * sqrt(n)')} AS stat FROM bz", "bz"))
def cusum_batch_stat(spark, sf_dir):
    return _z(spark, sf_dir).select("batch_id", "n", r6("z").alias("z"), r6(F.abs("z") * F.sqrt(F.col("n").cast("double"))).alias("stat"))


@query(sql(f"SELECT batch_id, {R('u - least(0.0, min(u) OVER w)')} AS s_pos, {R('d - greatest(0.0, max(d) OVER w)')} AS s_neg FROM (SELECT batch_id, sum(z - 0.5) OVER (ORDER BY batch_id) AS u, sum(z + 0.5) OVER (ORDER BY batch_id) AS d FROM bz) WINDOW w AS (ORDER BY batch_id)", "bz"))
def cusum_window(spark, sf_dir):
    return drift.cusum_window(_z(spark, sf_dir)).select("batch_id", r6("s_pos").alias("s_pos"), r6("s_neg").alias("s_neg"))


@query(sql(f"SELECT batch_id, {R('p')} AS s_pos, {R('m')} AS s_neg, {R('t')} AS t, CAST(alarm AS INTEGER) AS alarm, {R('least(2.0, t / 3.5)')} AS concept FROM cs WHERE k > 0", "cs"))
def cusum_fold(spark, sf_dir):
    c = drift.cusum(_z(spark, sf_dir))
    return c.select("batch_id", r6("s_pos").alias("s_pos"), r6("s_neg").alias("s_neg"), r6("t").alias("t"), F.col("alarm").cast("int").alias("alarm"), r6("concept").alias("concept"))


@query(sql(f"SELECT batch_id, {R('b.slope')} AS slope, n, {R('rr')} AS mean_residual FROM (SELECT batch_id, count(*) AS n, avg(r) AS rr FROM rs GROUP BY batch_id), (SELECT b AS slope FROM ols0) b", "rs", "ols0"))
def residuals_linear(spark, sf_dir):
    s = shifted(spark, sf_dir)
    slope = s.where("batch_id = 0").agg(r6(F.regr_slope("y", "x0")).alias("slope"))
    r = _residuals(s).groupBy("batch_id").agg(F.count("*").alias("n"), r6(F.avg("r")).alias("mean_residual"))
    return r.join(F.broadcast(slope)).select("batch_id", "slope", "n", "mean_residual")


# -- report and policy ------------------------------------------------------------------------------------------------

_NUMBERS = ("cov", "concept", "overall", "confidence")


@query(sql(f"SELECT batch_id, n, {', '.join(f'{R(c)} AS {c}' for c in _NUMBERS)}, CAST(alarm AS INTEGER) AS alarm, severity, drift_type FROM rp", "rp"))
def drift_report(spark, sf_dir):
    r = report(spark, sf_dir)
    return r.select("batch_id", "n", *(r6(c).alias(c) for c in _NUMBERS), F.col("alarm").cast("int").alias("alarm"), "severity", "drift_type")


@query(sql(f"SELECT batch_id, {R('overall')} AS overall, severity, drift_type, {R('confidence')} AS confidence FROM rp", "rp"))
def drift_severity(spark, sf_dir):
    return report(spark, sf_dir).select("batch_id", r6("overall").alias("overall"), "severity", "drift_type", r6("confidence").alias("confidence"))


_ACTION = ("adaptation_rate", "specialist_weight", "anchor_weight", "replay_blend_ratio", "learning_rate", "l2")


@query(sql(f"SELECT batch_id, severity, drift_type, {', '.join(f'{R(c)} AS {c}' for c in _ACTION)}, n_new_trees FROM pa", "pa"))
def policy_action(spark, sf_dir):
    return policy.actions(report(spark, sf_dir)).select("batch_id", "severity", "drift_type", *(r6(c).alias(c) for c in _ACTION), "n_new_trees")


_BUDGET = """SELECT batch_id, CAST(least(80, greatest(1, n_new_trees // 2) + coalesce(b, 0)) - least(80, coalesce(b, 0)) AS BIGINT) AS added, CAST(100 + least(80, coalesce(c, 0)) AS BIGINT) AS anchor_trees FROM (
  SELECT batch_id, n_new_trees, sum(greatest(1, n_new_trees // 2)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(greatest(1, n_new_trees // 2)) OVER (ORDER BY batch_id) AS c FROM pa WHERE batch_id > 0)"""


@query(sql(_BUDGET, "pa"))
def tree_budget(spark, sf_dir):
    """Trees added to the anchor by each update until its budget of 180, 100 of them initial, is spent."""
    w = W.orderBy("batch_id")  # a row per batch
    a = policy.actions(report(spark, sf_dir)).where("batch_id > 0").withColumn("half", F.greatest(F.lit(1), F.floor(F.col("n_new_trees") / 2)))
    a = a.select("batch_id", "half", F.sum("half").over(w).alias("c"))
    after, before = F.least(F.lit(80), F.col("c")), F.least(F.lit(80), F.col("c") - F.col("half"))
    return a.select("batch_id", (after - before).cast("long").alias("added"), (100 + after).cast("long").alias("anchor_trees"))


@query(sql("""SELECT batch_id, count(*) AS n, count(*) * 3 * 8 AS bytes, least(256, count(*)) AS reference_rows, round(100.0 * least(500, count(*)) / 500, 6) AS utilization FROM ev GROUP BY batch_id""", "ev"))
def memory_stats(spark, sf_dir):
    e = streams.events(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n"))
    return e.select("batch_id", "n", (F.col("n") * 3 * 8).alias("bytes"), F.least(F.lit(256), F.col("n")).alias("reference_rows"), F.round(100.0 * F.least(F.lit(500), F.col("n")) / 500, 6).alias("utilization"))


# -- metrics ----------------------------------------------------------------------------------------------------------


@query(sql(f"""SELECT batch_id, n, {R('mse')} AS mse, {R('sqrt(mse)')} AS rmse, {R('mae')} AS mae, {R('CASE WHEN n <= 1 OR v <= 1e-8 THEN 0.0 ELSE 1.0 - mse / v END')} AS r2, {R('-sqrt(mse)')} AS "primary"
  FROM (SELECT batch_id, count(*) AS n, avg(pow(y - (0.8 * x0 - 10.0), 2)) AS mse, avg(abs(y - (0.8 * x0 - 10.0))) AS mae, var_pop(y) AS v FROM ev GROUP BY batch_id)""", "ev"))
def metrics_regression(spark, sf_dir):
    e = streams.events(spark, sf_dir).withColumn("p", 0.8 * F.col("x0") - 10.0)
    m = metrics.regression(e)
    return m.select("batch_id", "n", *(r6(c).alias(c) for c in ("mse", "rmse", "mae", "r2", "primary")))


_AUC = """(SELECT batch_id, CASE WHEN p1 = 0 OR p0 = 0 THEN 0.5 ELSE (s - p1 * (p1 + 1) / 2.0) / (p1 * p0) END AS auc FROM (
  SELECT batch_id, sum(CASE WHEN y = 1 THEN rk END) AS s, count(*) FILTER (WHERE y = 1) AS p1, count(*) FILTER (WHERE y = 0) AS p0 FROM (
    SELECT batch_id, y, rank() OVER (PARTITION BY batch_id ORDER BY q) + (count(*) OVER (PARTITION BY batch_id, q) - 1) / 2.0 AS rk FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM od)) GROUP BY batch_id))"""
_ECE = """(SELECT batch_id, sum(n * abs(a - c)) / sum(n) AS ece FROM (SELECT batch_id, CASE WHEN p >= 0.9 THEN 9 WHEN p >= 0.8 THEN 8 WHEN p >= 0.7 THEN 7 WHEN p >= 0.6 THEN 6 WHEN p >= 0.5 THEN 5 WHEN p >= 0.4 THEN 4 WHEN p >= 0.3 THEN 3 WHEN p >= 0.2 THEN 2 WHEN p >= 0.1 THEN 1 ELSE 0 END AS b,
  count(*) AS n, avg(y) AS a, avg(p) AS c FROM od GROUP BY ALL) GROUP BY batch_id)"""


@query(sql(f"SELECT batch_id, {R('auc')} AS auc FROM {_AUC}", "od"))
def auc_midrank(spark, sf_dir):
    return metrics.auc(streams.orders(spark, sf_dir)).select("batch_id", r6("auc").alias("auc"))


@query(sql(f"SELECT batch_id, {R('avg(pow(p - y, 2))')} AS brier FROM od GROUP BY batch_id", "od"))
def brier(spark, sf_dir):
    return metrics.brier(streams.orders(spark, sf_dir)).select("batch_id", r6("brier").alias("brier"))


@query(sql(f"SELECT batch_id, {R('ece')} AS ece FROM {_ECE}", "od"))
def ece(spark, sf_dir):
    return metrics.calibration_error(streams.orders(spark, sf_dir)).select("batch_id", r6("ece").alias("ece"))


@query(sql(f"""SELECT batch_id, n, {R('acc')} AS accuracy, {R('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END')} AS f1, {R('auc')} AS auc, {R('brier')} AS brier, {R('ece')} AS ece FROM (
  SELECT batch_id, count(*) AS n, avg(CAST((p > 0.5) = (y = 1) AS INTEGER)) AS acc, count(*) FILTER (WHERE p > 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p > 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p <= 0.5 AND y = 1) AS fn, avg(pow(p - y, 2)) AS brier FROM od GROUP BY batch_id)
  JOIN {_AUC} USING (batch_id) JOIN {_ECE} USING (batch_id)""", "od"))
def metrics_classification(spark, sf_dir):
    m = metrics.classification(streams.orders(spark, sf_dir))
    return m.select("batch_id", "n", *(r6(c).alias(c) for c in ("accuracy", "f1", "auc", "brier", "ece")))


@query(sql(f"SELECT batch_id, count(*) AS groups, {R('min(v)')} AS worst, {R('max(v) - min(v)')} AS gap FROM (SELECT batch_id, nation, count(*) AS n, avg(CAST((p > 0.5) = (y = 1) AS INTEGER)) AS v FROM od GROUP BY ALL) WHERE n >= 5 GROUP BY batch_id", "od"))
def subgroup_fairness(spark, sf_dir):
    f = metrics.fairness(streams.orders(spark, sf_dir), "nation")
    return f.select("batch_id", "groups", r6("worst").alias("worst"), r6("gap").alias("gap"))


# -- linear learners, prequential ---------------------------------------------------------------------------------------


def _split(spark, sf_dir):
    return stored(sampling.holdout_split(streams.lineitems(spark, sf_dir)).select("batch_id", "row_id", "x", "y", "is_eval"), "split")


def _stats(split: DataFrame) -> DataFrame:
    return stored(linear.sums(split.where("not is_eval"), ["batch_id"]), "sums")


def _static(stats: DataFrame) -> DataFrame:
    """The first batch's model for every batch: the first row is one, so it is broadcast."""
    first = linear.solved(stats).agg(*(F.min_by(c, "batch_id").alias(c) for c in ("n", "slope", "intercept")))
    return stats.select("batch_id").join(F.broadcast(first))


def _models(split: DataFrame) -> dict[str, DataFrame]:
    s = _stats(split)
    learned = split.where("not is_eval")
    return {"static": _static(s), "naive": linear.solved(s), "full": linear.solved(linear.cumulative(s)), "replay": linear.solved(linear.with_fifo(learned, s))}


def _shown(m: DataFrame) -> DataFrame:
    return m.select("batch_id", F.col("n").cast("long").alias("n"), r6("slope").alias("slope"), r6("intercept").alias("intercept"))


def _model_sql(name: str) -> str:
    return sql(f"SELECT batch_id, CAST(n AS BIGINT) AS n, {R('slope')} AS slope, {R('intercept')} AS intercept FROM {name}", name)


@query(_model_sql("m_static"))
def static_linear(spark, sf_dir):
    return _shown(_static(_stats(_split(spark, sf_dir))))


@query(_model_sql("m_naive"))
def naive_linear(spark, sf_dir):
    return _shown(linear.solved(_stats(_split(spark, sf_dir))))


@query(_model_sql("m_full"))
def full_retrain_linear(spark, sf_dir):
    return _shown(linear.solved(linear.cumulative(_stats(_split(spark, sf_dir)))))


@query(_model_sql("m_fifo"))
def std_replay_linear(spark, sf_dir):
    split = _split(spark, sf_dir)
    return _shown(linear.solved(linear.with_fifo(split.where("not is_eval"), _stats(split))))


@query(sql(f"SELECT batch_id, CAST(n AS BIGINT) AS n, {R('slope')} AS slope, {R('intercept')} AS intercept FROM ({solve('ss', 1.0)})", "ss"))
def cand_ridge(spark, sf_dir):
    return _shown(linear.solved(_stats(_split(spark, sf_dir)), 1.0))


def _prequential(spark, sf_dir) -> DataFrame:
    """Hidden rows of each batch scored by each model after its update: one pass, beside a row of all models a batch."""
    split = _split(spark, sf_dir)
    models = _models(split)
    beside = None
    for name, m in models.items():
        own = m.select("batch_id", F.col("slope").alias(f"b_{name}"), F.col("intercept").alias(f"a_{name}"))
        beside = own if beside is None else beside.join(own, "batch_id")
    error = lambda name: F.col("y") - F.col(f"a_{name}") - F.col(f"b_{name}") * F.col("x")
    scored = split.where("is_eval").join(F.broadcast(beside), "batch_id")
    scored = scored.groupBy("batch_id").agg(F.count("*").alias("n"), *(F.sqrt(F.avg(error(name) * error(name))).alias(name) for name in models))
    return scored.unpivot(["batch_id", "n"], list(models), "model", "rmse").select("model", "batch_id", "n", "rmse")


@query(sql(f"SELECT model, batch_id, n, {R('rmse')} AS rmse FROM pq", "pq"))
def prequential_linear(spark, sf_dir):
    return _prequential(spark, sf_dir).select("model", "batch_id", "n", r6("rmse").alias("rmse"))


@query(sql(f"SELECT m.batch_id, count(*) AS n, {R('sqrt(avg(pow(h.y - m.intercept - m.slope * h.x, 2)))')} AS rmse FROM (SELECT * FROM ho WHERE is_eval AND batch_id = 0) h, m_naive m GROUP BY m.batch_id", "m_naive"))
def retention_linear(spark, sf_dir):
    """The first batch's hidden rows under every later version of the model, a row each and broadcast."""
    split = _split(spark, sf_dir)
    m = linear.solved(_stats(split)).select("batch_id", "slope", "intercept")
    h = split.where("is_eval and batch_id = 0").select("x", "y").join(F.broadcast(m))
    e = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    return h.groupBy("batch_id").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(e * e))).alias("rmse"))


_ROB = """(SELECT model, any_value(base) AS baseline, avg(perf) AS mean_shifted, min(perf) AS worst_shifted, max(perf) AS best_shifted, stddev_pop(perf) AS volatility, max(greatest(0.0, base - perf)) AS max_degradation
  FROM (SELECT model, batch_id, -rmse AS perf, first_value(-rmse) OVER (PARTITION BY model ORDER BY batch_id) AS base FROM pq) WHERE batch_id > 0 GROUP BY model)"""
_ROBS = ("baseline", "mean_shifted", "worst_shifted", "best_shifted", "volatility", "max_degradation")


@query(sql(f"SELECT model, {', '.join(f'{R(c)} AS {c}' for c in _ROBS)} FROM {_ROB}", "pq"))
def robustness(spark, sf_dir):
    r = metrics.robustness(_prequential(spark, sf_dir).withColumn("perf", -F.col("rmse")))
    return r.select("model", *(r6(c).alias(c) for c in _ROBS))


_LATENCY = {"static": 0.0, "naive": 0.02, "full": 0.11, "replay": 0.07}


@query(sql(f"""SELECT model, {R("0.4 * (1.0 / (1.0 + abs(mean_shifted))) + 0.25 * least(1.0, greatest(0.0, 1.0 - max_degradation / greatest(1.0, abs(mean_shifted) + 1.0))) + 0.15 + 0.1 + 0.1 / (1.0 + CASE model WHEN 'static' THEN 0.0 WHEN 'naive' THEN 0.02 WHEN 'full' THEN 0.11 ELSE 0.07 END)")} AS score FROM {_ROB}""", "pq"))
def multi_objective(spark, sf_dir):
    """The composite of each linear model's stream, at given latencies."""
    r = metrics.robustness(_prequential(spark, sf_dir).withColumn("perf", -F.col("rmse")))
    late = F.element_at(F.create_map(*(F.lit(v) for kv in _LATENCY.items() for v in kv)), F.col("model"))
    return r.select("model", r6(metrics.multi_objective(F.col("mean_shifted"), F.col("max_degradation"), F.lit(0.0), None, late)).alias("score"))


@query(sql(f"SELECT {R('avg(brier)')} AS mean_brier, {R('avg(gap)')} AS mean_gap, CAST(sum(n) AS BIGINT) AS n, CAST(max(n) AS BIGINT) AS peak_rows FROM (SELECT batch_id, count(*) AS n, avg(pow(p - y, 2)) AS brier FROM od GROUP BY batch_id) JOIN (SELECT batch_id, max(v) - min(v) AS gap FROM (SELECT batch_id, nation, count(*) AS n, avg(CAST((p > 0.5) = (y = 1) AS INTEGER)) AS v FROM od GROUP BY ALL) WHERE n >= 5 GROUP BY batch_id) USING (batch_id)", "od"))
def stream_rollup(spark, sf_dir):
    o = streams.orders(spark, sf_dir)
    b = metrics.classification(o).join(metrics.fairness(o, "nation"), "batch_id")
    return b.agg(r6(F.avg("brier")).alias("mean_brier"), r6(F.avg("gap")).alias("mean_gap"), F.sum("n").alias("n"), F.max("n").alias("peak_rows"))


@query(sql(f"SELECT model, count(*) AS runs, {R('avg(rmse)')} AS mean_rmse, {R('stddev_samp(rmse)')} AS std_rmse, {R('max(rmse)')} AS worst_rmse FROM pq GROUP BY model", "pq"))
def bench_summary(spark, sf_dir):
    p = _prequential(spark, sf_dir)
    return p.groupBy("model").agg(F.count("*").alias("runs"), r6(F.avg("rmse")).alias("mean_rmse"), r6(F.stddev_samp("rmse")).alias("std_rmse"), r6(F.max("rmse")).alias("worst_rmse"))


@query(sql(f"""SELECT h.batch_id, count(*) AS n, {R('avg(0.7 * (a.intercept + a.slope * h.x) + 0.3 * (s.intercept + s.slope * h.x))')} AS mean_p, count(*) FILTER (WHERE 0.7 * (a.intercept + a.slope * h.x) + 0.3 * (s.intercept + s.slope * h.x) > 0.5) AS over_half
  FROM (SELECT * FROM ho WHERE is_eval) h JOIN m_static a USING (batch_id) JOIN m_naive s USING (batch_id) GROUP BY h.batch_id""", "m_static", "m_naive"))
def blend_predict(spark, sf_dir):
    """Anchor (static) and specialist (naive) predictions at weights of 0.7 and 0.3; a label needs more than one half."""
    split = _split(spark, sf_dir)
    s = _stats(split)
    a = _static(s).select("batch_id", F.col("slope").alias("sa"), F.col("intercept").alias("ia"))
    b = linear.solved(s).select("batch_id", F.col("slope").alias("sb"), F.col("intercept").alias("ib"))
    h = split.where("is_eval").join(F.broadcast(a), "batch_id").join(F.broadcast(b), "batch_id")  # a row per batch
    p = 0.7 * (F.col("ia") + F.col("sa") * F.col("x")) + 0.3 * (F.col("ib") + F.col("sb") * F.col("x"))
    return h.groupBy("batch_id").agg(F.count("*").alias("n"), r6(F.avg(p)).alias("mean_p"), F.count_if(p > 0.5).alias("over_half"))
