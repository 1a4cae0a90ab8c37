"""Drift statistics on long frames (keys, feature, x) and the per-batch drift report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.functions.numeric import clip
from driftloom.operators.sampling import take_by_hash


@dataclass(frozen=True)
class DriftConfig:
    """Thresholds and sizes of the detector."""

    reference_size: int = 256
    bins: int = 10
    min_samples: int = 50
    psi_low: float = 0.10
    psi_high: float = 0.25
    wasserstein: float = 0.20
    cusum: float = 3.5
    slack: float = 0.5
    alpha: float = 1e-3


def long_form(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """One row per feature, so that one shuffle serves all features."""
    return df.select(*keys, *features).unpivot(keys, features, "feature", "x")


def reference_sample(df: DataFrame, size: int = 256, seed: str = "ref") -> DataFrame:
    """At most ``size`` rows of a stream, those with the smallest hashes: the same as a reservoir after the same rows, and
    mergeable, as the smallest of two samples' union are those of both streams' union."""
    return take_by_hash(df, [], size, seed)


def _line(lo: Column, hi: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: lo + (hi - lo) * i / n)


def reference_summary(ref: DataFrame, keys: list[str] | None = None, bins: int = 10, raw: bool = False) -> DataFrame:
    """Per key and feature: n, std, edges. Edges are quantiles to nine digits, equal ones as one, the outer ones moved out.

    Constant features get even edges one unit around, features with too few distinct quantiles even edges over their range.
    ``raw`` is the rule of the null calibration: no widening of constants, a deviation of at least 1e-6 rather than 1 for less.
    """
    by = [*(keys or []), "feature"]
    s = ref.groupBy(*by).agg(
        F.count("*").alias("n"), F.stddev_pop("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.percentile("x", F.array(*(F.lit(i / bins) for i in range(bins + 1)))).alias("q"),
    )
    q = F.transform("q", lambda e: F.round(e, 9))
    widened = F.array_sort(F.array_distinct(F.concat(F.array(F.element_at("q", 1) - 1e-6), F.slice(q, 2, bins - 1), F.array(F.element_at("q", -1) + 1e-6))))
    lo, hi = F.col("lo"), F.col("hi")
    edges = F.when(F.size(widened) < 3, _line(lo - 1e-6, hi + 1e-6, bins)).otherwise(widened)
    if raw:
        std = F.greatest(F.lit(1e-6), F.col("sd"))
    else:
        edges = F.when(hi <= lo, _line(lo - 1.0, hi + 1.0, bins)).otherwise(edges)
        std = F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd"))
    return s.select(*by, "n", std.alias("std"), edges.alias("edges"))


def histogram(df: DataFrame, edges: DataFrame, keys: list[str], on: list[str], bins: int = 10) -> DataFrame:
    """Counts by half-open bin, the last one closed, values outside in none; every bin has a row. The edges table has a row
    per feature and is joined by its key; a row of more than ``bins`` bins is an error."""
    message = F.concat(F.lit(f"more than {bins} bins: "), (F.size("edges") - 1).cast("string"))
    e = edges.select(*on, F.when(F.size("edges") > bins + 1, F.raise_error(message).cast("array<double>")).otherwise(F.col("edges")).alias("edges"))
    b = F.size("edges") - 1
    at = F.size(F.filter("edges", lambda v: v <= F.col("x")))
    at = F.when(F.col("x") == F.element_at("edges", -1), b).otherwise(at)
    by = list(dict.fromkeys([*keys, *on]))
    counted = df.join(e, on).withColumn("bin", at).groupBy(*by).agg(F.count("*").alias("n"), F.first(b).alias("bins"), *(F.count_if(F.col("bin") == i).alias(f"c{i}") for i in range(1, bins + 1)))
    spine = F.explode(F.slice(F.array(*(F.struct(F.lit(i).alias("bin"), F.col(f"c{i}").alias("c")) for i in range(1, bins + 1))), F.lit(1), F.col("bins")))
    return counted.select(*by, "n", "bins", spine.alias("s")).select(*by, "n", "bins", "s.bin", "s.c")


def psi(hist: DataFrame, ref_hist: DataFrame, keys: list[str], on: list[str], alpha: float = 1e-3) -> DataFrame:
    """Population stability index against the reference, smoothed by ``alpha`` a bin."""
    q = (F.col("c") + alpha) / (F.col("n") + alpha * F.col("bins"))
    p = ref_hist.select(*on, "bin", q.alias("p"))
    by = list(dict.fromkeys([*keys, *on]))
    both = hist.withColumn("q", q).join(p, [*on, "bin"])
    return both.groupBy(*by).agg(F.greatest(F.lit(0.0), F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))).alias("psi"), F.first("n").alias("n"))


def wasserstein(cur: DataFrame, ref: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """First Wasserstein distance between each group of ``cur`` and the reference (bounded, so repeated for each group).

    Equal values are counted before they are ordered: a group's window has a row per distinct value.
    """
    by = list(dict.fromkeys([*keys, *on]))
    c = cur.groupBy(*by, "x").agg(F.count("*").alias("m"))
    r = ref.groupBy(*on, "x").agg(F.count("*").alias("k"))
    groups = c.select(*by).distinct()
    both = c.withColumn("k", F.lit(0)).unionByName(groups.join(r, on).withColumn("m", F.lit(0)).select(*c.columns, "k"))
    both = both.groupBy(*by, "x").agg(F.sum("m").alias("m"), F.sum("k").alias("k"))
    w, whole = W.partitionBy(*by).orderBy("x"), W.partitionBy(*by)
    gap = F.abs(F.sum("m").over(w) / F.sum("m").over(whole) - F.sum("k").over(w) / F.sum("k").over(whole))
    return both.select(*by, (gap * (F.lead("x").over(w) - F.col("x"))).alias("a")).groupBy(*by).agg(F.sum("a").alias("wass"))


def feature_scores(cur: DataFrame, ref: DataFrame, keys: list[str], on: list[str], config: DriftConfig | None = None, raw: bool = False) -> DataFrame:
    """Per group and feature: psi, wass (in the reference's deviations), score, the mean of both clipped at their thresholds."""
    c = config or DriftConfig()
    summary = reference_summary(ref, [k for k in on if k != "feature"], c.bins, raw)
    ref_hist = histogram(ref, summary, on, on, c.bins)
    p = psi(histogram(cur, summary, keys, on, c.bins), ref_hist, keys, on, c.alpha)
    by = list(dict.fromkeys([*keys, *on]))
    out = p.join(wasserstein(cur, ref, keys, on), by).join(summary.select(*on, "std"), on).withColumn("wass", F.col("wass") / F.col("std"))
    score = 0.5 * clip(F.col("psi") / c.psi_high, 0, 1) + 0.5 * clip(F.col("wass") / c.wasserstein, 0, 1)
    return out.select(*by, "n", "psi", "wass", score.alias("score"))


def null_floor(ref: DataFrame, features: list[str], config: DriftConfig | None = None) -> DataFrame:
    """One row, floor: the third quartile, in [0, 0.6], of the scores between random halves of the reference (0 under 64 rows)."""

    halves = ref.select("row_id", *features, F.explode(F.array(F.lit("h1"), F.lit("h2"), F.lit("h3"))).alias("pair"))
    w = W.partitionBy("pair").orderBy(F.md5(F.concat_ws(":", "pair", "row_id")), "row_id")  # three times a bounded reference
    halves = halves.withColumn("first", F.row_number().over(w) <= F.floor(F.count("*").over(W.partitionBy("pair")) / 2))
    a = long_form(halves.where("first"), ["pair"], features)
    b = long_form(halves.where("not first"), ["pair"], features)
    raw = feature_scores(b, a, ["pair"], ["pair", "feature"], config, raw=True).groupBy("pair").agg(F.percentile("score", 0.8).alias("score"))
    small = ref.agg((F.count("*") < 64).alias("small"))
    floor = raw.agg(clip(F.percentile("score", 0.75), 0, 0.6).alias("floor"))
    return floor.join(F.broadcast(small)).select(F.when(F.col("small"), 0.0).otherwise(F.coalesce("floor", F.lit(0.0))).alias("floor"))


def covariate_scores(scores: DataFrame, floor: DataFrame) -> DataFrame:
    """Per batch: raw, the 80th percentile over features, and cov, what exceeds the null floor, rescaled; both broadcasts are one row."""
    raw = scores.groupBy("batch_id").agg(F.percentile("score", 0.8).alias("raw"), F.max("n").alias("n"))
    over = clip((F.col("raw") - F.col("floor")) / F.greatest(F.lit(1e-6), 1.0 - F.col("floor")), 0, 1)
    return raw.join(F.broadcast(floor)).select("batch_id", "n", "raw", "floor", F.when(F.col("floor") > 0, over).otherwise(F.col("raw")).alias("cov"))


def residual_moments(baseline: DataFrame) -> DataFrame:
    """One row: mu and sd of finite residuals (population, at least 1e-4); without any (0, 1)."""
    r = baseline.where(~F.isnan("r") & (F.abs("r") < float("inf")))
    return r.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("mu"), F.coalesce(F.greatest(F.lit(1e-4), F.stddev_pop("r")), F.lit(1.0)).alias("sd"))


def batch_z(residuals: DataFrame, moments: DataFrame) -> DataFrame:
    """Per batch: n and z, the mean of standardised finite residuals."""
    r = residuals.where(~F.isnan("r") & (F.abs("r") < float("inf"))).join(F.broadcast(moments))
    return r.groupBy("batch_id").agg(F.count("*").alias("n"), F.avg((F.col("r") - F.col("mu")) / F.col("sd")).alias("z"))


def cusum(batches: DataFrame, config: DriftConfig | None = None, keys: list[str] | None = None) -> DataFrame:
    """Two-sided CUSUM over batches in order, (keys, batch_id, s_pos, s_neg, t, alarm, concept), halved by an alarm.

    The statistic is the larger of both sums and the batch's own |z| sqrt(n). Batches under the least sample count leave the
    state alone. State is carried by a fold over a stream's batches, a row each, so a stream's rows are never gathered.
    """
    c, keys = config or DriftConfig(), keys or []
    rows = batches.where(F.col("n") >= c.min_samples).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("batch_id", "n", "z"))).alias("b"))
    kind = "struct<p:double,m:double,out:array<struct<batch_id:int,s_pos:double,s_neg:double,t:double,alarm:boolean,concept:double>>>"

    def step(s: Column, b: Column) -> Column:
        p = F.greatest(F.lit(0.0), s["p"] + b["z"] - c.slack)
        m = F.least(F.lit(0.0), s["m"] + b["z"] + c.slack)
        t = F.greatest(p, -m, F.abs(b["z"]) * F.sqrt(b["n"].cast("double")))
        alarm = t >= c.cusum
        part = F.when(alarm, 0.5).otherwise(1.0)
        now = F.struct(b["batch_id"].alias("batch_id"), (p * part).alias("s_pos"), (m * part).alias("s_neg"), t.alias("t"), alarm.alias("alarm"), clip(t / c.cusum, 0, 2).alias("concept"))
        return F.struct((p * part).alias("p"), (m * part).alias("m"), F.concat(s["out"], F.array(now)).alias("out")).cast(kind)

    empty = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("m"), F.array().alias("out")).cast(kind)
    return rows.select(*keys, F.explode(F.aggregate("b", empty, step)["out"]).alias("o")).select(*keys, "o.*")


def cusum_window(batches: DataFrame, slack: float = 0.5) -> DataFrame:
    """The sums without halving, by windows over batches (a row each): prefix sum less its running minimum (maximum)."""
    w = W.orderBy("batch_id")
    up, down = F.sum(F.col("z") - slack).over(w), F.sum(F.col("z") + slack).over(w)
    p = batches.withColumn("u", up).withColumn("d", down)
    return p.select("batch_id", "n", "z", (F.col("u") - F.least(F.lit(0.0), F.min("u").over(w))).alias("s_pos"), (F.col("d") - F.greatest(F.lit(0.0), F.max("d").over(w))).alias("s_neg"))


def severity(joined: DataFrame, config: DriftConfig | None = None) -> DataFrame:
    """From batch_id, n, cov, alarm, concept: overall, severity, drift_type, confidence."""
    c = config or DriftConfig()
    cc = clip(F.coalesce("concept", F.lit(0.0)), 0, 1)
    alarm = F.coalesce("alarm", F.lit(False))
    out = joined.withColumn("concept", cc).withColumn("alarm", alarm)
    out = out.withColumn("overall", clip(F.when(F.col("concept") > 0, 0.65 * F.col("cov") + 0.35 * F.col("concept")).otherwise(F.col("cov")), 0, 1))
    o, few = F.col("overall"), F.col("n") < c.min_samples
    level = F.when(few, F.when(o >= 0.10, "low").otherwise("none")).when(F.col("alarm") | (o >= 0.55), "high").when(o >= 0.25, "medium").when(o >= 0.10, "low").otherwise("none")
    kind = F.when(F.col("alarm") & (F.col("cov") >= 0.10), "compound").when(F.col("alarm"), "concept").when(F.col("cov") >= 0.10, "covariate").otherwise("none")
    return out.select("batch_id", "n", "cov", "concept", "alarm", "overall", level.alias("severity"), kind.alias("drift_type"), (1.0 - F.exp(-F.col("n") / c.min_samples)).alias("confidence"))


def top_drifted(scores: DataFrame, positions: dict[str, int], config: DriftConfig | None = None, n: int = 5) -> DataFrame:
    """Per batch the ``n`` features with the largest of psi and wass, at least psi_low, ties by position; features per batch are few."""
    c = config or DriftConfig()
    place = F.element_at(F.create_map(*(F.lit(v) for kv in positions.items() for v in kv)), F.col("feature"))
    s = scores.withColumn("top", F.greatest("psi", "wass")).withColumn("place", place).where(F.col("top") >= c.psi_low)
    w = W.partitionBy("batch_id").orderBy(F.desc("top"), "place")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("batch_id", "rank", "feature", "top")


def report(cur: DataFrame, ref: DataFrame, residuals: DataFrame, baseline: DataFrame, features: list[str], config: DriftConfig | None = None) -> DataFrame:
    """The drift report of every batch of ``cur`` against the reference: scores, CUSUM of residuals, fusion."""
    c = config or DriftConfig()
    scores = feature_scores(long_form(cur, ["batch_id"], features), long_form(ref, [], features), ["batch_id"], ["feature"], c)
    cov = covariate_scores(scores, null_floor(ref, features, c))
    concept = cusum(batch_z(residuals, residual_moments(baseline)), c)
    return severity(cov.join(concept.select("batch_id", "alarm", "concept"), "batch_id", "left"), c)
