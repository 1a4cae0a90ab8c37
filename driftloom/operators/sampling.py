"""Samples without replacement by hash order, replay strata and quotas, farthest points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.functions.hashing import rank_key
from driftloom.sources.stored import stored


def mark_by_hash(df: DataFrame, keys: list[str], n: Column | int, seed: str, mark: str, row_id: str = "row_id", digits: int = 3) -> DataFrame:
    """``df`` with a boolean column: whether a row is among the first ``n`` of its group in the order of md5(seed:row_id).

    Ties go by row_id; ``n`` may use group_rows. Rows are counted by the first hex digits of the hash; whole buckets before
    the last one are taken as they are and only that bucket is ranked, so that a group of any size is spread over many tasks.
    """
    name = "_all"
    keyed = df.withColumn("_h", rank_key(seed, row_id)).withColumn("_b", F.substring("_h", 1, digits))
    keyed = keyed if keys else keyed.withColumn(name, F.lit(0))
    by = keys or [name]
    counts = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("group_rows", F.sum("_n").over(W.partitionBy(*by)))
    counts = counts.withColumn("_want", (n if isinstance(n, Column) else F.lit(n)).cast("long"))
    # null-safe: a group may have a null key
    k = counts.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_b").alias("_kb"), "_n", "_before", "_want")
    on = F.col("_b") == F.col("_kb")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = keyed.join(k, on)
    whole, part = F.col("_before") + F.col("_n") <= F.col("_want"), F.col("_before") < F.col("_want")
    rank = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", row_id))
    sure = joined.where(whole | ~part).select(*df.columns, whole.alias(mark))
    last = joined.where(~whole & part).withColumn("_r", rank).select(*df.columns, (F.col("_before") + F.col("_r") <= F.col("_want")).alias(mark))
    return sure.unionByName(last)


def take_by_hash(df: DataFrame, keys: list[str], n: Column | int, seed: str, row_id: str = "row_id", digits: int = 3) -> DataFrame:
    """The first ``n`` rows of each group in the order of md5(seed:row_id), ties by row_id."""
    return mark_by_hash(df, keys, n, seed, "_taken", row_id, digits).where("_taken").drop("_taken")


def place_by_hash(df: DataFrame, keys: list[str], seed: str, place: str, row_id: str = "row_id", digits: int = 3) -> DataFrame:
    """``df`` with each row's place, from 0, in its group's order of md5(seed:row_id), ties by row_id.

    Places within buckets of the hash's first digits are added to the number of rows in the buckets before.
    """
    keyed = df.withColumn("_h", rank_key(seed, row_id)).withColumn("_b", F.substring("_h", 1, digits))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = keyed.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", row_id)) - 1
    return keyed.join(counts, [*keys, "_b"]).withColumn(place, F.col("_before") + rank).select(*df.columns, place)


def holdout_split(df: DataFrame, ratio: float = 0.2, seed: str = "split", least: int = 10, by: str = "batch_id") -> DataFrame:
    """``df`` with is_eval: max(``least``, int(ratio x rows)) rows of each batch, by hash, are hidden from learning."""
    return mark_by_hash(df, [by], F.greatest(F.lit(least), F.floor(F.col("group_rows") * ratio)), seed, "is_eval")


def strata(df: DataFrame, value: str = "y", n: int = 10) -> DataFrame:
    """``df`` with the stratum of its value: which of the batch's n-quantile bins, an edge's value in the upper one.

    Exact quantiles are one aggregation; equal edges are one, and the outer ones reach just beyond the values.
    """
    edges = quantile_edges(df, ["batch_id"], value, n, 1e-9)
    at = F.size(F.filter("edges", lambda e: e <= F.col(value))) - 1
    return df.join(edges, "batch_id").withColumn("stratum", F.greatest(F.lit(0), F.least(at, F.lit(n - 1)))).drop("edges")


def quantile_edges(df: DataFrame, keys: list[str], value: str, n: int, reach: float) -> DataFrame:
    """Distinct n-quantiles of a column by group, to nine digits, the outer ones moved out by ``reach``."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(*(F.lit(i / n) for i in range(n + 1)))).alias("q"))
    edge = F.transform("q", lambda e: F.round(e, 9))
    outer = F.concat(F.array(F.element_at("q", 1) - reach), F.slice(F.col("q"), 2, n - 1), F.array(F.element_at("q", -1) + reach))
    return q.withColumn("q", edge).select(*keys, F.array_sort(F.array_distinct(outer)).alias("edges"))


def quota(capacity: int, n_strata: Column, index: Column) -> Column:
    """A stratum's share of the capacity: equal parts, the remainder to the first ones."""
    return F.floor((F.lit(capacity - 1) - index) / n_strata) + 1


def shares(capacity: int, n_strata: int) -> np.ndarray:
    """``quota`` of all strata, in their order."""
    return (capacity - 1 - np.arange(n_strata)) // n_strata + 1


def stratified(df: DataFrame, capacity: int, seed: str, keys: list[str] | None = None) -> DataFrame:
    """Of each stratum (within ``keys``) its quota of rows by hash; what a small stratum leaves is not given to others."""
    keys = keys or []
    sizes = df.select(*keys, "stratum").distinct()
    order = W.partitionBy(*keys).orderBy("stratum")  # a row per stratum
    sizes = sizes.withColumn("_q", quota(capacity, F.count("*").over(W.partitionBy(*keys)), F.row_number().over(order) - 1))
    joined = df.join(F.broadcast(sizes), [*keys, "stratum"])  # a row per batch and stratum
    return take_by_hash(joined, [*keys, "stratum", "_q"], F.col("_q"), seed).drop("_q")


def last_rows(df: DataFrame, keys: list[str], n: int, order: str = "row_id", ranges: int = 4096) -> DataFrame:
    """The last ``n`` rows of each group by a unique integer column, whatever the group's size.

    Rows are counted in even ranges of the column; ranges wholly among the last are taken as they are, and only the one at
    the bound is ranked.
    """
    low = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    ranged = df.join(F.broadcast(low), keys)  # a row per group
    x, lo, hi = (F.col(c).cast("double") for c in (order, "_lo", "_hi"))
    at = F.floor((x - lo) / (hi - lo + 1) * ranges).cast("int")
    ranged = ranged.withColumn("_at", at).drop("_lo", "_hi")
    counts = ranged.groupBy(*keys, "_at").agg(F.count("*").alias("_n"))
    after = F.sum("_n").over(W.partitionBy(*keys).orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, -1))  # ``ranges`` rows a group
    counts = counts.withColumn("_after", F.coalesce(after, F.lit(0))).where(F.col("_after") < n)
    joined = ranged.join(F.broadcast(counts), [*keys, "_at"])  # at most ``n`` ranges a group
    whole = F.col("_after") + F.col("_n") <= n
    rank = F.row_number().over(W.partitionBy(*keys, "_at").orderBy(F.desc(order)))
    bound = joined.where(~whole).withColumn("_r", rank).where(F.col("_after") + F.col("_r") <= n)
    return joined.where(whole).select(*df.columns).unionByName(bound.select(*df.columns))


def _square(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of rows from a point."""
    return ((x - point) ** 2).sum(axis=1)


def farthest_points(x: np.ndarray, n: int) -> list[int]:
    """The rows of ``x`` that a greedy cover takes, in order: the most central one, then ever the one that is farthest from
    all taken before; all rows, as they stand, if there are no more than ``n``."""
    order = np.arange(len(x))
    if len(x) > n:
        order, uncovered = order[:n], np.full(len(x), np.inf)
        for k in range(n):
            order[k] = uncovered.argmax() if k else _square(x, x.mean(axis=0)).argmin()
            uncovered = np.fmin(uncovered, _square(x, x[order[k]]))
    return order.tolist()


def select_farthest(df: DataFrame, capacity: int, features: str = "features") -> DataFrame:
    """Of each stratum its quota of farthest points among all its rows: row_id, stratum and pick, its place in the order.

    The order is that of ``farthest_points`` over rows by row_id. A round finds the next point of every stratum: tasks
    keep the best row of their own, and a maximum by stratum settles it. Only chosen rows, ``capacity`` at most, and a
    centroid of each stratum that has a quota come to the driver.
    """
    spark = df.sparkSession
    rows = stored(df.where("stratum is not null").select(F.col("row_id").cast("long").alias("row_id"), F.col("stratum").cast("int").alias("stratum"), F.col(features).cast("array<double>").alias("x")), "points")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    n_strata, found = sizes.count(), sizes.orderBy("stratum").limit(capacity).collect()
    each, more = divmod(capacity, max(1, n_strata))
    want = {r["stratum"]: each + (k < more) for k, r in enumerate(found)}
    small = [r["stratum"] for r in found if r["n"] <= want[r["stratum"]]]
    large = [r["stratum"] for r in found if r["n"] > want[r["stratum"]] > 0]
    out: list[tuple[int, int, int]] = []
    order = W.partitionBy("stratum").orderBy("row_id")
    out += [(r["row_id"], r["stratum"], r["pick"]) for r in rows.where(F.col("stratum").isin(small)).select("row_id", "stratum", (F.row_number().over(order) - 1).cast("long").alias("pick")).collect()]
    centre = rows.where(F.col("stratum").isin(large)).select("stratum", F.posexplode("x").alias("i", "v")).groupBy("stratum", "i").agg(F.avg("v").alias("m"))
    aims: dict[int, list] = {s: [[]] for s in large}
    for r in centre.orderBy("stratum", "i").collect():
        aims[r["stratum"]][0].append(r["m"])

    def best(points: dict[int, list], sign: float):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top: dict[int, tuple] = {}
            for part in parts:
                for s, g in part.groupby("stratum"):
                    if s not in points:
                        continue
                    x, ids = np.stack(g["x"].to_numpy()).astype(float), g["row_id"].to_numpy()
                    gap = sign * np.min([_square(x, np.array(p)) for p in points[s]], axis=0)
                    at = np.flatnonzero(gap == gap.max())
                    at = at[np.argmin(ids[at])]
                    top[s] = max(top.get(s, (-np.inf, 0, None)), (float(gap[at]), -int(ids[at]), x[at].tolist()), key=lambda t: t[:2])
            yield pd.DataFrame([(s, *t) for s, t in top.items()], columns=["stratum", "score", "back", "x"])

        return rows.mapInPandas(run, "stratum int, score double, back long, x array<double>").groupBy("stratum").agg(F.max(F.struct("score", "back", "x")).alias("t")).collect()

    for pick in range(max((want[s] for s in large), default=0)):
        now = {s: p for s, p in aims.items() if pick < want[s]}
        for r in best(now, 1.0 if pick else -1.0):
            s, t = r["stratum"], r["t"]
            aims[s] = [*aims[s], t["x"]] if pick else [t["x"]]
            out.append((-t["back"], s, pick))
    return spark.createDataFrame(out, "row_id long, stratum int, pick long")


def replay_update(buffer: DataFrame | None, batch: DataFrame, capacity: int, features: str | None = None) -> DataFrame:
    """The next version of a replay buffer: a batch over the capacity is cut to it by strata, joined to the buffer, and the
    union cut again. Columns row_id, stratum and whatever both have; no buffer is an empty one.

    With ``features`` (and y, row_id unique) strata are assigned anew on the batch, on the union and on what is kept, and
    farthest points fill their quotas; without, strata are taken as they are and rows are drawn by hash.
    """
    if features is None:
        cut = stratified(batch, capacity, "in")
        return stratified(cut if buffer is None else buffer.unionByName(cut), capacity, "keep")

    def cut_to(df: DataFrame) -> DataFrame:
        if df.count() <= capacity:
            return df
        chosen = select_farthest(restrata(df), capacity, features)
        return df.join(F.broadcast(chosen.select("row_id")), "row_id", "left_semi")  # ``capacity`` ids at most

    batch = cut_to(batch.drop("stratum"))
    kept = cut_to(stored(batch if buffer is None else buffer.drop("stratum").unionByName(batch), "union"))
    return stored(restrata(kept), "replay")


def restrata(df: DataFrame) -> DataFrame:
    """``df`` with the strata of y among all its rows, whatever their batches."""
    rest = [c for c in df.columns if c not in ("stratum", "batch_id")]
    whole = strata(df.select(*rest, F.col("batch_id").alias("_batch"), F.lit(0).alias("batch_id")))
    return whole.select(*rest, F.col("_batch").alias("batch_id"), F.col("stratum").cast("int").alias("stratum"))
