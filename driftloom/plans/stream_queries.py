"""Queries of sources, schema, encoding, aggregates, shifts and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from driftloom.functions.hashing import hash_bin, rank_key
from driftloom.functions.numeric import clean, missing, r6
from driftloom.operators import encode, sampling, shifts, spec
from driftloom.operators.policy import training_sizes
from driftloom.plans.sqltext import QS, family_sql, hash_rank, norm, sql
from driftloom.plans.sqltext import hash_bin as sql_bin
from driftloom.plans.sqltext import r6 as R
from driftloom.sources import generators, streams
from driftloom.sources.stored import stored

Q: dict = {}
O: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle is not None:
            O[f.__name__] = oracle
        return f

    return add


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing and non-numeric values: text is no number, 'click' has no type, every seventh value is NaN."""
    e = streams.events(spark, sf_dir)
    raw = F.when(F.col("row_id") % 11 == 0, "n/a").when(F.col("row_id") % 7 == 0, "NaN").when(F.col("row_id") % 5 == 0, None).otherwise(F.col("x0").cast("string"))
    return e.select("row_id", "batch_id", "x1", "x2", "y", raw.alias("raw"), F.nullif(F.col("cat"), F.lit("click")).alias("cat"))


DIRTY = """(SELECT row_id, batch_id, x1, x2, y, CASE WHEN row_id % 11 = 0 OR row_id % 7 = 0 OR row_id % 5 = 0 THEN NULL ELSE x0 END AS v, nullif(cat, 'click') AS cat FROM ev)"""


@query(sql(f"SELECT batch_id, count(*) AS n, {R('sum(x0)')} AS sum_x0, min(row_id) AS first_row, max(row_id) AS last_row FROM ev GROUP BY batch_id", "ev"))
def scan_batches(spark, sf_dir):
    e = streams.events(spark, sf_dir)
    return e.groupBy("batch_id").agg(F.count("*").alias("n"), r6(F.sum("x0")).alias("sum_x0"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def _family(name):
    def run(spark, sf_dir):
        out = generators.FAMILIES[name](spark, 1000)
        return out.select(*(r6(f.name).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name) for f in out.schema.fields))

    run.__name__ = name
    return run


for _name in generators.FAMILIES:
    query(family_sql(_name))(_family(_name))


@query(sql(f"SELECT row_id, batch_id, env, {R('x0')} AS x0, {R('x1')} AS x1, {R('x2')} AS x2, {R('y')} AS y FROM sh", "sh"))
def shift_stream6(spark, sf_dir):
    s = shifts.environment_stream(streams.events(spark, sf_dir))
    return s.select("row_id", "batch_id", "env", *(r6(c).alias(c) for c in ("x0", "x1", "x2", "y")))


@query("""SELECT batch_id, count(*) AS n, min(event_id) AS first_row, max(event_id) AS last_row, round(sum(value), 4) + 0.0 AS total
  FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 400) AS INTEGER) AS batch_id FROM events) GROUP BY batch_id""")
def batch_slice(spark, sf_dir):
    b = streams.count_batches(streams.table(spark, sf_dir, "events"), 400, "event_id")
    return b.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_row"), F.max("event_id").alias("last_row"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))


@query("""SELECT target, n_distinct, CASE WHEN n_distinct = 2 THEN 'binary_classification' WHEN is_float OR n_distinct > 15 THEN 'regression' WHEN n_distinct <= 2 THEN 'binary_classification' ELSE 'regression' END AS task FROM (
  SELECT 'value' AS target, count(DISTINCT value) AS n_distinct, true AS is_float FROM events UNION ALL SELECT 'quality', count(DISTINCT quality), false FROM labels
  UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), false FROM lineitem UNION ALL SELECT 'p_size', count(DISTINCT p_size), false FROM part)""")
def infer_task(spark, sf_dir):
    rows = None
    for name, column in (("events", "value"), ("labels", "quality"), ("lineitem", "l_linenumber"), ("part", "p_size")):
        t = streams.table(spark, sf_dir, name)
        task, _ = spec.infer_task_type(t, column)
        one = t.agg(F.lit(column).alias("target"), F.count_distinct(column).alias("n_distinct"), F.lit(task).alias("task"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("""SELECT * FROM (SELECT 'l_quantity' AS "column", count(DISTINCT l_quantity) AS n_distinct, 'numerical' AS role FROM lineitem
  UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), CASE WHEN count(DISTINCT l_linenumber) <= 4 THEN 'categorical' ELSE 'numerical' END FROM lineitem
  UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), 'categorical' FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), 'categorical' FROM lineitem
  UNION ALL SELECT 'half', count(DISTINCT l_linenumber % 2), 'categorical' FROM lineitem)""")
def infer_roles(spark, sf_dir):
    t = streams.table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber", "l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).alias("half"))
    return spec.infer_roles(t, set())


@query(sql(f"SELECT row_id, {R('v')} AS x FROM {DIRTY}", "ev"))
def coerce_numeric(spark, sf_dir):
    return dirty_events(spark, sf_dir).select("row_id", r6(clean("raw")).alias("x"))


@query(sql(f"SELECT row_id, CAST(v IS NULL AS INTEGER) AS isna FROM {DIRTY}", "ev"))
def missing_indicator(spark, sf_dir):
    return dirty_events(spark, sf_dir).select("row_id", missing("raw").alias("isna"))


IMPUTED = f"(SELECT d.*, s.m, s.sd FROM {DIRTY} d, (SELECT avg(v) AS m, sqrt(greatest(1e-8, var_pop(v) * count(v) / greatest(1, count(v) - 1))) AS sd FROM {DIRTY} WHERE batch_id = 0) s)"


@query(sql(f"SELECT row_id, {R('coalesce(v, m)')} AS x FROM {IMPUTED}", "ev"))
def impute_mean(spark, sf_dir):
    d = dirty_events(spark, sf_dir)
    stats = encode.frozen_stats(d.where("batch_id = 0"), ["raw"])
    return d.join(F.broadcast(stats)).select("row_id", r6(F.coalesce(clean("raw"), F.col("impute_raw"))).alias("x"))


@query(sql(f"SELECT row_id, {R('least(8.0, greatest(-8.0, (coalesce(v, m) - m) / greatest(sd, 1e-8)))')} AS z FROM {IMPUTED}", "ev"))
def zscore_frozen(spark, sf_dir):
    d = dirty_events(spark, sf_dir)
    stats = encode.frozen_stats(d.where("batch_id = 0"), ["raw"])
    return d.join(F.broadcast(stats)).select("row_id", r6(encode.scaled("raw")).alias("z"))


@query(sql(f"SELECT row_id, {sql_bin('cat')} AS bin FROM {DIRTY}", "ev"))
def hash_bin_(spark, sf_dir):
    return dirty_events(spark, sf_dir).select("row_id", hash_bin("cat").alias("bin"))


Q["hash_bin"], O["hash_bin"] = Q.pop("hash_bin_"), O.pop("hash_bin_")


@query(sql(f"SELECT row_id, {', '.join(f'CAST(CASE WHEN b = {i} THEN 1 ELSE 0 END AS DOUBLE) AS cat_hash_{i}' for i in range(16))} FROM (SELECT row_id, {sql_bin('cat')} AS b FROM {DIRTY})", "ev"))
def hash_onehot(spark, sf_dir):
    d = dirty_events(spark, sf_dir)
    return encode.encode(d, spark.range(1), ["row_id"], [], ["cat"])


@query("SELECT CAST(i AS INTEGER) AS position, name FROM (SELECT unnest(range(0, 20)) AS i, unnest(['raw_scaled', 'raw_isna', 'x1_scaled', 'x1_isna', " + ", ".join(f"'cat_hash_{i}'" for i in range(16)) + "]) AS name)")
def encode_schema(spark, sf_dir):
    names = encode.feature_names(["raw", "x1"], ["cat"])
    return spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("position", T.IntegerType()), T.StructField("name", T.StringType())]))


ENC = f"""(SELECT d.row_id, d.batch_id, least(8.0, greatest(-8.0, (coalesce(v, m) - m) / greatest(sd, 1e-8))) AS raw_scaled, CAST(v IS NULL AS DOUBLE) AS raw_isna,
  least(8.0, greatest(-8.0, (x1 - m1) / greatest(sd1, 1e-8))) AS x1_scaled, CAST(0 AS DOUBLE) AS x1_isna, {sql_bin('cat')} AS b FROM {IMPUTED} d,
  (SELECT avg(x1) AS m1, sqrt(greatest(1e-8, var_pop(x1) * count(x1) / greatest(1, count(x1) - 1))) AS sd1 FROM {DIRTY} WHERE batch_id = 0))"""


def encoded(spark, sf_dir):
    d = dirty_events(spark, sf_dir)
    return encode.encode(d, encode.frozen_stats(d.where("batch_id = 0"), ["raw", "x1"]), ["row_id", "batch_id"], ["raw", "x1"], ["cat"])


@query(sql(f"SELECT row_id, batch_id, {R('raw_scaled')} AS raw_scaled, raw_isna, {R('x1_scaled')} AS x1_scaled, x1_isna, {', '.join(f'CAST(CASE WHEN b = {i} THEN 1 ELSE 0 END AS DOUBLE) AS cat_hash_{i}' for i in range(16))} FROM {ENC}", "ev"))
def encode_full(spark, sf_dir):
    return encoded(spark, sf_dir).withColumns({c: r6(c) for c in ("raw_scaled", "x1_scaled")})


@query(sql(f"SELECT row_id, {R('raw_scaled')} AS raw_scaled, raw_isna, CAST(0 AS DOUBLE) AS gone_scaled, CAST(1 AS DOUBLE) AS gone_isna FROM {ENC}", "ev"))
def schema_evolve(spark, sf_dir):
    d = dirty_events(spark, sf_dir).withColumn("extra", F.lit("x"))
    stats = encode.frozen_stats(d.where("batch_id = 0").withColumn("gone", F.lit(None).cast("double")), ["raw", "gone"])
    out = encode.encode(d, stats, ["row_id"], ["raw", "gone"], [])
    return out.withColumns({c: r6(c) for c in ("raw_scaled", "gone_scaled")})


@query(sql(f"SELECT row_id, CAST(20 AS INTEGER) AS width, {R('raw_scaled + raw_isna + x1_scaled + 1.0')} AS total FROM {ENC}", "ev"))
def feature_vector(spark, sf_dir):
    e = encoded(spark, sf_dir)
    v = e.select("row_id", F.array(*encode.feature_names(["raw", "x1"], ["cat"])).alias("v"))
    return v.select("row_id", F.size("v").alias("width"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(sql(f"""SELECT batch_id, 'raw' AS "column", count(v) AS n, {R('avg(v)')} AS mean, round(var_pop(v) * count(v), 3) + 0.0 AS m2 FROM {DIRTY} GROUP BY batch_id
  UNION ALL SELECT batch_id, 'x1', count(x1), {R('avg(x1)')}, round(var_pop(x1) * count(x1), 3) + 0.0 FROM {DIRTY} GROUP BY batch_id""", "ev"))
def welford_batch(spark, sf_dir):
    m = encode.batch_moments(dirty_events(spark, sf_dir), ["raw", "x1"])
    return m.select("batch_id", "column", "n", r6("mean").alias("mean"), (F.round("m2", 3) + 0.0).alias("m2"))


@query(sql(f"""SELECT b.batch_id, 'raw' AS "column", count(v) AS n, {R('avg(v)')} AS mean, round(var_pop(v) * count(v), 3) + 0.0 AS m2
  FROM (SELECT DISTINCT batch_id FROM ev) b JOIN {DIRTY} d ON d.batch_id <= b.batch_id GROUP BY b.batch_id""", "ev"))
def welford_merge(spark, sf_dir):
    m = encode.merged_moments(encode.batch_moments(dirty_events(spark, sf_dir), ["raw"]))
    return m.select("batch_id", "column", "n", r6("mean").alias("mean"), (F.round("m2", 3) + 0.0).alias("m2"))


@query(sql(f"SELECT {R('m')} AS mean_raw, {R('sd')} AS std_raw, {R('m')} AS impute_raw FROM (SELECT DISTINCT m, sd FROM {IMPUTED})", "ev"))
def freeze_stats(spark, sf_dir):
    s = encode.frozen_stats(dirty_events(spark, sf_dir).where("batch_id = 0"), ["raw"])
    return s.select(*(r6(c).alias(c) for c in s.columns))


@query(sql(f"""SELECT b.batch_id, bin, count(*) AS n FROM (SELECT DISTINCT batch_id FROM ev) b JOIN (SELECT batch_id AS t, {sql_bin('cat')} AS bin FROM {DIRTY}) d ON d.t <= b.batch_id GROUP BY b.batch_id, bin""", "ev"))
def cat_hist_running(spark, sf_dir):
    return encode.running_histogram(dirty_events(spark, sf_dir), "cat")


@query(sql("SELECT batch_id, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY batch_id) AS BIGINT) AS seen, row_number() OVER (ORDER BY batch_id) - 1 AS updates FROM ev GROUP BY batch_id", "ev"))
def lifetime_counts(spark, sf_dir):
    w = W.orderBy("batch_id")  # a row per batch
    return streams.events(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n")).select("batch_id", "n", F.sum("n").over(w).alias("seen"), (F.row_number().over(w) - 1).cast("long").alias("updates"))


# -- shifts ----------------------------------------------------------------------------------------------------------


@query(sql(f"SELECT row_id, {R('x0 + 2.0 * sx0')} AS x0, {R('x1 + 2.0 * sx1')} AS x1 FROM ev JOIN evm USING (batch_id)", "evm"))
def mean_shift(spark, sf_dir):
    return shifts.mean_shift(streams.events(spark, sf_dir), ["x0", "x1"]).select("row_id", r6("x0").alias("x0"), r6("x1").alias("x1"))


@query(sql(f"SELECT row_id, {R('ax0 + 2.5 * (x0 - ax0)')} AS x0, {R('ax1 + 2.5 * (x1 - ax1)')} AS x1 FROM ev JOIN evm USING (batch_id)", "evm"))
def scale_shift(spark, sf_dir):
    return shifts.scale_shift(streams.events(spark, sf_dir), ["x0", "x1"]).select("row_id", r6("x0").alias("x0"), r6("x1").alias("x1"))


@query(sql(f"SELECT row_id, {R('cos(pi() / 4) * x0 - sin(pi() / 4) * x1')} AS x0, {R('sin(pi() / 4) * x0 + cos(pi() / 4) * x1')} AS x1 FROM ev", "ev"))
def rotation_shift(spark, sf_dir):
    return shifts.rotation_shift(streams.events(spark, sf_dir), ("x0", "x1")).select("row_id", r6("x0").alias("x0"), r6("x1").alias("x1"))


@query(sql(f"SELECT row_id, {R('y + 3.0 * sin(x0 * x1)')} AS y FROM ev", "ev"))
def concept_shift_reg(spark, sf_dir):
    return streams.events(spark, sf_dir).select("row_id", r6(shifts.concept_shift(F.col("y"), F.col("x0"), F.col("x1"))).alias("y"))


_FLIP = """SELECT o.row_id, o.batch_id, CASE WHEN f.row_id IS NULL THEN y ELSE 1 - y END AS y FROM od o LEFT JOIN (SELECT row_id, batch_id FROM (
  SELECT *, {rank} AS k, floor({rate} * count(*) OVER (PARTITION BY batch_id)) AS want FROM ({pool})) WHERE k <= want) f ON f.row_id = o.row_id AND f.batch_id = o.batch_id"""


@query(sql(_FLIP.format(rank=hash_rank("flip"), rate=0.4, pool="SELECT od.* FROM od JOIN (SELECT batch_id, median(price) AS mp, median(balance) AS mb FROM od GROUP BY batch_id) USING (batch_id) WHERE price > mp AND balance > mb"), "od"))
def concept_flip(spark, sf_dir):
    return shifts.concept_flip(streams.orders(spark, sf_dir), ["price", "balance"], 0.4, "flip").select("row_id", "batch_id", "y")


@query(sql(_FLIP.format(rank=hash_rank("noise"), rate=0.1, pool="SELECT * FROM od"), "od"))
def label_noise(spark, sf_dir):
    return shifts.flip_labels(streams.orders(spark, sf_dir), 0.1, "noise").select("row_id", "batch_id", "y")


@query(sql(f"SELECT row_id, {R('y + 2.0 * ' + norm('ns'))} AS y FROM ev", "ev"))
def noise_shift(spark, sf_dir):
    return streams.events(spark, sf_dir).select("row_id", r6(shifts.noise_shift(F.col("y"), 2.0, "ns")).alias("y"))


@query(sql("""SELECT s.batch_id, CAST(slot AS INTEGER) AS slot, p.row_id, s.y FROM (
  SELECT *, CAST(CAST(concat('0x', substr(md5(concat('ps', 's:', batch_id, ':', slot)), 1, 8)) AS BIGINT) % CASE WHEN y = 1 THEN n1 ELSE n - n1 END AS INTEGER) AS place FROM (
    SELECT batch_id, n, n1, slot, CAST(slot < floor(n * 0.15) AS INTEGER) AS y FROM (SELECT batch_id, count(*) AS n, sum(y) AS n1, unnest(range(0, count(*))) AS slot FROM od GROUP BY batch_id))
  WHERE CASE WHEN y = 1 THEN n1 ELSE n - n1 END > 0) s
  JOIN (SELECT *, row_number() OVER (PARTITION BY batch_id, y ORDER BY md5(concat('ps:', row_id)), row_id) - 1 AS place FROM od) p ON p.batch_id = s.batch_id AND p.y = s.y AND p.place = s.place""", "od"))
def prior_shift(spark, sf_dir):
    return shifts.prior_shift(streams.orders(spark, sf_dir), 0.15, "ps").select("batch_id", "slot", "row_id", "y")


# -- sampling --------------------------------------------------------------------------------------------------------


@query(sql("SELECT row_id, batch_id, CAST(is_eval AS INTEGER) AS is_eval FROM ho", "ho"))
def holdout_split(spark, sf_dir):
    return sampling.holdout_split(streams.lineitems(spark, sf_dir)).select("row_id", "batch_id", F.col("is_eval").cast("int").alias("is_eval"))


@query(sql("SELECT batch_id, count(*) AS n_rows, CAST(0 AS BIGINT) AS in_both, count(*) FILTER (WHERE is_eval) AS n_eval, count(*) FILTER (WHERE NOT is_eval) AS n_update FROM ho GROUP BY batch_id", "ho"))
def leakage_anti(spark, sf_dir):
    s = sampling.holdout_split(streams.lineitems(spark, sf_dir))
    hidden, learned = s.where("is_eval"), s.where("not is_eval")
    both = learned.join(hidden.select("batch_id", "row_id"), ["batch_id", "row_id"], "left_semi").groupBy("batch_id").agg(F.count("*").alias("in_both"))
    clear = learned.join(hidden.select("batch_id", "row_id"), ["batch_id", "row_id"], "left_anti").groupBy("batch_id").agg(F.count("*").alias("n_update"))
    rest = s.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.count_if("is_eval").alias("n_eval"))
    return rest.join(clear, "batch_id", "left").join(both, "batch_id", "left").select("batch_id", "n_rows", F.coalesce("in_both", F.lit(0)).alias("in_both"), "n_eval", "n_update")


@query(sql(f"SELECT row_id, batch_id FROM (SELECT *, {hash_rank('k')} AS k FROM ev) WHERE k <= 50", "ev"))
def sample_k(spark, sf_dir):
    return sampling.take_by_hash(streams.events(spark, sf_dir), ["batch_id"], 50, "k").select("row_id", "batch_id")


@query(sql(f"SELECT row_id FROM (SELECT *, {hash_rank('ref', '')} AS k FROM ev WHERE batch_id = 0) WHERE k <= 256", "ev"))
def reference_sample(spark, sf_dir):
    from driftloom.operators.drift import reference_sample as take

    return take(streams.events(spark, sf_dir).where("batch_id = 0")).select("row_id")


@query(sql(f"SELECT t AS batch_id, row_id FROM (SELECT b.batch_id AS t, e.row_id, row_number() OVER (PARTITION BY b.batch_id ORDER BY md5(concat('res:', e.row_id)), e.row_id) AS k FROM (SELECT DISTINCT batch_id FROM ev) b JOIN ev e ON e.batch_id <= b.batch_id) WHERE k <= 64", "ev"))
def reservoir_bottomk(spark, sf_dir):
    """The reservoir after each batch. Only a batch's own 64 smallest hashes can be in a later reservoir."""
    e = streams.events(spark, sf_dir)
    own = sampling.take_by_hash(e, ["batch_id"], 64, "res").select("batch_id", "row_id")
    later = own.select(F.col("batch_id").alias("t")).distinct()
    pairs = own.join(F.broadcast(later), F.col("batch_id") <= F.col("t"))
    k = F.row_number().over(W.partitionBy("t").orderBy(rank_key("res", "row_id"), "row_id"))
    return pairs.withColumn("k", k).where("k <= 64").select(F.col("t").alias("batch_id"), "row_id")


_STRATA = f"""(SELECT e.*, greatest(0, least(9, len(list_filter(edges, lambda v: v <= y)) - 1)) AS stratum FROM ev e JOIN (
  SELECT batch_id, list_sort(list_distinct([q[1] - 1e-9, {', '.join(f'round(q[{i}], 9)' for i in range(2, 11))}, q[11] + 1e-9])) AS edges FROM (SELECT batch_id, quantile_cont(y, {QS}) AS q FROM ev GROUP BY batch_id)) USING (batch_id))"""


@query(sql(f"SELECT row_id, batch_id, CAST(stratum AS INTEGER) AS stratum FROM {_STRATA}", "ev"))
def strata_assign(spark, sf_dir):
    return sampling.strata(streams.events(spark, sf_dir)).select("row_id", "batch_id", F.col("stratum").cast("int").alias("stratum"))


@query(sql(f"""SELECT batch_id, CAST(stratum AS INTEGER) AS stratum, row_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, stratum ORDER BY md5(concat('q:', row_id)), row_id) AS k,
  dense_rank() OVER (PARTITION BY batch_id ORDER BY stratum) - 1 AS i FROM {_STRATA}) JOIN (SELECT batch_id, count(DISTINCT stratum) AS s FROM {_STRATA} GROUP BY batch_id) USING (batch_id)
  WHERE k <= 53 // s + CASE WHEN i < 53 % s THEN 1 ELSE 0 END""", "ev"))
def strata_quota(spark, sf_dir):
    s = sampling.strata(streams.events(spark, sf_dir))
    return sampling.stratified(s, 53, "q", ["batch_id"]).select("batch_id", F.col("stratum").cast("int").alias("stratum"), "row_id")


@query(sql("""SELECT batch_id, n, CAST(least(500, n_before) AS BIGINT) AS n_replay, CAST(CASE WHEN n_before > 0 THEN least(least(500, n_before), greatest(8, CAST(floor(n * 0.35) AS BIGINT))) ELSE 0 END AS BIGINT) AS specialist_replay,
  CAST(CASE WHEN n_before > 0 THEN greatest(8, least(n, CAST(floor(n * greatest(0.10, 0.20 * 0.6)) AS BIGINT))) ELSE greatest(8, CAST(floor(n * 0.5) AS BIGINT)) END AS BIGINT) AS anchor_current
  FROM (SELECT batch_id, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before FROM ev GROUP BY batch_id)""", "ev"))
def replay_mix_counts(spark, sf_dir):
    """Sizes of the training sets at a replay ratio of 0.35 and an adaptation rate of 0.6."""
    w = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1)  # a row per batch
    b = streams.events(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    rep, n = F.least(F.lit(500), F.col("before")), F.col("n")
    special, anchor = training_sizes(n, rep, 0.35, 0.6)
    return b.select("batch_id", "n", rep.alias("n_replay"), special.cast("long").alias("specialist_replay"), anchor.cast("long").alias("anchor_current"))


@query(sql("SELECT t AS batch_id, row_id FROM (SELECT b.batch_id AS t, e.row_id, row_number() OVER (PARTITION BY b.batch_id ORDER BY e.batch_id DESC, e.row_id DESC) AS k FROM (SELECT DISTINCT batch_id FROM ev) b JOIN ev e ON e.batch_id <= b.batch_id) WHERE k <= 100", "ev"))
def fifo_replay(spark, sf_dir):
    e = streams.events(spark, sf_dir)
    own = sampling.last_rows(e.select("batch_id", "row_id"), ["batch_id"], 100)
    later = own.select(F.col("batch_id").alias("t")).distinct()
    k = F.row_number().over(W.partitionBy("t").orderBy(F.desc("batch_id"), F.desc("row_id")))
    return own.join(F.broadcast(later), F.col("batch_id") <= F.col("t")).withColumn("k", k).where("k <= 100").select(F.col("t").alias("batch_id"), "row_id")


@query(sql("SELECT batch_id, n FROM (SELECT batch_id, count(*) AS n, row_number() OVER (ORDER BY batch_id DESC) AS k FROM ev GROUP BY batch_id) WHERE k <= 4", "ev"))
def diagnostics_tail(spark, sf_dir):
    log = streams.events(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n"))
    return log.orderBy(F.desc("batch_id")).limit(4)  # the bounded history is the feature


@query("""SELECT label, CAST(vec_id AS BIGINT) AS vec_id FROM (SELECT e.label, vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(embedding[i] AS DOUBLE) - c[i], 2))), 9), vec_id) AS k
  FROM embeddings e JOIN (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, i) GROUP BY label) USING (label)) WHERE k = 1""")
def fps_seed(spark, sf_dir):
    """The vector nearest to its stratum's centroid, the first on ties: where farthest-point selection begins."""
    e = streams.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    centre = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = centre.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # 64 numbers a label
    d = F.round(F.aggregate(F.zip_with("embedding", "c", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, x: a + x), 9)
    return e.join(centre, "label").groupBy("label").agg(F.min_by("vec_id", F.struct(d, F.col("vec_id"))).alias("vec_id"))


def _farthest_sql(capacity: int = 60, picks: int = 6, width: int = 64) -> str:
    """Greedy farthest points, a step for each pick: as many as ten strata have."""
    apart = f"list_sum(list_transform(range(1, {width} + 1), lambda i: pow(x[i] - p[i], 2)))"
    parts = [
        "e AS (SELECT vec_id, CAST(label AS INTEGER) AS s, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL)",
        f"q AS (SELECT s, n, {capacity} // c + CASE WHEN k < {capacity} % c THEN 1 ELSE 0 END AS want FROM (SELECT s, count(*) AS n, count(*) OVER () AS c, row_number() OVER (ORDER BY s) - 1 AS k FROM e GROUP BY s))",
        f"m AS (SELECT s, list(v ORDER BY i) AS p FROM (SELECT s, i, avg(v) AS v FROM (SELECT s, unnest(range(1, {width} + 1)) AS i, unnest(x) AS v FROM e) GROUP BY s, i) GROUP BY s)",
        f"d0 AS (SELECT vec_id, s, x, -{apart} AS gap FROM e JOIN m USING (s))",
    ]
    for k in range(picks):
        parts.append(f"k{k} AS (SELECT s, arg_max(vec_id, (gap, -vec_id)) AS vec_id, arg_max(x, (gap, -vec_id)) AS p FROM d{k} GROUP BY s)")
        parts.append(f"d{k + 1} AS (SELECT d.vec_id, s, x, {'least(gap, ' + apart + ')' if k else apart} AS gap FROM d{k} d JOIN k{k} USING (s))")
    chosen = " UNION ALL ".join(f"SELECT s, vec_id, {k} AS pick FROM k{k}" for k in range(picks))
    parts.append(f"c AS (SELECT vec_id, s, pick FROM ({chosen}) JOIN q USING (s) WHERE n > want AND pick < want UNION ALL SELECT vec_id, s, row_number() OVER (PARTITION BY s ORDER BY vec_id) - 1 FROM e JOIN q USING (s) WHERE n <= want)")
    return f"WITH {', '.join(parts)} SELECT CAST(vec_id AS BIGINT) AS row_id, s AS stratum, CAST(pick AS BIGINT) AS pick FROM c"


@query(_farthest_sql())
def fps_select(spark, sf_dir):
    """Sixty vectors, farthest from one another in each label."""
    e = streams.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("stratum"), F.col("embedding").alias("features"))
    return sampling.select_farthest(e, 60)


@query()
def replay_update(spark, sf_dir):
    """The buffer of 150 rows after every batch of the stream, its features encoded with statistics of the first one."""
    e = streams.events(spark, sf_dir)
    batches = [r["batch_id"] for r in e.select("batch_id").where("batch_id is not null").distinct().orderBy("batch_id").collect()]  # a row per batch
    numeric, categories = ["x0", "x1", "x2"], ["cat"]
    encoded = encode.encode(e, encode.frozen_stats(e.where(F.col("batch_id") == min(batches, default=0)), numeric), ["row_id", "y", "batch_id"], numeric, categories)
    rows = stored(encoded.select("row_id", "y", "batch_id", F.array(*encode.feature_names(numeric, categories)).alias("features")), "replay-rows")
    buffer = None
    for b in batches:
        buffer = sampling.replay_update(buffer, rows.where(F.col("batch_id") == b), 150, "features")
    buffer = sampling.restrata(rows) if buffer is None else buffer
    return buffer.select("row_id", "stratum", "y", "batch_id")
