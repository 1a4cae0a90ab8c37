"""Pieces of SQL for comparing queries: named common table expressions and the expressions in them."""

from __future__ import annotations


def unif(seed: str, row_id: str = "row_id") -> str:
    return f"((CAST(concat('0x', substr(md5(concat('{seed}:', {row_id})), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


def norm(seed: str, row_id: str = "row_id") -> str:
    return f"(sqrt(-2.0 * ln({unif(seed + 'a', row_id)})) * cos(2.0 * pi() * {unif(seed + 'b', row_id)}))"


def hash_bin(column: str, bins: int = 16) -> str:
    return f"CAST(CAST(concat('0x', substr(md5(coalesce(CAST({column} AS VARCHAR), '__MISSING__')), 1, 8)) AS BIGINT) % {bins} AS INTEGER)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def hash_rank(seed: str, by: str = "batch_id") -> str:
    over = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({over}ORDER BY md5(concat('{seed}:', row_id)), row_id)"


def edge_list(q: str, bins: int = 10) -> str:
    inner = ", ".join(f"round({q}[{i}], 9)" for i in range(2, bins + 1))
    return f"list_sort(list_distinct([{q}[1] - 1e-6, {inner}, {q}[{bins + 1}] + 1e-6]))"


QS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"

CTES: dict[str, str] = {}

CTES["ev0"] = """SELECT event_id AS row_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5.0) AS INTEGER) AS batch_id,
  value AS x0, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x1, CAST(hour(ts) AS DOUBLE) AS x2, event_type AS cat, user_id FROM events"""
CTES["ev"] = f"SELECT *, 0.8 * x0 - 0.3 * x1 + 4.0 * ({unif('y')} - 0.5) AS y FROM ev0"
CTES["li0"] = """SELECT CAST(concat('0x', substr(md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15)) AS BIGINT) AS row_id, CAST(year(l_shipdate) - 1995 AS INTEGER) AS batch_id,
  CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS d FROM lineitem"""
CTES["li"] = f"SELECT *, (CASE WHEN batch_id >= 3 THEN -2.0 ELSE 3.0 END) * x + 50.0 * d + 10.0 * ({unif('li')} - 0.5) AS y FROM li0"
CTES["od0"] = """SELECT o_orderkey AS row_id, CAST(year(o_orderdate) - 1995 AS INTEGER) AS batch_id, o_totalprice AS price, c_acctbal AS balance,
  o_orderpriority AS priority, c_mktsegment AS segment, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey"""
CTES["od"] = f"""SELECT *, CAST({unif('oy')} < least(price / 400000.0, 1.0) AS INTEGER) AS y,
  round(greatest(0.0, least(1.0, price / 500000.0 + 0.3 * ({unif('op')} - 0.5))), 2) AS p FROM od0"""
CTES["evm"] = "SELECT batch_id, " + ", ".join(f"avg({c}) AS a{c}, CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1.0 END AS s{c}" for c in ("x0", "x1", "x2")) + " FROM ev GROUP BY batch_id"
CTES["sh0"] = """SELECT ev.*, ax0, sx0, ax1, sx1, ax2, sx2,
  CASE batch_id WHEN 1 THEN ax0 + 2.2 * sx0 + 1.8 * (x0 - ax0) WHEN 4 THEN cos(pi() / 3) * x0 - sin(pi() / 3) * x1 WHEN 5 THEN ax0 + 2.0 * (x0 - ax0) ELSE x0 END AS z0,
  CASE batch_id WHEN 1 THEN ax1 + 2.2 * sx1 + 1.8 * (x1 - ax1) WHEN 4 THEN sin(pi() / 3) * x0 + cos(pi() / 3) * x1 WHEN 5 THEN ax1 + 2.0 * (x1 - ax1) ELSE x1 END AS z1,
  CASE batch_id WHEN 5 THEN ax2 + 2.0 * (x2 - ax2) + 1.8 * 2.0 * sx2 ELSE x2 END AS z2 FROM ev JOIN evm USING (batch_id)"""
CTES["sh"] = f"""SELECT row_id, batch_id, cat, user_id, z0 AS x0, z1 AS x1, z2 AS x2,
  CASE batch_id WHEN 2 THEN y + 3.5 WHEN 3 THEN y + 4.0 * sin(x0 * x1) WHEN 4 THEN y + 1.8 * {norm('e4')} WHEN 5 THEN y + 3.5 * sin(z1 * z2) + 1.2 * {norm('e5')} ELSE y END AS y,
  ['baseline', 'covariate', 'prior', 'concept', 'rotation_noise', 'compound'][least(batch_id, 5) + 1] AS env FROM sh0"""
CTES["refs"] = f"SELECT * FROM (SELECT *, {hash_rank('ref', '')} AS rk FROM sh WHERE batch_id = 0) WHERE rk <= 256"
CTES["refl"] = "SELECT row_id, 'x0' AS feature, x0 AS x FROM refs UNION ALL SELECT row_id, 'x1', x1 FROM refs UNION ALL SELECT row_id, 'x2', x2 FROM refs"
CTES["curl"] = "SELECT batch_id, row_id, 'x0' AS feature, x0 AS x FROM sh UNION ALL SELECT batch_id, row_id, 'x1', x1 FROM sh UNION ALL SELECT batch_id, row_id, 'x2', x2 FROM sh"
CTES["sm0"] = f"SELECT feature, count(*) AS n, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, quantile_cont(x, {QS}) AS q FROM refl GROUP BY feature"
CTES["sm"] = f"""SELECT feature, n, CASE WHEN sd < 1e-6 THEN 1.0 ELSE sd END AS std, CASE WHEN hi <= lo THEN list_transform(range(0, 11), lambda i: lo - 1.0 + 2.0 * i / 10)
  WHEN len({edge_list('q')}) < 3 THEN list_transform(range(0, 11), lambda i: lo - 1e-6 + (hi - lo + 2e-6) * i / 10) ELSE {edge_list('q')} END AS edges FROM sm0"""


def hist(cur: str, edges: str, keys: str, on: str) -> str:
    return f"""SELECT g.*, coalesce(k.c, 0) AS c FROM
  (SELECT {keys}, count(*) AS n, len(any_value(edges)) - 1 AS bins, unnest(range(1, len(any_value(edges)))) AS bin FROM {cur} JOIN {edges} USING ({on}) GROUP BY {keys}) g
  LEFT JOIN (SELECT {keys}, CASE WHEN x = edges[-1] THEN len(edges) - 1 ELSE len(list_filter(edges, lambda e: e <= x)) END AS bin, count(*) AS c FROM {cur} JOIN {edges} USING ({on}) GROUP BY ALL) k
  USING ({keys}, bin)"""


def dist(cur: str, ref: str, keys: str, on: str) -> str:
    return f"""SELECT {keys}, sum(abs(cm / nm - ck / nk) * (nx - x)) AS wass FROM (
  SELECT {keys}, x, sum(m) OVER w AS cm, sum(m) OVER g AS nm, sum(k) OVER w AS ck, sum(k) OVER g AS nk, lead(x) OVER w AS nx FROM (
    SELECT {keys}, x, CAST(sum(m) AS DOUBLE) AS m, CAST(sum(k) AS DOUBLE) AS k FROM (
      SELECT {keys}, x, 1 AS m, 0 AS k FROM {cur} UNION ALL SELECT {keys}, x, 0, 1 FROM (SELECT DISTINCT {keys} FROM {cur}) JOIN {ref} USING ({on})) GROUP BY ALL)
  WINDOW w AS (PARTITION BY {keys} ORDER BY x), g AS (PARTITION BY {keys})) GROUP BY {keys}"""


CTES["hr"] = hist("refl", "sm", "feature", "feature")
CTES["hc"] = hist("curl", "sm", "batch_id, feature", "feature")
CTES["ps"] = """SELECT batch_id, feature, any_value(hc.n) AS n, greatest(0.0, sum((q - p) * ln(q / p))) AS psi FROM (SELECT *, (c + 0.001) / (n + 0.001 * bins) AS q FROM hc) hc
  JOIN (SELECT feature, bin, (c + 0.001) / (n + 0.001 * bins) AS p FROM hr) USING (feature, bin) GROUP BY batch_id, feature"""
CTES["wa"] = dist("curl", "refl", "batch_id, feature", "feature")
CTES["sc"] = """SELECT batch_id, feature, ps.n, psi, wass / std AS wass, 0.5 * least(1.0, greatest(0.0, psi / 0.25)) + 0.5 * least(1.0, greatest(0.0, wass / std / 0.2)) AS score
  FROM ps JOIN wa USING (batch_id, feature) JOIN sm USING (feature)"""
CTES["hv"] = """SELECT *, row_number() OVER (PARTITION BY pair ORDER BY md5(concat(pair, ':', row_id)), row_id) <= count(*) OVER (PARTITION BY pair) // 2 AS fst
  FROM (SELECT refs.*, unnest(['h1', 'h2', 'h3']) AS pair FROM refs)"""
CTES["ha"] = " UNION ALL ".join(f"SELECT pair, '{c}' AS feature, {c} AS x FROM hv WHERE fst" for c in ("x0", "x1", "x2"))
CTES["hb"] = " UNION ALL ".join(f"SELECT pair, '{c}' AS feature, {c} AS x FROM hv WHERE NOT fst" for c in ("x0", "x1", "x2"))
CTES["hs0"] = f"SELECT pair, feature, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, quantile_cont(x, {QS}) AS q FROM ha GROUP BY pair, feature"
CTES["hs"] = f"""SELECT pair, feature, greatest(1e-6, sd) AS std, CASE WHEN len({edge_list('q')}) < 3 THEN list_transform(range(0, 11), lambda i: lo - 1e-6 + (hi - lo + 2e-6) * i / 10)
  ELSE {edge_list('q')} END AS edges FROM hs0"""
CTES["hha"] = hist("ha", "hs", "pair, feature", "pair, feature")
CTES["hhb"] = hist("hb", "hs", "pair, feature", "pair, feature")
CTES["hps"] = """SELECT pair, feature, greatest(0.0, sum((q - p) * ln(q / p))) AS psi FROM (SELECT pair, feature, bin, (c + 0.001) / (n + 0.001 * bins) AS q FROM hhb)
  JOIN (SELECT pair, feature, bin, (c + 0.001) / (n + 0.001 * bins) AS p FROM hha) USING (pair, feature, bin) GROUP BY pair, feature"""
CTES["hwa"] = dist("hb", "ha", "pair, feature", "pair, feature")
CTES["hsc"] = """SELECT pair, quantile_cont(0.5 * least(1.0, psi / 0.25) + 0.5 * least(1.0, wass / std / 0.2), 0.8) AS score
  FROM hps JOIN hwa USING (pair, feature) JOIN hs USING (pair, feature) GROUP BY pair"""
CTES["fl"] = "SELECT CASE WHEN (SELECT count(*) FROM refs) < 64 THEN 0.0 ELSE coalesce(least(0.6, greatest(0.0, quantile_cont(score, 0.75))), 0.0) END AS floor FROM hsc"
CTES["cv"] = """SELECT batch_id, n, raw, floor, CASE WHEN floor > 0 THEN least(1.0, greatest(0.0, (raw - floor) / greatest(1e-6, 1.0 - floor))) ELSE raw END AS cov
  FROM (SELECT batch_id, quantile_cont(score, 0.8) AS raw, max(n) AS n FROM sc GROUP BY batch_id), fl"""
# residuals of a line fitted on the first batch
CTES["ols0"] = "SELECT regr_slope(y, x0) AS b, regr_intercept(y, x0) AS a FROM sh WHERE batch_id = 0"
CTES["rs"] = "SELECT batch_id, row_id, y - (a + b * x0) AS r FROM sh, ols0"
CTES["rm"] = "SELECT avg(r) AS mu, greatest(1e-4, stddev_pop(r)) AS sd FROM rs WHERE batch_id = 0"
CTES["bz"] = "SELECT batch_id, count(*) AS n, avg((r - mu) / sd) AS z FROM rs, rm GROUP BY batch_id"
CTES["cs"] = """SELECT 0 AS k, -1 AS batch_id, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS t, false AS alarm
  UNION ALL SELECT k, batch_id, p * f, m * f, t, t >= 3.5 FROM (
    SELECT *, CASE WHEN t >= 3.5 THEN 0.5 ELSE 1.0 END AS f FROM (
      SELECT *, greatest(p, -m, abs(z) * sqrt(n)) AS t FROM (
        SELECT b.k, b.batch_id, b.n, b.z, greatest(0.0, cs.p + b.z - 0.5) AS p, least(0.0, cs.m + b.z + 0.5) AS m
        FROM cs JOIN (SELECT *, row_number() OVER (ORDER BY batch_id) AS k FROM bz WHERE n >= 50) b ON b.k = cs.k + 1)))"""
CTES["rp"] = """SELECT batch_id, n, cov, cc AS concept, al AS alarm, ov AS overall, CASE WHEN n < 50 THEN CASE WHEN ov >= 0.1 THEN 'low' ELSE 'none' END
    WHEN al OR ov >= 0.55 THEN 'high' WHEN ov >= 0.25 THEN 'medium' WHEN ov >= 0.1 THEN 'low' ELSE 'none' END AS severity,
  CASE WHEN al AND cov >= 0.1 THEN 'compound' WHEN al THEN 'concept' WHEN cov >= 0.1 THEN 'covariate' ELSE 'none' END AS drift_type, 1.0 - exp(-n / 50.0) AS confidence
  FROM (SELECT *, least(1.0, greatest(0.0, CASE WHEN cc > 0 THEN 0.65 * cov + 0.35 * cc ELSE cov END)) AS ov FROM (
    SELECT cv.batch_id, cv.n, cov, least(1.0, coalesce(t / 3.5, 0.0)) AS cc, coalesce(alarm, false) AS al FROM cv LEFT JOIN cs ON cs.batch_id = cv.batch_id))"""
CTES["pe"] = """SELECT *, CASE WHEN alarm THEN least(1.0, e0 + 0.2 * greatest(concept, 0.5)) ELSE e0 END AS e FROM (SELECT *, least(1.0, overall * (0.5 + 0.5 * confidence)) AS e0 FROM rp)"""
CTES["pa"] = """SELECT batch_id, severity, drift_type, rate AS adaptation_rate, ws AS specialist_weight, 1.0 - ws AS anchor_weight,
  CASE WHEN alarm THEN greatest(0.15, 0.5 - 0.35 * e - 0.05) ELSE 0.5 - 0.35 * e END AS replay_blend_ratio, CAST(greatest(5, round_even(25.0 * (0.6 + rate), 0)) AS INTEGER) AS n_new_trees,
  0.05 * (0.75 + 0.75 * rate) AS learning_rate, 1.5 * (1.35 - 0.55 * rate) AS l2 FROM (
    SELECT *, 0.1 + 0.9 * e AS rate, CASE WHEN alarm THEN least(0.9, least(0.85, greatest(0.05, 0.08 + 0.78 * e)) + 0.1) ELSE least(0.85, greatest(0.05, 0.08 + 0.78 * e)) END AS ws FROM pe)"""
# one-feature least squares on line items, with a hidden fifth of each batch
CTES["ho"] = f"SELECT *, {hash_rank('split')} <= greatest(10, CAST(floor(count(*) OVER (PARTITION BY batch_id) * 0.2) AS BIGINT)) AS is_eval FROM li"
CTES["ss"] = "SELECT batch_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM ho WHERE NOT is_eval GROUP BY batch_id"


def solve(source: str, ridge: float = 0.0) -> str:
    return f"""SELECT batch_id, n, slope, (sy - slope * sx) / n AS intercept FROM (SELECT *, CASE WHEN sxx - sx * sx / n + {ridge} <> 0
  THEN (sxy - sx * sy / n) / (sxx - sx * sx / n + {ridge}) ELSE 0.0 END AS slope FROM {source})"""


CTES["m_naive"] = solve("ss")
CTES["ss_full"] = "SELECT batch_id, " + ", ".join(f"sum({c}) OVER (ORDER BY batch_id) AS {c}" for c in ("n", "sx", "sy", "sxx", "sxy")) + " FROM ss"
CTES["m_full"] = solve("ss_full")
CTES["ss_fifo"] = """SELECT batch_id, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM (SELECT * FROM ss UNION ALL
  SELECT t, count(*), sum(x), sum(y), sum(x * x), sum(x * y) FROM (SELECT s.batch_id AS t, l.x, l.y, row_number() OVER (PARTITION BY s.batch_id ORDER BY l.batch_id DESC, l.row_id DESC) AS k
    FROM (SELECT batch_id FROM ss) s JOIN (SELECT * FROM ho WHERE NOT is_eval) l ON l.batch_id < s.batch_id) WHERE k <= 500 GROUP BY t) GROUP BY batch_id"""
CTES["m_fifo"] = solve("ss_fifo")
CTES["m_static"] = "SELECT s.batch_id, m.n, m.slope, m.intercept FROM ss s, (SELECT * FROM m_naive ORDER BY batch_id LIMIT 1) m"
CTES["models"] = "SELECT 'static' AS model, * FROM m_static UNION ALL SELECT 'naive', * FROM m_naive UNION ALL SELECT 'full', * FROM m_full UNION ALL SELECT 'replay', * FROM m_fifo"
CTES["pq"] = """SELECT model, h.batch_id, count(*) AS n, sqrt(avg(pow(y - intercept - slope * x, 2))) AS rmse FROM (SELECT * FROM ho WHERE is_eval) h JOIN models USING (batch_id) GROUP BY model, h.batch_id"""

#: What each expression builds on.
NEEDS = {
    "ev": "ev0", "li": "li0", "od": "od0", "evm": "ev", "sh0": "ev evm", "sh": "sh0", "refs": "sh", "refl": "refs", "curl": "sh", "sm0": "refl", "sm": "sm0", "hr": "refl sm", "hc": "curl sm", "ps": "hc hr",
    "wa": "curl refl", "sc": "ps wa sm", "hv": "refs", "ha": "hv", "hb": "hv", "hs0": "ha", "hs": "hs0", "hha": "ha hs", "hhb": "hb hs", "hps": "hha hhb", "hwa": "hb ha", "hsc": "hps hwa hs", "fl": "hsc refs",
    "cv": "sc fl", "ols0": "sh", "rs": "sh ols0", "rm": "rs", "bz": "rs rm", "cs": "bz", "rp": "cv cs", "pe": "rp", "pa": "pe", "ho": "li", "ss": "ho", "m_naive": "ss", "ss_full": "ss", "m_full": "ss_full",
    "ss_fifo": "ss ho", "m_fifo": "ss_fifo", "m_static": "ss m_naive", "models": "m_static m_naive m_full m_fifo", "pq": "ho models",
}


def sql(select: str, *names: str) -> str:
    """A statement over the named expressions and all that they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, "").split():
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" if order else "") + select


def family_sql(name: str, rows: int = 1000, seed: int = 42) -> str:
    """A synthetic family by its definition, numbers to six digits."""
    k = int(name[-1])
    u, z = (lambda i: unif(f"f{k}.{seed}.{i}")), (lambda i: norm(f"f{k}.{seed}.{i}"))
    sigmoid = lambda x: f"(1.0 / (1.0 + exp(-({x}))))"
    number = lambda names: ", ".join(f"{r6(c)} AS {c}" for c in names)

    def case(seed_: str, bounds: list[tuple[str, float]]) -> str:
        return "CASE " + " ".join(f"WHEN {u(seed_)} < {b!r} THEN '{n}'" for n, b in bounds[:-1]) + f" ELSE '{bounds[-1][0]}' END"

    if k == 1:
        names = [f"x_{i}" for i in range(10)]
        columns = ", ".join(f"{u(i)} AS x_{i}" for i in range(10))
        target = f"10.0 * sin(pi() * x_0 * x_1) + 20.0 * pow(x_2 - 0.5, 2.0) + 10.0 * x_3 + 5.0 * x_4 + 0.5 * {z('e')}"
        last = f"{number(names)}, {r6(target)} AS target"
    elif k == 2:
        names = [f"feat_{i}" for i in range(12)]
        columns = ", ".join(f"{z(i)} AS feat_{i}" for i in range(12))
        margin = f"1.5 * feat_0 - 2.0 * feat_1 + 3.0 * feat_2 * feat_3 - 1.2 * feat_4 * feat_4 + 0.4 * {z('e')}"
        last = f"{number(names)}, CAST({u('u')} < {sigmoid(margin)} AS INTEGER) AS target"
    elif k == 3:
        names = [f"dim_{i}" for i in range(40)]
        columns = f"{z(0)} AS dim_0, " + ", ".join(f"0.5 * dim_{i - 1} + sqrt(0.75) * {z(i)} AS dim_{i}" for i in range(1, 40))
        target = f"4.0 * dim_2 - 3.5 * dim_7 + 2.0 * dim_15 - 2.5 * dim_25 + 5.0 * dim_38 + {z('e')}"
        last = f"{number(names)}, {r6(target)} AS target"
    elif k == 4:
        names = [f"num_{i}" for i in range(8)]
        columns = ", ".join(f"{z(i)} AS num_{i}" for i in range(8))
        columns += f", {case('t', [('Alpha', 0.4), ('Beta', 0.4 + 0.3), ('Gamma', 0.4 + 0.3 + 0.2), ('Delta', 1.0)])} AS cat_tier"
        columns += f", {case('z', [('North', 0.25), ('South', 0.5), ('East', 0.75), ('West', 1.0)])} AS cat_zone"
        columns += f", {case('g', [('Group_0', 0.5), ('Group_1', 0.5 + 0.3), ('Group_2', 1.0)])} AS subgroup_id"
        weight = "CASE cat_tier WHEN 'Alpha' THEN 1.5 WHEN 'Beta' THEN 0.5 WHEN 'Gamma' THEN -0.8 ELSE -1.8 END"
        margin = f"1.8 * num_0 - 1.4 * num_1 + 0.8 * num_2 * num_3 + {weight} + 0.5 * {z('e')}"
        last = f"{number(names)}, cat_tier, cat_zone, subgroup_id, CAST({u('u')} < {sigmoid(margin)} AS INTEGER) AS target"
    else:
        names = [f"var_{i}" for i in range(10)]
        columns = ", ".join(f"4.0 * {u(i)} - 2.0 AS var_{i}" for i in range(10))
        size = "sqrt(var_0 * var_0 + var_1 * var_1 + var_2 * var_2)"
        target = f"3.0 * tanh(var_0) + 2.0 * var_1 - 1.5 * var_2 * var_2 + {z('e')} * (0.3 + 0.5 * {size})"
        last = f"{number(names)}, {r6(target)} AS target"
    return f"SELECT row_id, {last} FROM (SELECT row_id, {columns} FROM (SELECT unnest(range(0, {rows})) AS row_id))"
