"""Quality rules: text statistics and their robust multivariate outliers, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import SPACE, stored

#: Characters of the class of white space, for trimming and removing.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("log_words", "log_word_chars", "symbols", "dup_lines", "repeats")


@dataclass(frozen=True)
class Settings:
    """``share`` of each group is the subset of least determinant; ``first`` steps are taken from every start, and then, from
    the best one, steps until no log determinant falls by ``still``; ``cutoff`` is the 0.999 quantile of chi-squared with
    five degrees of freedom and ``median`` its median; ``floors`` are the least standard deviations of the features, below
    which a difference doesn't count; ``shrink`` rows' weight of the pooled estimate in each group's; ``small`` is the
    number of groups' rows that may be broadcast."""

    share: float = 0.75
    first: int = 2
    still: float = 1e-3
    cutoff: float = 20.515
    median: float = 4.351
    floors: tuple[float, ...] = (0.6, 0.08, 0.06, 0.1, 0.12)
    shrink: int = 20
    accuracy: int = 2000
    small: int = 20_000


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(BLANKS))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    one = keep.select(
        "doc_id", "lang", "source",
        F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE + "+", -1)).otherwise(F.array().cast("array<string>")).alias("w"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    n = F.greatest(F.size("w") - 2, F.lit(0))
    part = lambda k: F.slice("w", k, n)
    marks = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    two = one.select("doc_id", "lang", "source", "w", "word_chars", "n_symbols", "n_dup_lines", marks.alias("h"))
    # windows are sorted by a hash, and words compared where hashes are equal; most texts repeat none
    placed = F.array_sort(F.transform("h", lambda h, k: F.struct(h.alias("h"), (k + 1).alias("at"))))
    text_at = lambda at: F.slice("w", at, F.lit(3))

    def starts(s: Column) -> Column:
        m = F.size(s) - 1
        same = F.filter(F.arrays_zip(F.slice(s, 1, m).alias("x"), F.slice(s, 2, m).alias("y")), lambda p: (p["x"]["h"] == p["y"]["h"]) & (text_at(p["x"]["at"]) == text_at(p["y"]["at"])))
        return F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["x"]["at"], p["y"]["at"])))))

    repeated = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.transform(F.array(placed), starts)[0]).otherwise(F.array().cast("array<int>"))
    three = two.select("doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated.alias("s"))
    # each repeated window adds its three words but for those of the window before it
    cover = F.aggregate("s", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))
    return three.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", cover["n"].cast("long").alias("n_repeat_words"))


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log1p("n_words"), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def _distance(d: int) -> Column:
    """Squared Mahalanobis distance: the inverse Cholesky factor's rows times the centred features."""
    total = F.lit(0.0)
    for i in range(d):
        y = sum((F.col(f"r{i}{j}") * (F.col(f"f{j}") - F.col(f"m{j}")) for j in range(1, i + 1)), F.col(f"r{i}0") * (F.col("f0") - F.col("m0")))
        total = total + y * y
    return total


SALTS = 64


def _beside(rows: DataFrame, model: DataFrame, settings: Settings) -> DataFrame:
    """``rows`` with their key's rows of a stored table, which is broadcast if it is counted as small; else a salt by where
    a row is read deals a hot key's rows over tasks, each with a copy of the key's rows."""
    if model.count() <= settings.small:
        return rows.join(F.broadcast(model), "key")
    salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(salted, ["key", "salt"]).drop("salt")


def _upper(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _factored(groups: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """From centres m and covariances c to m, the inverse Cholesky factor r, and logdet, by keys. Floors bound variances."""
    d = len(settings.floors)
    out = groups.select(*keys, *(f"m{i}" for i in range(d)), *((F.greatest(F.col(f"c{i}{j}"), F.lit(settings.floors[i] ** 2)) if i == j else F.col(f"c{i}{j}")).alias(f"c{i}{j}") for i, j in _upper(d)))
    for i in range(d):
        for j in range(i + 1):
            rest = sum((-F.col(f"l{i}{t}") * F.col(f"l{j}{t}") for t in range(j)), F.col(f"c{i}{j}"))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(d):
        for i in range(j, d):
            value = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{t}") * F.col(f"r{t}{j}") for t in range(j + 1, i)), F.col(f"l{i}{j}") * F.col(f"r{j}{j}"))
            out = out.withColumn(f"r{i}{j}", value / F.col(f"l{i}{i}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, d)), 2 * F.log("l00"))
    return out.select(*keys, *(f"m{i}" for i in range(d)), *(f"r{i}{j}" for i, j in _upper(d)), logdet.alias("logdet"))


def _starts(good: DataFrame, settings: Settings) -> DataFrame:
    """Three starts by key: quartile spreads alone, with correlations of squashed deviates, and with those of their signs."""
    d = len(settings.floors)
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    found = good.groupBy("key").agg(*(F.percentile_approx(f"f{i}", quarters, settings.accuracy).alias(f"p{i}") for i in range(d)))
    spread = lambda i: F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(settings.floors[i]))
    middle = stored(found.select("key", *(F.col(f"p{i}")[1].alias(f"m{i}") for i in range(d)), *(spread(i).alias(f"s{i}") for i in range(d))), "centres")
    z = _beside(good, middle, settings).select("key", *(((F.col(f"f{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(d)))
    size = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, d)), F.col("z0") * F.col("z0"))), F.lit(1e-9))
    both = z.select("key", *(F.tanh(f"z{i}").alias(f"t{i}") for i in range(d)), *((F.col(f"z{i}") / size).alias(f"u{i}") for i in range(d)))
    sums = both.groupBy("key").agg(*(F.sum(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"{x}{i}{j}") for x in "tu" for i, j in _upper(d)))
    joined = stored(_beside(sums, middle, settings), "starts")
    # correlations shrunk towards none, so that each start has an inverse
    linked = lambda x, i, j: F.lit(0.0) if x is None else 0.9 * F.col(f"{x}{i}{j}") / F.sqrt(F.greatest(F.col(f"{x}{i}{i}") * F.col(f"{x}{j}{j}"), F.lit(1e-18)))
    kinds = []
    for k, x in enumerate((None, "t", "u")):
        cov = [(F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.col(f"s{i}") * F.col(f"s{j}") * linked(x, i, j)).alias(f"c{i}{j}") for i, j in _upper(d)]
        kinds.append(joined.select("key", F.lit(k).alias("start"), *(f"m{i}" for i in range(d)), *cov))
    return _factored(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), ["key", "start"], settings)


def _concentrated(good: DataFrame, model: DataFrame, settings: Settings) -> DataFrame:
    """One concentration step from each (key, start): mean and covariance of the nearest ``share`` of the group's rows.

    Covariances are shrunk to the estimate pooled over groups, whose sums are one row.
    """
    d, names = len(settings.floors), [f"f{i}" for i in range(len(settings.floors))]
    near = _beside(good, model, settings).select("key", "start", *names, _distance(d).alias("d2"))
    bound = stored(near.groupBy("key", "start").agg(F.percentile_approx("d2", settings.share, settings.accuracy).alias("bound")), "bounds")
    inner = _beside(good, stored(model.join(bound, ["key", "start"]), "bounded"), settings).withColumn("d2", _distance(d)).where("d2 <= bound")
    sums = inner.groupBy("key", "start").agg(F.count("*").cast("double").alias("n"), *(F.sum(f"f{i}").alias(f"s{i}") for i in range(d)), *(F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}{j}") for i, j in _upper(d)))
    groups = stored(sums, "sums")
    total = groups.agg(F.sum("n").alias("pn"), *(F.sum(f"s{i}").alias(f"ps{i}") for i in range(d)), *(F.sum(f"q{i}{j}").alias(f"pq{i}{j}") for i, j in _upper(d))).first().asDict()  # one row of sums
    pn = float(total["pn"] or 1)
    mean = [float(total[f"ps{i}"] or 0) / pn for i in range(d)]
    cov = {(i, j): float(total[f"pq{i}{j}"] or 0) / pn - mean[i] * mean[j] for i, j in _upper(d)}
    k, n = settings.shrink, F.col("n")
    own = lambda i, j: F.col(f"q{i}{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n
    shrunk = groups.select("key", "start", *(((F.col(f"s{i}") + k * mean[i]) / (n + k)).alias(f"m{i}") for i in range(d)), *(((n * own(i, j) + k * cov[i, j]) / (n + k)).alias(f"c{i}{j}") for i, j in _upper(d)))
    return _factored(shrunk, ["key", "start"], settings)


def fit(good: DataFrame, settings: Settings) -> DataFrame:
    """The estimate of least determinant by key: centre m, inverse Cholesky factor r, logdet.

    From each start some concentration steps are taken; the start whose determinant is least goes on, in steps that end
    for a key when its determinant falls no more. A determinant can't fall for ever, as variances have floors.
    """
    model = stored(_starts(good, settings), "model")
    for _ in range(settings.first):
        model = stored(_concentrated(good, model, settings), "model")
    names = model.columns
    best = stored(model.groupBy("key").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("b")).select("b.*"), "model")
    open_ = best
    while not open_.isEmpty():
        new = stored(_concentrated(good, open_, settings), "model")
        fell = new.join(open_.select("key", F.col("logdet").alias("before")), "key").where(F.col("logdet") < F.col("before") - settings.still).drop("before")
        open_ = stored(fell, "model")
        best = stored(best.join(open_.select("key"), "key", "left_anti").unionByName(open_.select(*best.columns)), "model")
    return best.drop("start")


def reject_outliers(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and distance.

    Documents that pass the base rules (50 words, at most half of them in repeated three-word windows) are rejected if their
    statistic vector, logs and square roots of shares, is far from its language's and source's: squared Mahalanobis distance
    by a minimum-covariance-determinant estimate, scaled by the group's median distance, over the cutoff. All sums, quantile
    sketches and joins are partial by task, so that a group of any size is never in one place. Null text is empty, so
    base_failed; null lang and null source are groups of their own; equal rows each count. No rows give none.
    """
    settings = settings or Settings()
    d = len(settings.floors)
    stats = statistics(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    key = F.to_json(F.struct("lang", "source"))
    rows = stored(stats.withColumn("base_failed", failed).withColumn("key", key).withColumns({f"f{i}": f for i, f in enumerate(_features())}).drop("lang", "source"), "statistics")
    good = rows.where(~F.col("base_failed")).select("key", *(f"f{i}" for i in range(d)))
    model = fit(good, settings)
    far = _beside(good, model, settings).select("key", _distance(d).alias("d2"))
    middle = far.groupBy("key").agg((F.greatest(F.percentile_approx("d2", 0.5, settings.accuracy) / settings.median, F.lit(1.0))).alias("scale"))
    model = stored(model.join(middle, "key"), "model")
    names = [f"f{i}" for i in range(d)]
    judged = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")).drop("key", *names)
    judged = judged.unionByName(_beside(rows.where(~F.col("base_failed")), model, settings).withColumn("distance", _distance(d) / F.col("scale")).select(*judged.columns))
    kept = ~F.col("base_failed") & (F.col("distance") <= settings.cutoff)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), F.when(~F.col("base_failed"), F.col("distance")).alias("distance"))
