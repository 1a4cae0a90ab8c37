"""Encoding round trips, classifiers' held-out accuracy, text statistics and URL verdicts on small fixtures."""

import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import bpe, langid, outliers, quality, queries, toxicity, urls
from driftloom.llm.queries import vocabulary_path

RNG = random.Random(3)
SYLLABLES = {"aa": ["tha", "ing", "er", "on", "wh"], "bb": ["sch", "ung", "keit", "zu", "ß"], "cc": ["eau", "que", "ment", "è", "oi"]}


def words(lang, n):
    return " ".join("".join(RNG.choices(SYLLABLES[lang], k=RNG.randint(1, 3))) for _ in range(n))


def test_bpe_equals_the_library(spark):
    path = vocabulary_path()
    texts = ["", None, "  ", "don't I'VE we'll it's", "<|endoftext|>hi <|startoftext|>", "ΑΣΣ ΟΔΟΣ", "é ﬁ ① ½ 日本語 한국어", "a\x1cb\x85c\u200bd", "!!!??? $%& 12345 abc123", "ab" * 2000, "👩‍👩‍👧 🇩🇪", "dup", "dup"]
    texts += ["".join(RNG.choice("abcdefghij'0!éßñ \n<|>ΣXYZ") for _ in range(RNG.randint(1, 90))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    library = bpe.WordBPE(path).library
    for r in bpe.encode_documents(docs, path, full=True).collect():
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(docs.where("false"), path).count() == 0


def labelled(spark, n, bad):
    rows = [(i, bad(i), int(i % 3 == 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows] + [(9000, None, None, None), (9001, "", None, None), (None, "x", None, None), (0, rows[0][1], "s", 0.5)], "doc_id long, text string, source string, score double")
    return docs, spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def accuracy(out, labels, column):
    j = out.join(labels.withColumnRenamed(column, "want"), "doc_id").where("held_out")
    return j.agg(F.avg((F.col("predicted") == F.col("want")).cast("double"))).first()[0]


def test_quality(spark):
    docs, labels = labelled(spark, 300, lambda i: " ".join(w + ("$$$" if i % 3 == 0 else "") for w in words("aa", 60).split()))
    out = quality.score_quality(docs, labels, settings=quality.Settings(epochs=150)).cache()
    assert out.count() == 304 and accuracy(out, labels, "quality") > 0.95
    assert out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(docs, labels.where("false")).select("score").distinct().first()[0] == 0.5
    assert quality.score_quality(docs.where("false"), labels).count() == 0
    names = ["score", "predicted", "held_out", "_score", "id", "y"]
    wide = docs.select("*", *(F.lit("v").alias(n) for n in names if n not in docs.columns))
    kept = quality.keep_good(wide, labels, settings=quality.Settings(epochs=150))
    assert kept.columns == wide.columns and kept.count() == out.where("predicted = 1").count()


def test_long_tokens_take_linear_time():
    words, size = quality.Words(1 << 15), 1 << 20
    model = toxicity.Toxicity(toxicity.Settings()).fit(["you idiot thing", "nice thing here", "you idiot", "fine"] * 50, [1, 0, 1, 0] * 50)
    begun = time.perf_counter()
    for token in ("!" * size, "a" + "!" * size, "a" * size, "!a" * (size // 2)):
        words.slots_of(token.encode())
    for text in ("a" + "!" * size, "a" * size, "x" + "." * size + "yy z", "a b " * (size // 4), "a.b." * (size // 4) + "cc d"):
        model.score([text])
    assert time.perf_counter() - begun < 40
    assert [toxicity.bare(t) for t in ("(word),!!", "word!!!", '"a"', "!!!", "", "a|b|", "x$$", "__a__")] == ["word),", "word", "a", "", "", "a|b", "x", "__a__"]


def test_toxicity(spark):
    docs, labels = labelled(spark, 400, lambda i: words("aa", 40) + (" you idiot moron " if i % 3 == 0 else " ") + words("aa", 40))
    out = toxicity.score_toxicity(docs, labels).cache()
    assert out.count() == 404 and accuracy(out, labels, "toxic") > 0.95
    texts = [t + " " + words("aa", 30) for t in ("", "", "idiot")]
    model = toxicity.Toxicity(toxicity.Settings()).fit([r["text"] for r in docs.where("doc_id < 400").orderBy("doc_id").collect()][:400], [int(i % 3 == 0) for i in sorted([*range(400), 0])][:400])
    for disguised in ("m0r0n", "i d i o t", "iiidiooot", "i.d.i.o.t"):
        assert any(model.weight(t) > 0 for t in model.tokens(disguised)), disguised
    assert model.score(texts)[2] > model.score(texts)[0]
    assert toxicity.score_toxicity(docs, labels.where("false")).select("score").distinct().first()[0] == 0.5


def test_toxicity_learns_from_every_label(spark):
    rows = [(i, words("aa", 6) + (f" idiot{words('bb', 1)}" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(9000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    own = [r["doc_id"] for r in docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).collect()]
    assert len(own) > 6000
    want = toxicity.Toxicity(toxicity.Settings()).fit([rows[i][1] for i in own], [rows[i][2] for i in own]).score([t for _, t, _ in rows])
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], want, atol=1e-6)


def test_toxicity_restores_only_what_can_be_in_the_lexicon(monkeypatch):
    model = toxicity.Toxicity(toxicity.Settings()).fit(["you idiot thing x_aab", "nice thing here", "you idiot x_aab m0ron2", "fine"] * 50, [1, 0, 1, 0] * 50)
    tokens = {"".join(RNG.choices("idotxab_.-01!m(\"ß", k=RNG.randint(1, 9))) for _ in range(20_000)}
    tokens |= {w[:k] + c * n + w[k:] for w in ("idiot", "youth", "x_aab", "m0ron2", "idiotic") for k in range(len(w) + 1) for c in "io.-_a!1" for n in (1, 2, 3)}
    want = {t: max((model.lexicon.get(f, 0.0) for r in model.readings(t) for f in model.features(r)), default=0.0) for t in tokens}
    assert {t: model.weight(t) for t in tokens} == want and 100 < sum(w > 0 for w in want.values()) < len(want)
    called, restore = [], model.restore
    monkeypatch.setattr(model, "restore", lambda token: called.append(token) or restore(token))
    model.score(["balloon coffee, a-b see... nice thing"])
    assert not called
    model.score(["an id.io.t"])
    assert called == ["id.io.t"]


def test_language(spark):
    langs = sorted(SYLLABLES)
    rows = [(i, words(langs[i % 3], 30), langs[i % 3]) for i in range(240)] + [(900, None, "aa"), (901, "123 !", "aa"), (902, "", None), (None, words("bb", 20), None), (1, words("bb", 20), "bb")]
    out = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).cache()
    want = {i: lang for i, _, lang in rows if lang}
    held = [(r["lang_pred"], want[r["doc_id"]]) for r in out.where("held_out and doc_id < 240").collect()]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert {r["lang_pred"] for r in out.where("doc_id in (900, 901, 902)").collect()} == {"und"}
    model = langid.Mixture(langid.Settings()).fit([(t.encode(), lang) for _, t, lang in rows[:240]])
    found = dict(model.infer((words("aa", 150) + " " + words("cc", 150)).encode())[2])
    assert set(found) == {"aa", "cc"} and found["aa"] == pytest.approx(0.5, abs=0.2)


def test_mixed_text_goes_by_its_largest_share():
    langs = sorted(SYLLABLES)
    rows = [(words(langs[i % 3], 40).encode(), langs[i % 3]) for i in range(120)]
    # labels of mixed texts that follow their openings must not turn the verdict of others
    rows += [((words("cc", 60) + " " + words("aa", 90)).encode(), "cc") for _ in range(6)]
    lang, score, found = langid.Mixture(langid.Settings()).fit(rows).infer((words("cc", 60) + " " + words("aa", 240)).encode())
    assert lang == "aa" and dict(found).keys() == {"aa", "cc"} and score == max(dict(found).values())


def test_statistics_and_outliers(spark):
    rows = [(i, words("aa", 120), "en", "s1") for i in range(80)] + [(100 + i, " ".join(w + "$$$" for w in words("aa", 120).split()), "en", "s1") for i in range(6)]
    rows += [(200, None, None, None), (201, "", "en", None), (202, "a b c a b c\n\na b c\n a b c \na b c", "en", "s2"), (203, " \x0b ", "x", "y"), (204, words("aa", 20000), "en", "s1"), (5, rows[5][1], "en", "s1")]
    out = outliers.reject_outliers(spark.createDataFrame([(*r, 1.0, "k") for r in rows], "doc_id long, text string, lang string, source string, f0 double, key string")).collect()
    texts = {d: t for d, t, *_ in rows}
    for r in out:
        t = texts[r["doc_id"]] or ""
        w, seen, dup = re.findall("[^\x20\x09-\x0d]+", t), set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        if 100 <= r["doc_id"] < 200:
            assert not r["kept"]
    assert len(out) == len(rows)
    clean = [r["kept"] for r in out if r["doc_id"] < 80 and not r["base_failed"]]
    assert len(clean) > 70 and np.mean(clean) > 0.95
    assert outliers.reject_outliers(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def brute_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_urls(spark):
    given = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1", "x://org", "x://org/", "http://forg/a", "http://a.com/fr", "http://a.com/fr/1?u=1", "a://b.com/de/x://y", "http://ex\nample.org/es/a", "https://m.example.org/en/12#t", "https://m.example.org/en/2"]
    given += [f"http://h{i % 7}.com/de/{i}" for i in range(40)] + [f"http://h{i % 5}.net/de/{i}" for i in range(20)] + [f"http://h{i}.net/" + "/".join("abcdefghij") for i in range(3)]
    out = urls.judge(spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(given)], "page_id long, url string, host string, rule string")).collect()
    assert len(out) == len(given)
    for r in out:
        host, path, rule, verdict = brute_rule(given[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
        if host.endswith(".net") and path.startswith("/de/"):
            assert r["verdict"] == "block"  # learned from /de/ pages that a rule blocks
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_equal_sql_at_any_depth(spark, tmp_path):
    """Templates, purities and verdicts against DuckDB, on paths deeper than any earlier bound."""
    deep = "/".join("abcdefg")
    given = [f"http://h{i % 3}.net/{deep}/{'good' if i % 2 else 'bad'}/{i}" for i in range(60)] + [f"http://h{i % 3}.com/{'fr' if i % 4 else 'de'}/{deep}/{i // 2}" for i in range(80)]
    given += [f"http://s{i % 9}.example.org/{'es' if i % 3 else 'en'}/{i % 25}{'' if i % 2 else '/x'}" for i in range(200)] + [f"http://big.org/{i}" for i in range(150)] + [None, "", "x://", "http://h1.net", "http://h1.net/"]
    path = str(tmp_path / "pages.parquet")
    docs = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    docs.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(queries.oracle_sql()["op6_url_filters"]).fetchall()
    got = [tuple(r) for r in urls.judge(docs).select("page_id", "host", "path", "rule", "verdict", "template", "purity").collect()]
    assert sorted(got) == sorted(want) and {t[5] for t in got} >= {"/*"}
    depth = [t for t in got if t[1] == "h0.net"]
    assert {t[5].split("/")[8] for t in depth} == {"good", "bad"}  # the eighth segment parts templates


def brute_kept(x, settings):
    """The least-determinant estimate of one group by plain loops over NumPy rows; distances over the median's scale."""
    n, d = x.shape
    floors = np.array(settings.floors)

    def quantile(v, q):
        return np.sort(v)[max(math.ceil(q * len(v)) - 1, 0)]

    def bounded(c):
        c = c.copy()
        np.fill_diagonal(c, np.maximum(np.diag(c), floors**2))
        return c

    def distances(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def step(models):
        inner = []
        for m, c in models:
            d2 = distances(m, c)
            inner.append(x[d2 <= quantile(d2, settings.share) * (1 + 1e-9)])
        pooled = np.concatenate(inner)
        pm, pc = pooled.mean(0), np.cov(pooled.T, bias=True)
        k = settings.shrink
        return [((len(i) * i.mean(0) + k * pm) / (len(i) + k), bounded((len(i) * np.cov(i.T, bias=True) + k * pc) / (len(i) + k))) for i in inner]

    middle = np.array([quantile(x[:, j], 0.5) for j in range(d)])
    spread = np.maximum([(quantile(x[:, j], 0.75) - quantile(x[:, j], 0.25)) / 1.349 for j in range(d)], floors)
    z = (x - middle) / spread
    models = []
    for w in (None, np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)):
        c = np.eye(d)
        if w is not None:
            s = w.T @ w
            c = 0.9 * s / np.sqrt(np.maximum(np.outer(np.diag(s), np.diag(s)), 1e-18))
            np.fill_diagonal(c, 1.0)
        models.append((middle, bounded(c * np.outer(spread, spread))))
    for _ in range(settings.first):
        models = step(models)
    best = min(models, key=lambda m: np.linalg.slogdet(m[1])[1])
    while True:
        new = step([best])[0]
        if np.linalg.slogdet(new[1])[1] >= np.linalg.slogdet(best[1])[1] - settings.still:
            break
        best = new
    d2 = distances(*best)
    return d2 / max(quantile(d2, 0.5) / settings.median, 1.0)


def test_outliers_equal_brute_force(spark):
    """One group, so that the pooled estimate is its own: the distance of every document by the definition in NumPy."""
    rows = []
    for i in range(150):
        n = RNG.randint(60, 400)
        w = [f"w{RNG.randrange(500)}" + ("#" if RNG.random() < 0.02 * (i % 4) else "") for _ in range(n)]
        if i % 15 == 0:
            w = [x + "$|%" for x in w]
        if i % 23 == 0:
            w = w[:30] * 5 + w
        rows.append((i, " ".join(w[: n // 2]) + "\n" + " ".join(w[n // 2 :]) + "\nsame line\nsame line" * (i % 3), "en", "s"))
    out = outliers.reject_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id").sort_index()
    good = out[~out["base_failed"]]
    n, chars = good["n_words"].to_numpy(float), good["word_chars"].to_numpy(float)
    x = np.column_stack([np.log1p(n), np.log(chars / n), np.sqrt(good["n_symbols"] / chars), np.sqrt(good["n_dup_lines"] / n), np.sqrt(good["n_repeat_words"] / n)])
    want = brute_kept(x, outliers.Settings())
    assert len(good) > 120 and np.allclose(good["distance"], want, rtol=1e-6)
    assert (good["kept"].to_numpy() == (want <= outliers.Settings().cutoff)).all() and 0 < (~good["kept"]).sum() < 40
