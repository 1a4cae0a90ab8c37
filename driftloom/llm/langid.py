"""Language identification: a document as a mixture of languages, its shares found by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import as_bytes, bucket_of, chunks, sampled, ship

_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the documents learned from for each language, ``languages`` the languages (the most frequent ones are
    learned) and ``megabytes`` the texts of all together."""

    sample: int = 600
    languages: int = 200
    megabytes: int = 256
    bits: int = 15
    smooth: float = 0.5
    rounds: int = 30
    penalty: float = 1.0
    effective: float = 3.0


def grams(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the lower-cased text with single spaces between words: distinct slots and counts."""
    data = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0)
    code = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761) >> np.uint32(32 - bits)
    if len(code) < 1 << (bits - 3):
        return np.unique(code, return_counts=True)
    count = np.bincount(code, minlength=1 << bits)
    slots = np.flatnonzero(count)
    return slots, count[slots]


class Mixture:
    """Trigram probabilities of each language, and the mixture inference over them."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def fit(self, rows: list[tuple[bytes, str]]) -> Mixture:
        s = self.settings
        self.langs = sorted({lang for _, lang in rows})
        count = np.full((1 << s.bits, len(self.langs)), s.smooth)
        at = {lang: k for k, lang in enumerate(self.langs)}
        for text, lang in rows:
            slots, n = grams(text, s.bits)
            # a document's repetitions count by their root: copied lines don't rule a language
            count[slots, at[lang]] += np.sqrt(n)
        self.p = (count / count.sum(0)).astype(np.float64) if self.langs else count
        return self

    def shares(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the languages in p's columns, by expectation-maximisation, and the log likelihood reached."""
        k = p.shape[1]
        share = np.full(k, 1 / k)
        total = n.sum()
        for _ in range(self.settings.rounds if k > 1 else 0):
            part = p * share
            new = (n / part.sum(1)) @ part / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, text: bytes) -> tuple[str, float, list[tuple[str, float]]]:
        """The main language, its share times its certainty, and the set of languages with their shares.

        The main language of a mixed text has the largest share of the whole text.
        The set grows from the best single language by the one with the largest share among all, as long as the
        likelihood, taken for the effective number of independent trigrams, gains more than the penalty.
        """
        slots, n = grams(text, self.settings.bits)
        if not self.langs or not len(slots) or not _LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0, []
        p, n = self.p[slots], n.astype(np.float64)
        single = n @ np.log(p)
        order = np.argsort(-single, kind="stable")
        chosen, best, share = [int(order[0])], float(single[order[0]]), np.ones(1)
        weight = 1 / self.settings.effective
        cost = self.settings.penalty * np.log(n.sum() + 1)
        if len(self.langs) > 1:
            full, _ = self.shares(p, n)
            for k in np.argsort(-full, kind="stable").tolist():
                if k in chosen or full[k] < 0.02:
                    continue
                trial, value = self.shares(p[:, [*chosen, k]], n)
                if (value - best) * weight <= cost:
                    break
                chosen, best, share = [*chosen, k], value, trial
        top = int(np.argmax(share))
        rest = np.delete(single, chosen[top])
        gap = (single[chosen[top]] - rest.max()) * weight if len(rest) else np.inf
        sure = 1 / (1 + np.exp(-min(max(gap, -30), 30))) if len(chosen) == 1 else 1.0
        return self.langs[chosen[top]], float(share[top] * sure), [(self.langs[k], float(x)) for k, x in zip(chosen, share, strict=True)]


def identify_languages(docs: DataFrame, folds: int = 4, held: int = 2, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture (the language set with shares) of each whole text.

    Learns from texts with a language whose crc32(doc_id) modulo ``folds`` is not ``held``: for each language those with
    the smallest hashes of the id, ``settings.sample`` at most, an id once. Null texts, and those without a letter, are ``und`` with
    score 0, as is everything if no language is known. Ties go to the language first by name. A null doc_id is in the fold
    of the empty text. Repeated rows are each predicted; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    settings = settings or Settings()
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), folds) != held))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(settings.languages).collect()
    # a threshold that lets through twice the sample, so that few rows are ranked
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limits = spark.createDataFrame([(r["lang"], int(min(1.0, 2 * settings.sample / r["n"]) * (1 << 30))) for r in counts], "lang string, bound long")
    near = known.join(F.broadcast(limits), "lang").where(spread < F.col("bound")).select(F.col("doc_id").alias("id"), "text", "lang")
    rows = sampled(near, ["lang"], settings.sample, settings.megabytes) if counts else []
    model = spark.sparkContext.broadcast(Mixture(settings).fit([(r["text"].encode(), r["lang"]) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = [model.value.infer(t) for t in as_bytes(part, "text")]
            mixed = pa.array([[{"lang": a, "share": b} for a, b in f[2]] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), mixed], ["doc_id", "lang_pred", "score", "mixture"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    return out.select("doc_id", (bucket_of(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score", "mixture")
