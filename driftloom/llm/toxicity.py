"""Toxicity: disguised words restored by a noisy channel over character lattices, then scored by a learned lexicon."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import as_bytes, bucket_of, chunks, ship, stored

#: What a written character can stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
_CORE = re.compile(r"\w(?:.*\w)?", re.S)
_TWICE = re.compile(r"(.)\1+", re.S)
_LEET = re.compile(f"[{re.escape(''.join(LEET))}]")
#: What a token may begin and end with beside its core.
_HEAD, _TAIL = "\"'([{<|.,;:*#", ".,;:?\"')]}>|"
#: Three or more single characters with one to three separators between; these are no characters themselves, so that the
#: pattern can match a stretch in one way only.
_SPACED = re.compile(r"(?<!\S)[^\s.\-_*](?:[ \t.\-_*]{1,3}[^\s.\-_*]){2,}(?!\S)")
#: Longer tokens are not remembered, so that a worker's memory is bounded by the number of remembered ones.
_LONG = 64
#: Keys that a worker counts before it hands the counts on, and tokens whose keys it remembers.
_KEYS, _KNOWN = 200_000, 100_000


@dataclass(frozen=True)
class Settings:
    """Costs are log probabilities of the channel."""

    kept: float = -0.05
    leet: float = -2.0
    repeat: float = -1.5
    filler: float = -1.5
    prefixes: tuple[int, ...] = (4, 5, 6)


def bare(token: str) -> str:
    """A token without what it begins with, closing marks at its end, and a character other than a word's repeated there."""
    end = len(token.rstrip(_TAIL))
    last = token[-1:]
    if last and not (last.isalnum() or last == "_") and len(token) - (run := len(token.rstrip(last))) > 1:
        end = min(end, run)
    return token[:end].lstrip(_HEAD)


def skeleton(text: str) -> str:
    """The letters of a text, one for each run of a letter."""
    return _TWICE.sub(r"\1", text if text.isalpha() else "".join(filter(str.isalpha, text)))


def own_words(text: str) -> set[str]:
    """The distinct cores of a text's tokens."""
    return {m[0] for w in set(text.lower().split()) if (m := _CORE.search(w))}


def trigrams(word: str, n: int) -> Iterator[tuple[str, int]]:
    """A word's character trigrams with its bounds, each with the weight of a word seen ``n`` times, in millionths."""
    t, weight = f"^^{word}$", round(1e6 * (1 + math.log(n)))
    for i in range(2, len(t)):
        yield t[i - 2 : i + 1], weight


def evidence(k: int, j: int, n0: int, n1: int, bar: float) -> float | None:
    """Log odds of a feature in ``k`` of ``n1`` toxic and ``j`` of ``n0`` other texts, if it tells more than chance."""
    if not k:
        return None
    share = (k + j) / (n0 + n1)
    gain = 2 * (k * math.log(k / n1 / share) + (j * math.log(j / n0 / share) if j else 0))
    # the lower end of the log odds: what few documents show counts less
    odds = math.log((k - math.sqrt(k) / 2) / n1) - math.log((j + 0.5) / n0)
    return odds if odds > 1 and gain > bar else None


class CharModel:
    """Interpolated character trigrams of words, with the word's bounds, from the trigrams' weights in millionths."""

    def __init__(self, weights: dict[str, int]):
        three, two, one = Counter(), Counter(), Counter()
        for t, n in sorted(weights.items()):
            n /= 1e6
            three[t] += n
            two[t[1:]] += n
            one[t[2]] += n
        self.three, self.two, self.one, self.total = three, two, one, sum(one.values()) + 1
        self.under3, self.under2 = Counter(), Counter()
        for k, n in three.items():
            self.under3[k[:2]] += n
        for k, n in two.items():
            self.under2[k[0]] += n
        self.memory: dict[str, float] = {}

    def __call__(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        if (p := self.memory.get(key)) is None:
            if len(self.memory) > 200_000:
                self.memory.clear()
            one = (self.one[c] + 0.01) / self.total
            two = (self.two[b + c] + 5 * one) / (self.under2[b] + 5)
            three = (self.three[key] + 3 * two) / (self.under3[a + b] + 3)
            p = self.memory[key] = math.log(three)
        return p


class Toxicity:
    def __init__(self, settings: Settings):
        self.settings = settings
        self.forget()

    def forget(self) -> None:
        """Start without remembered tokens: the weights of those that have one, and those that have none."""
        self.memory: dict[str, float] = {}
        self.blank: set[str] = set()

    # -- restoring -------------------------------------------------------------------------------------------------

    def restore(self, token: str) -> str:
        """The likeliest word behind a written token: Viterbi over its character lattice, two characters of context.

        Each character is kept, read as a letter it looks like, left out as filler if it is no letter, or left out as one
        more of a repeated character. The path of highest channel and language-model probability wins.
        """
        s, lm, known = self.settings, self.chars, self.chars.memory.get
        kept, leet, double, filler = s.kept, s.leet, s.leet * 2, s.leet * 3
        # a state is its last two characters; its text a chain of the last character and the chain before it, so that a step
        # costs the same anywhere in a token
        states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        last = ""
        for c in token:
            letter, again = c.isalpha(), c == last
            reads = [(c, kept if letter else double), *((x, leet) for x in LEET.get(c, ""))]
            skip = (s.repeat if again else s.filler if c not in LEET else filler) if again or not letter else None
            fresh: dict[str, tuple[float, tuple | None]] = {}
            for ab, (score, text) in states.items():
                if skip is not None and ((old := fresh.get(ab)) is None or old[0] < score + skip):
                    fresh[ab] = (score + skip, text)
                for x, cost in reads:
                    p = known(ab + x)
                    total = score + cost + (lm(ab[0], ab[1], x) if p is None else p)
                    bx = ab[1] + x
                    if (old := fresh.get(bx)) is None or old[0] < total:
                        fresh[bx] = (total, (x, text))
            states, last = fresh, c
        # of equal paths the one whose last characters are first
        chain = min(((-score - lm(ab[0], ab[1], "$"), ab, text) for ab, (score, text) in states.items()), key=lambda s: s[:2])[2]
        out = []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        return "".join(reversed(out))

    def readings(self, token: str) -> set[str]:
        """A token's plain core, and what it restores to if its lattice has more than one path."""
        core = bare(token)
        if core.isalpha() and not _TWICE.search(core):
            return {core}
        found = {m[0]} if (m := _CORE.search(core)) else set()
        if core and any(c.isalpha() or c in LEET for c in core) and not core.isdigit():
            found.add(self.restore(core))
        return found

    # -- lexicon -----------------------------------------------------------------------------------------------------

    def features(self, word: str) -> list[str]:
        return [word, *(f"{word[:n]}*" for n in self.settings.prefixes if len(word) >= n)]

    def learned(self, lexicon: dict[str, float]) -> None:
        """Take a lexicon, and the skeletons of what it holds that a token without look-alikes of letters can be read as."""
        self.lexicon = lexicon
        longest = max(self.settings.prefixes, default=1)
        self.heads = {skeleton(f.removesuffix("*"))[:longest] for f in lexicon if not _LEET.search(f)}
        self.lengths = sorted({len(h) for h in self.heads}, reverse=True)
        self.forget()

    def may(self, token: str) -> bool:
        """Whether a reading of the token can be in the lexicon.

        Without look-alikes a reading drops other characters and repeated ones only, and so has the token's skeleton; that
        of a word or prefix in the lexicon is then one of its beginnings.
        """
        core = bare(token)
        if _LEET.search(core):
            return True
        own, heads = skeleton(core), self.heads
        return any(own[:n] in heads for n in self.lengths)

    def weight(self, token: str) -> float:
        """The strongest evidence among a token's readings."""
        if token in self.blank:
            return 0.0
        if (w := self.memory.get(token)) is None:
            if len(self.memory) + len(self.blank) > 400_000:
                self.forget()
            get = self.lexicon.get
            w = max((get(f, 0.0) for r in self.readings(token) for f in self.features(r)), default=0.0) if self.may(token) else 0.0
            if len(token) <= _LONG and w > 0:
                self.memory[token] = w
            elif len(token) <= _LONG:
                self.blank.add(token)
        return w

    def tokens(self, text: str) -> set[str]:
        """Distinct lower-case tokens, and runs of three or more single spaced characters as a token each."""
        low = text.lower()
        out = set(low.split())
        if any(len(t) == 1 for t in out) and (runs := _SPACED.findall(low)):
            out.update(re.sub(r"[ \t.\-_*]", "", r) for r in runs)
        return out

    def vector(self, text: str) -> list[float]:
        found = sorted((w for t in self.tokens(text).difference(self.blank) if (w := self.weight(t)) > 0), reverse=True)[:5] + [0.0] * 5
        return [found[0], found[1], sum(found[2:5])]

    def strong(self, word: str, n: int) -> int:
        """How often a word counts for the character model: words of the lexicon fifty times."""
        return n * (50 if any(self.lexicon.get(f, 0) > 2 for f in self.features(word)) else 1)

    def start(self, n0: int, n1: int) -> bool:
        """Whether there are labels of both classes to learn from."""
        self.constant = n1 / (n0 + n1) if n0 + n1 else 0.5
        self.trained = bool(n0 and n1)
        return self.trained

    def newton(self, std: np.ndarray, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> None:
        """Fit the logistic function; ``sums`` gives a weight vector's curvature and gradient over all texts."""
        self.scale = std + 1e-6
        w, ridge = np.zeros(len(std) + 1), np.diag([0.1] * len(std) + [0.0])
        for _ in range(25):
            curve, slope = sums(w)
            step = np.linalg.solve(curve + ridge, slope + ridge @ w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.coefficients = w

    def fit(self, texts: list[str], labels: list[int]) -> Toxicity:
        """Learn from a list. ``learn`` and ``fit_points`` learn the same from tables."""
        y = np.array(labels, float)
        if not self.start(n0 := int((y == 0).sum()), n1 := int(y.sum())):
            return self
        words: Counter = Counter()
        seen = [Counter(), Counter()]
        for t, label in zip(texts, labels, strict=True):
            own = own_words(t)
            words.update(w for w in own if w.isalpha())
            seen[label].update({f for w in own for f in self.features(w)})
        bar = _bar(len(seen[0] | seen[1]))
        self.learned({f: odds for f, k in seen[1].items() if (odds := evidence(k, seen[0][f], n0, n1, bar)) is not None})
        three: Counter = Counter()
        for w, n in words.items():
            for t, weight in trigrams(w, self.strong(w, n)):
                three[t] += weight
        self.chars = CharModel(three)
        x = np.array([self.vector(t) for t in texts])
        std = x.std(0)
        x = np.column_stack([x / (std + 1e-6), np.ones(len(x))])

        def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = _sigmoid(x @ w)
            return (x * (p * (1 - p) + 1e-6)[:, None]).T @ x, x.T @ (p - y)

        self.newton(std, sums)
        return self

    def learn(self, rows: DataFrame) -> bool:
        """Learn lexicon and character model from every row of a stored table (text, y); False without both classes.

        Counts are summed by key among the workers. To the driver come the lexicon (features of several toxic texts that
        chance doesn't give) and the distinct character trigrams.
        """
        spark = rows.sparkSession
        sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
        if not self.start(n0, n1):
            return False
        features = self.features

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a token's features: its core, which is what words are counted by too, and the core's prefixes, which end in a star
            known: dict[str, tuple[str, ...]] = {}

            def keys(token: str) -> tuple[str, ...]:
                if (found := known.get(token)) is None:
                    found = tuple(features(m[0])) if (m := _CORE.search(token)) else ()
                    if len(token) <= _LONG:
                        if len(known) >= _KNOWN:
                            known.clear()
                        known[token] = found
                return found

            seen = Counter(), Counter()
            for part in chunks(batches, "text"):
                for text, y in zip(as_bytes(part, "text"), part.column(1).to_pylist(), strict=True):
                    seen[y].update(set().union(*map(keys, set(text.decode("utf-8", "replace").lower().split()))))
                    if len(seen[0]) + len(seen[1]) > _KEYS:
                        yield _counted(*seen)
                        seen = Counter(), Counter()
            yield _counted(*seen)

        counts = stored(rows.select("text", "y").mapInArrow(count, "key string, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "counts")
        bar = _bar(counts.count())

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(f, odds) for f, j, k in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (odds := evidence(k, j, n0, n1, bar)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([o for _, o in found], pa.float64())], ["key", "odds"])

        chosen = counts.where("n1 > 0").select("key", "n0", "n1").mapInArrow(choose, "key string, odds double").toArrow()
        self.learned(dict(zip(*(c.to_pylist() for c in chosen.columns), strict=True)))
        model = spark.sparkContext.broadcast(self)

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            three: Counter = Counter()
            for batch in batches:
                for w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not w.isalpha():
                        continue
                    for t, weight in trigrams(w, model.value.strong(w, n)):
                        three[t] += weight
                    if len(three) > _KEYS:
                        yield _weighed(three)
                        three = Counter()
            yield _weighed(three)

        words = counts.where(~F.col("key").endswith("*")).select("key", (F.col("n0") + F.col("n1")).alias("n"))
        three = words.mapInArrow(spell, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        self.chars = CharModel(dict(zip(*(c.to_pylist() for c in three.columns), strict=True)))
        model.unpersist()
        return True

    def fit_points(self, rows: DataFrame) -> Toxicity:
        """Fit the logistic function to a table (x0, x1, x2, y) of vectors; its sums come to the driver."""
        xs = ["x0", "x1", "x2"]
        points = stored(rows.groupBy(*xs, "y").agg(F.count("*").alias("n")), "points")
        r = points.agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in xs), *(F.sum(F.col("n") * F.col(c) * F.col(c)).alias(f"{c}_") for c in xs)).first()
        mean = np.array([r[c] for c in xs]) / r["n"]
        std = np.sqrt(np.maximum(np.array([r[f"{c}_"] for c in xs]) / r["n"] - mean**2, 0))
        scaled = [*(F.col(c) / F.lit(float(s + 1e-6)) for c, s in zip(xs, std, strict=True)), F.lit(1.0)]

        def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = sum((c * F.lit(float(v)) for c, v in zip(scaled, w, strict=True)), F.lit(0.0))
            p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
            curve = [F.sum(F.col("n") * (p * (1 - p) + 1e-6) * scaled[i] * scaled[j]) for i in range(4) for j in range(4)]
            got = points.agg(*curve, *(F.sum(F.col("n") * (p - F.col("y")) * c) for c in scaled)).first()
            return np.array(got[:16], float).reshape(4, 4), np.array(got[16:], float)

        self.newton(std, sums)
        return self

    def probability(self) -> F.Column:
        """The score of a vector (x0, x1, x2)."""
        z = F.lit(float(self.coefficients[3]))
        for i in range(3):
            z = z + F.col(f"x{i}") / F.lit(float(self.scale[i])) * F.lit(float(self.coefficients[i]))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.constant)
        x = np.array([self.vector(t) for t in texts]).reshape(-1, 3)
        return _sigmoid(np.column_stack([x / self.scale, np.ones(len(x))]) @ self.coefficients)


def _bar(features: int) -> float:
    return 2 * math.log(features + 1)  # what the best of so many features reaches by chance


def _counted(n0: Counter, n1: Counter) -> pa.RecordBatch:
    keys = list(n0.keys() | n1.keys())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([n[k] for k in keys], pa.int64()) for n in (n0, n1))], ["key", "n0", "n1"])


def _weighed(weights: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(weights), pa.string()), pa.array(list(weights.values()), pa.int64())], ["key", "n"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each whole text.

    Learns from all labelled rows whose crc32(doc_id) modulo ``folds`` is not 0, of an id once, from their texts alone: character model, lexicon of words and prefixes, and a logistic function of a document's strongest evidence.
    Null and empty texts are scored as texts without evidence; without labels of both classes every score is the share of
    label 1 (0.5 without any). A null doc_id is in the fold of the empty text. Repeated rows are each scored; of an id's
    contradicting labels the larger counts. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    settings = settings or Settings()
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
    ids = ids.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (bucket_of(F.col("id"), folds) != 0)).groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").join(ids, "id")
    rows = stored(rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y", "id", F.xxhash64("text").alias("mark")), "labelled")
    model = Toxicity(settings)
    held_out = (bucket_of(F.col("doc_id"), folds) == 0).alias("held_out")
    if not model.learn(rows):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", held_out, F.lit(float(model.constant)).alias("score"), F.lit(int(model.constant >= threshold)).alias("predicted"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            x = np.array([shared.value.vector(t.decode("utf-8", "replace")) for t in as_bytes(part, "text")])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x[:, i]) for i in range(3))], ["doc_id", "mark", "x0", "x1", "x2"])

    # each text is read once: its vector serves the fit and the score
    text = F.col("text").cast("string")
    vectors = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    vectors = stored(vectors.mapInArrow(run, "doc_id long, mark long, x0 double, x1 double, x2 double"), "vectors")
    shared.unpersist()
    own = vectors.join(rows.select(F.col("id").alias("doc_id"), "mark", "y"), ["doc_id", "mark"])
    own = own.groupBy("doc_id").agg(*(F.first(c).alias(c) for c in ("x0", "x1", "x2", "y")))  # of equal rows one
    model.fit_points(own)
    scored = vectors.select("doc_id", held_out, model.probability().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
